"""Codecs and raster operators: round trips, synthetic bytes, small pictures."""

import hashlib
import os
import struct
import zlib

import numpy as np
import pytest

from tilewright.operators import raster
from tilewright.sources import binary


def test_qoi_and_png_round_trips():
    a = (13 * np.arange(17 * 23 * 4) & 255).astype(np.uint8).reshape(23, 17, 4)
    flat = np.full((9, 70, 4), 7, dtype=np.uint8)
    noise = np.random.default_rng(1).integers(0, 256, (20, 20, 4)).astype(np.uint8)
    smooth = (np.add.outer(np.arange(30), np.arange(30))[..., None] + np.array([0, 1, 2, 0])).astype(np.uint8)
    for image in (a, flat, noise, smooth):
        assert (raster.read_qoi(raster.qoi(image)) == image).all()
        assert (raster.read_png(raster.png(image)) == image).all()
    assert (raster.read_png(raster.png(a[..., 0], 9)) == a[..., 0]).all()
    for bad in (b"", b"qoif" + b"\0" * 30, raster.qoi(a)[:40]):
        with pytest.raises(ValueError):
            raster.read_qoi(bad)


def small_pack():
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
    mega = np.zeros((2, 16), dtype="<u2")
    mega[1] = 1 << 1
    minis = np.zeros((2, 8, 8), dtype=np.uint8)
    minis[1] = 7
    data = b"TSP1" + struct.pack("<III", 2, 2, 2) + palette.tobytes() + np.array([0, 1], dtype="<u2").tobytes() + mega.tobytes() + minis.tobytes()
    return data


def test_tile_pack():
    p = binary.tile_pack(small_pack())
    tiles = np.array([0, 1, 1, 0])
    full = raster.render_indices(p, 2, 2, tiles)
    part = raster.render_indices(p, 2, 2, tiles, (1, 0, 1, 2))
    assert part.shape == (64, 32) and part[8, 8] == 7 and part[40, 8] == 0
    assert (part == full[:, 32:]).all()
    for rect in ((-1, 0, 1, 1), (0, -1, 1, 1), (0, 0, 0, 1), (0, 0, 1, 0), (2, 0, 1, 1), (0, 0, 2, 3)):
        with pytest.raises(ValueError):
            raster.render_indices(p, 2, 2, tiles, rect)
    with pytest.raises(ValueError):
        binary.tile_pack(small_pack()[:-1])
    assert (raster.render_indices(p, 1, 1, np.array([77])) == 0).all()


def test_layers_recompose():
    p = binary.tile_pack(small_pack())
    art = np.zeros((6, 6, 4), dtype=np.uint8)
    art[1:5, 1:5] = (200, 10, 10, 255)
    sprites = {**dict.fromkeys(raster.K.MINERAL_SPRITES, art), raster.K.GEYSER_SPRITE: art, **{f"{n}:shadow": art for n in raster.K.MINERAL_SPRITES}}
    tiles = np.arange(64) % 2
    args = (p, 8, 8, tiles, [(64, 80)], [(190, 200)])
    rect = (1, 1, 6, 6)
    ground = raster.render(*args, raster.Layers(), rect)
    alone = raster.render(*args, raster.Layers(terrain=False, resources=True, sprites=sprites), rect)
    both = raster.render(*args, raster.Layers(resources=True, sprites=sprites), rect)
    raster.over(ground, alone, 0, 0)
    assert (ground == both).all()
    shaded = raster.render(*args, raster.Layers(terrain=False, resources=True, shadows=True, sprites=sprites), rect)
    assert (shaded[..., 3] > 0).sum() >= (alone[..., 3] > 0).sum()


def test_box_average():
    board = np.zeros((4, 4, 4), dtype=np.uint8)
    board[..., 3] = 255
    board[np.add.outer(np.arange(4), np.arange(4)) % 2 == 0, :3] = 200
    assert (raster.box_downsample(board, 2) == [100, 100, 100, 255]).all()
    assert raster.box_downsample(np.zeros((5, 5), dtype=np.uint8), 2).shape == (2, 2)


def test_creep_table(spark):
    f = raster.creep_frames()
    assert f[0] == 0 and f[255] > 0 and f[0b11100000] > 0 and len(set(f.tolist())) == f.max() + 1
    from tilewright.plans.maps_queries import QUERIES

    assert {r["neighbours"]: r["frame"] for r in QUERIES["creep_edges"](spark, "").collect()} == dict(enumerate(f.tolist()))


def test_tint_and_blend():
    image = np.full((1, 2, 4), 128, dtype=np.uint8)
    got = raster.tint(image, np.array([[0, 255]], dtype=np.uint8), (255, 0, 0))
    assert got[0, 0].tolist() == [128, 128, 128, 128] and got[0, 1].tolist() == [255, 0, 0, 128]
    canvas = np.zeros((1, 1, 4), dtype=np.uint8)
    raster.blend(canvas, np.ones((1, 1), dtype=bool), (255, 255, 255, 120))
    assert canvas[0, 0].tolist() == [120, 120, 120, 255]
    assert raster.shadow_image(np.array([[255]]))[0, 0].tolist() == [0, 0, 0, 120]


def test_overlays_paint():
    canvas = np.zeros((8, 8, 4), dtype=np.uint8)
    mask = np.zeros(16, dtype=bool)
    mask[5] = True
    raster.draw_mask(canvas, mask, 4, 4, (10, 20, 30, 255), (200, 0, 0, 255))
    assert canvas[2:4, 2:4, 0].tolist() == [[200, 200], [200, 200]] and canvas[0, 0].tolist() == [0, 0, 0, 0]
    raster.thick_line(canvas, (0.0, 7.5), (8.0, 7.5), 1.0, (9, 9, 9, 255))
    assert (canvas[7, :, 0] == 9).all()
    assert raster.mask_centroid(mask, 4) == (1.5, 1.5) and raster.mask_centroid(mask & False, 4) is None
    assert raster.label_scale([], 1, "x") == 5 and raster.label_scale([(0, 0), (1000, 0)], 1, "ab") == 10


def test_nibbles():
    v = np.arange(48, dtype=np.uint8).reshape(3, 16) & 15
    assert (binary.nibbles(binary.pack_nibbles(v, b"SMF1"), b"SMF1") == v).all()
    with pytest.raises(ValueError):
        binary.nibbles(binary.pack_nibbles(v, b"SMF1"), b"SME1")


def test_nibble_rows(spark, tmp_path):
    (tmp_path / "features.bin").write_bytes(binary.pack_nibbles(np.ones((2, 16)), b"SMF1"))
    (tmp_path / "broken.bin").write_bytes(b"xx")
    rows = binary.nibble_rows(binary.files(spark, str(tmp_path)), b"SMF1")
    assert rows.where("error is null").count() == 32 and rows.where("error is not null").count() == 1


def test_build_pack_and_elevation():
    cv5 = bytearray(52 * 2)
    for slot in range(16):
        struct.pack_into("<H", cv5, 52 + 20 + slot * 2, 1)
    vx4 = struct.pack("<16I", *[0] * 16) + struct.pack("<16I", *[2] * 16)
    packed = binary.build_pack(bytes(cv5), vx4, bytes(64) + bytes([5] * 64), bytes(1024))
    p = binary.tile_pack(packed)
    assert raster.render_indices(p, 1, 1, np.array([16]))[0, 0] == 5
    vf4 = struct.pack("<16H", *[0] * 16) + struct.pack("<16H", *[6] + [2] * 15)
    e = binary.nibbles(binary.elevation_table(bytes(cv5), vf4), b"SME1")
    assert e[16].tolist() == [2] + [1] * 15 and e[0].tolist() == [0] * 16


def test_sprite_and_grp():
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
    index = np.array([[1, 2], [3, 4]])
    got = binary.sprite(binary.pack_sprite(index, np.array([[1, 0], [1, 1]])), palette)
    assert got[0, 0].tolist() == [1, 1, 1, 255] and got[0, 1].tolist() == [0, 0, 0, 0]
    line = bytes([0x81, 0x42, 9, 1, 8])  # skip one, nine twice, eight once
    grp = struct.pack("<HHH", 1, 6, 3) + struct.pack("<BBBBI", 1, 1, 4, 1, 14) + struct.pack("<H", 2) + line
    i, p = binary.grp_frame(grp)
    assert i[1].tolist() == [0, 0, 9, 9, 8, 0] and p.sum() == 3
    with pytest.raises(ValueError):
        binary.grp_frame(grp, 5)


def dds(code, block, w=4, h=4):
    head = bytearray(128)
    head[:4] = b"DDS "
    struct.pack_into("<II", head, 12, h, w)
    head[84:88] = code
    return bytes(head) + block


def test_dds():
    red, blue = 0xF800, 0x001F
    block = struct.pack("<HHI", red, blue, 0b11_10_01_00)
    got = binary.dds(dds(b"DXT1", block))
    assert got[0, 0].tolist() == [255, 0, 0, 255] and got[0, 1].tolist() == [0, 0, 255, 255] and got[0, 2].tolist() == [170, 0, 85, 255]
    clear = binary.dds(dds(b"DXT1", struct.pack("<HHI", blue, red, 0b11)))
    assert clear[0, 0].tolist() == [0, 0, 0, 0]
    alpha = bytes([200, 100]) + bytes(6)
    assert binary.dds(dds(b"DXT5", alpha + block))[..., 3].tolist() == [[200] * 4] * 4
    with pytest.raises(ValueError):
        binary.dds(dds(b"DXT3", block))


def test_anim_container():
    names = b"".join(n.ljust(32, b"\0") for n in [b"diffuse", b"teamcolor"] + [b""] * 8)
    image = dds(b"DXT1", struct.pack("<HHI", 0xF800, 0x001F, 0))
    frames_at = 332 + 12 + 120
    layer_at = frames_at + 16
    entry = struct.pack("<HHHHI", 1, 0, 8, 8, frames_at) + struct.pack("<III", layer_at, len(image), 0) + bytes(108)
    data = b"ANIM" + bytes(8) + names + entry + struct.pack("<HHhhHHHH", 0, 0, 2, -3, 8, 8, 0, 0) + image
    a = binary.anim(data)
    assert a["size"] == (4, 4) and a["frames"][0] == {"rect": (0, 0, 4, 4), "origin": (1, 3)} and list(a["layers"]) == ["diffuse"]
    with pytest.raises(ValueError):
        binary.anim(data[:40])
    assert binary.anim_frame(a, 0)["layers"]["diffuse"].shape == (4, 4, 4)
    for bad in (a | {"frames": [a["frames"][0] | {"rect": (2, 0, 6, 4)}]}, a | {"frames": []}):
        with pytest.raises(ValueError):
            binary.anim_frame(bad, 0)


def test_script_operands():
    # a list of two words, a plain operation, a jump that ends the run; a cut-off operand ends it too
    code = bytes([25, 2, 1, 0, 2, 0, 5, 9, 7, 4, 0, 5, 1])
    assert binary.script_walk(code, 0) == [(25, [2, 1, 2]), (5, [9]), (7, [4])]
    assert binary.script_walk(bytes([9, 1]), 0) == [] and binary.script_walk(bytes([69]), 0) == []
    assert len(binary.SCRIPT_OPERANDS) == 69


def test_blte():
    raw = b"N" + b"abc"
    packed = b"Z" + zlib.compress(b"hello")
    nested = b"F" + b"BLTE" + struct.pack(">I", 0) + b"Nxy"
    chunks = [(raw, 3), (packed, 5), (nested, 2)]
    head = 12 + 24 * len(chunks)
    data = b"BLTE" + struct.pack(">I", head) + b"\x0f" + len(chunks).to_bytes(3, "big") + b"".join(struct.pack(">II", len(c), n) + bytes(16) for c, n in chunks) + b"".join(c for c, _ in chunks)
    assert binary.blte(data) == b"abchelloxy"
    for bad in (b"XX", data[:-1], data.replace(struct.pack(">II", len(raw), 3), struct.pack(">II", len(raw), 4))):
        with pytest.raises(ValueError):
            binary.blte(bad)


def test_archive(tmp_path):
    """A tiny content-addressed store, written here and read back by name."""
    blobs, places, archive = {}, [], bytearray()

    def store(content: bytes) -> tuple[bytes, bytes]:
        coded = b"BLTE" + struct.pack(">I", 0) + b"N" + content
        content_key, coded_key = hashlib.md5(content).digest(), hashlib.md5(coded).digest()
        entry = coded_key[::-1] + bytes(14) + coded
        places.append((coded_key, len(archive), len(entry)))
        archive.extend(entry)
        blobs[content_key] = coded_key
        return content_key, coded_key

    units, _ = store(b"unit data")
    root, _ = store(b"Arr\\Units.dat|" + units.hex().encode() + b"\r\nnoise\n")
    page = b"".join(bytes([1]) + bytes(5) + c + e for c, e in blobs.items()).ljust(1024, b"\0")
    table = b"EN" + bytes([1, 16, 16]) + struct.pack(">HH", 1, 1) + struct.pack(">II", 1, 1) + bytes(1) + struct.pack(">I", 0) + bytes(32) + page
    enc_content, enc_coded = store(table)
    data = tmp_path / "Data" / "data"
    data.mkdir(parents=True)
    (data / "data.000").write_bytes(bytes(archive))
    for bucket in range(16):
        rows = places if bucket == 0 else []
        body = b"".join(k[:9] + at.to_bytes(5, "big") + struct.pack("<I", n) for k, at, n in rows)
        head = bytearray(0x28)
        struct.pack_into("<HB", head, 8, 7, bucket)
        head[12:16] = bytes([4, 5, 9, 30])
        struct.pack_into("<I", head, 0x20, len(body))
        (data / f"{bucket:02x}00000001.idx").write_bytes(bytes(head) + body)
        if bucket == 0:
            (data / "0000000000.idx").write_bytes(b"old")
    build = "ab" * 16
    config = tmp_path / "Data" / "config" / "ab" / "ab"
    config.mkdir(parents=True)
    (config / build).write_text(f"# c\nroot = {root.hex()}\nencoding = {enc_content.hex()} {enc_coded.hex()}\n")
    (tmp_path / ".build.info").write_text(f"Branch!STRING:0|Active!DEC:1|Build Key!HEX:16\nx|0|{'00' * 16}\nx|1|{build}\n")
    a = binary.Archive(str(tmp_path))
    assert a.read("arr/UNITS.dat") == b"unit data"
    with pytest.raises(KeyError):
        a.read("nope")
    assert os.path.exists(tmp_path)


def test_game_tables():
    images = bytearray(binary.IMAGES * 38)
    rows = binary.image_table(bytes(images))
    assert len(rows) == binary.IMAGES and rows[5]["image"] == 5
    units = bytes(range(228)) + struct.pack("<228H", *range(228))
    assert binary.unit_table(units)[7] == {"unit": 7, "flingy": 7, "subunit": 7}
    assert binary.string_table(struct.pack("<HHH", 2, 6, 9) + b"ab\0cde\0") == ["", "ab", "cde"]
    script = bytearray(64)
    struct.pack_into("<I", script, 0, 4)
    struct.pack_into("<hH", script, 4, 3, 20)
    struct.pack_into("<h", script, 8, -1)
    struct.pack_into("<H", script, 28, 40)
    script[40:44] = bytes([9, 2, 0, 255])  # imgul image 2, dx -1
    script[44] = 3
    script[45] = 22  # end
    assert binary.script_walk(bytes(script), 40)[0] == (binary.SCRIPT_IMAGE_BELOW, [2, 255, 3])
    table = [{"script": 3, "draw": 0}, {"script": 0, "draw": 0}, {"script": 0, "draw": 10}]
    assert binary.shadow_of(bytes(script), table, 0) == (2, -1, 3)
    assert binary.shadow_of(bytes(script), table, 1) is None
    lo = struct.pack("<III", 1, 0, 12) + struct.pack("<bb", -4, 6)
    assert binary.lo_offset(lo, 0) == (-4, 6)
    assert binary.sprite_name("x/u103_burrowed.qoi") == ("u103_burrowed", 103, "burrowed") and binary.sprite_name("a.qoi") is None


def test_composite_and_locate():
    art = np.zeros((4, 4, 4), dtype=np.uint8)
    art[1:3, 1:3] = (10, 20, 30, 255)
    image, mask, anchor = raster.composite([(art, None, -2, -2)])
    assert image.shape == (2, 2, 4) and anchor == (1, 1) and image[0, 0].tolist() == [10, 20, 30, 255]
    atlas = np.zeros((8, 8, 4), dtype=np.uint8)
    atlas[3:5, 4:6] = (10, 20, 30, 255)
    assert raster.locate(atlas, image, [(0, 0, 3, 3), (2, 2, 8, 8)]) == (1, 4, 3)
    image[0, 0, 0] += 1
    assert raster.locate(atlas, image, [(0, 0, 8, 8)]) is None


def read_jpeg(data):
    """A small decoder for what the encoder writes: baseline, three components, no subsampling."""
    from tilewright.operators import jpeg

    at, quants, codes, head = 2, {}, {}, None
    while True:
        mark, n = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if mark == 0xDB:
            q = np.zeros(64)
            q[jpeg.ZIGZAG] = list(body[1:])
            quants[body[0]] = q
        elif mark == 0xC0:
            head = struct.unpack(">BHHB", body[:6])
        elif mark == 0xC4:
            table, code, k = {}, 0, 17
            for length, count in enumerate(body[1:17], 1):
                for _ in range(count):
                    table[length, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            codes[body[0]] = table
        elif mark == 0xDA:
            break
    bits = np.unpackbits(np.frombuffer(data[at:-2].replace(b"\xff\x00", b"\xff"), dtype=np.uint8)).tolist()
    p = 0

    def take(n):
        nonlocal p
        v = 0
        for b in bits[p : p + n]:
            v = v << 1 | b
        p += n
        return v

    def symbol(table):
        code = length = 0
        while (length, code) not in table or length == 0:
            code, length = code << 1 | take(1), length + 1
        return table[length, code]

    def value(n):
        v = take(n)
        return v if n == 0 or v >> (n - 1) else v - (1 << n) + 1

    _, h, w, _ = head
    rows, cols = -(-h // 8), -(-w // 8)
    planes, last = np.zeros((3, rows * 8, cols * 8)), [0, 0, 0]
    for y in range(rows):
        for x in range(cols):
            for c in range(3):
                z = np.zeros(64)
                last[c] += value(symbol(codes[0x00]))
                z[0], k = last[c], 1
                while k < 64:
                    s = symbol(codes[0x10])
                    if s == 0:
                        break
                    k += s >> 4
                    if s != 0xF0:
                        z[k] = value(s & 15)
                    k += 1
                block = np.zeros(64)
                block[jpeg.ZIGZAG] = z
                planes[c, y * 8 : y * 8 + 8, x * 8 : x * 8 + 8] = jpeg.DCT.T @ (block * quants[min(c, 1)]).reshape(8, 8) @ jpeg.DCT
    luma, blue, red = planes
    rgb = np.stack((luma + 128 + 1.402 * red, luma + 128 - 0.344136 * blue - 0.714136 * red, luma + 128 + 1.772 * blue), axis=-1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)[:h, :w]


def test_jpeg():
    from tilewright.operators import jpeg

    y, x = np.mgrid[0:37, 0:50]
    smooth = np.stack((x * 5, y * 6, 255 - x * 3 - y), axis=-1).astype(np.uint8)
    noise = np.random.default_rng(2).integers(0, 256, (24, 16, 4)).astype(np.uint8)
    assert np.abs(read_jpeg(jpeg.encode(smooth, 95)).astype(int) - smooth).mean() < 2.5
    assert np.abs(read_jpeg(jpeg.encode(noise, 100)).astype(int) - noise[..., :3]).mean() < 3
    assert (read_jpeg(jpeg.encode(np.full((8, 8, 3), 200, dtype=np.uint8), 50)) == 200).all()
    assert len(jpeg.encode(smooth, 10)) < len(jpeg.encode(smooth, 95))
    for bad in (0, 101):
        with pytest.raises(ValueError):
            jpeg.encode(smooth, bad)


def test_units(spark):
    from tilewright.operators import units

    names = spark.createDataFrame([(0, "Terran Marine"), (7, "terran  SCV"), (3, "Goliath"), (4, "goliath"), (9, "")], "unit_id int, unit_name string")
    req = spark.createDataFrame([("0",), (" TERRAN scv ",), ("Goliath",), ("999",), ("nobody",), ("",), (None,), ("99999999999",)], "name string")
    got = {r["name"]: (r["unit_id"], r["error"] is None) for r in units.resolve(req, names).collect()}
    assert got == {"0": (0, True), " TERRAN scv ": (7, True), "Goliath": (3, True), "999": (None, False), "nobody": (None, False), "": (None, False), None: (None, False), "99999999999": (None, False)}
    u = spark.createDataFrame([(103, "burrowed", False), (5, None, True)], "unit_id int, variant string, shadow boolean")
    a = spark.createDataFrame([("u103_burrowed", 1, 2), ("u5.shadow", 3, 4)], "anchor_key string, anchor_x int, anchor_y int")
    assert {(r["sprite"], r["anchor_x"]) for r in units.anchors(u, a).collect()} == {("u103_burrowed", 1), ("u5", 3)}
    chain = units.unit_images(spark.createDataFrame([(1, 2)], "unit int, flingy int"), spark.createDataFrame([(2, 3)], "flingy int, sprite int"), spark.createDataFrame([(3, 4)], "sprite int, image int"))
    assert [tuple(r) for r in chain.collect()] == [(1, 4)]
    images = spark.createDataFrame([(1, "a.grp"), (2, "A.GRP"), (3, "b.grp"), (4, "c.grp")], "image int, grp_name string")
    have = spark.createDataFrame([(2,), (3,)], "image int")
    want = spark.createDataFrame([(1,), (2,), (3,), (4,)], "image int")
    assert {tuple(r) for r in units.with_siblings(want, images, have).collect()} == {(1, 2), (2, 2), (3, 3), (4, None)}
