"""Binary sources: nibble tables, tile packs, sprites, game tables, GRP and DDS images, ANIM containers, BLTE, archives.

Each parser takes the bytes of one file and returns arrays or rows; ``files`` reads a folder with ``binaryFile`` and
applies a parser inside Arrow batches. Malformed input raises ValueError, which ``files`` turns into an error row.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators.raster import Pack

# ---- tiles ----------------------------------------------------------------------------------------------------------


def nibbles(data: bytes, magic: bytes) -> np.ndarray:
    """[tile, 16] of a packed table, low nibble first; ``magic`` is b"SMF1" for features, b"SME1" for elevation."""
    if len(data) < 8 or data[:4] != magic:
        raise ValueError("bad nibble header")
    n = struct.unpack("<I", data[4:8])[0]
    body = np.frombuffer(data[8:], dtype=np.uint8)
    if len(body) != (n * 16 + 1) // 2:
        raise ValueError("nibble payload size mismatch")
    return np.stack((body & 15, body >> 4), axis=1).reshape(-1)[: n * 16].reshape(n, 16)


def pack_nibbles(values: np.ndarray, magic: bytes) -> bytes:
    v = np.asarray(values, dtype=np.uint8).reshape(-1)
    v = np.append(v, np.zeros(len(v) % 2, dtype=np.uint8))
    return magic + struct.pack("<I", len(values)) + (v[::2] | v[1::2] << 4).tobytes()


def tile_pack(data: bytes) -> Pack:
    if len(data) < 16 or data[:4] != b"TSP1":
        raise ValueError("bad pack header")
    tiles, megas, minis = struct.unpack("<III", data[4:16])
    sizes = (768, tiles * 2, megas * 32, minis * 64)
    if len(data) != 16 + sum(sizes):
        raise ValueError("pack size mismatch")
    at = np.cumsum((16, *sizes))
    part = [data[a:b] for a, b in zip(at, at[1:])]
    u16 = lambda b: np.frombuffer(b, dtype="<u2").astype(int)
    return Pack(np.frombuffer(part[0], dtype=np.uint8).reshape(256, 3), u16(part[1]), u16(part[2]).reshape(-1, 16), np.frombuffer(part[3], dtype=np.uint8).reshape(-1, 8, 8))


def build_pack(cv5: bytes, vx4: bytes, vr4: bytes, wpe: bytes, entry: int = 52, refs: int = 20) -> bytes:
    """A pack from the game's group, megatile, minitile and palette files."""
    if len(wpe) != 1024 or len(vx4) % 64 or len(vr4) % 64:
        raise ValueError("unexpected tileset file size")
    groups = len(cv5) // entry
    table = np.stack([np.frombuffer(cv5[g * entry + refs : g * entry + refs + 32], dtype="<u2") for g in range(groups)]) if groups else np.zeros((0, 16), dtype="<u2")
    mega = (np.frombuffer(vx4, dtype="<u4") & 0xFFFF).astype("<u2")
    palette = np.frombuffer(wpe, dtype=np.uint8).reshape(256, 4)[:, :3]
    return b"TSP1" + struct.pack("<III", table.size, len(vx4) // 64, len(vr4) // 64) + palette.tobytes() + table.astype("<u2").tobytes() + mega.tobytes() + vr4


def elevation_table(cv5: bytes, vf4: bytes, entry: int = 52, refs: int = 20, mid: int = 2, high: int = 4) -> bytes:
    """Elevation nibbles of each tile's minitiles from flag words; high wins over mid."""
    groups = len(cv5) // entry
    mega = np.concatenate([np.frombuffer(cv5[g * entry + refs : g * entry + refs + 32], dtype="<u2") for g in range(groups)]).astype(int) if groups else np.zeros(0, dtype=int)
    flags = np.frombuffer(vf4[: len(vf4) // 2 * 2], dtype="<u2").astype(int)
    at = mega[:, None] * 16 + np.arange(16)
    f = np.where(at < len(flags), flags[np.minimum(at, max(len(flags) - 1, 0))] if len(flags) else 0, 0)
    return pack_nibbles(np.where(f & high, 2, np.where(f & mid, 1, 0)), b"SME1")


# ---- sprites --------------------------------------------------------------------------------------------------------


def sprite(data: bytes, palette: np.ndarray) -> np.ndarray:
    """RGBA of an SPR1 sprite under a palette [256, 3]."""
    if len(data) < 8 or data[:4] != b"SPR1":
        raise ValueError("bad sprite header")
    w, h = struct.unpack("<HH", data[4:8])
    body = np.frombuffer(data[8:], dtype=np.uint8)
    if len(body) != w * h * 2:
        raise ValueError("sprite payload size mismatch")
    index, painted = body.reshape(h, w, 2)[..., 0], body.reshape(h, w, 2)[..., 1] != 0
    return np.where(painted[..., None], np.concatenate((palette[index], np.full((h, w, 1), 255, dtype=np.uint8)), axis=-1), 0).astype(np.uint8)


def pack_sprite(index: np.ndarray, painted: np.ndarray) -> bytes:
    h, w = index.shape
    return b"SPR1" + struct.pack("<HH", w, h) + np.stack((index, painted), axis=-1).astype(np.uint8).tobytes()


def manifest(text: str) -> dict[str, str]:
    return {k.lower(): v for k, v in json.loads(text)["sprites"].items()}


def grp_frame(data: bytes, frame: int = 0, strict: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(index, painted) of a run-length coded GRP frame on the file's canvas.

    A byte with bit 7 skips, with bit 6 repeats the next, else copies; ``strict`` ends a line at a zero byte.
    """
    if len(data) < 6:
        raise ValueError("bad grp")
    frames, w, h = struct.unpack("<HHH", data[:6])
    if not 0 <= frame < frames or len(data) < 6 + frames * 8:
        raise ValueError("bad grp frame table")
    x0, y0, fw, fh, at = struct.unpack("<BBBBI", data[6 + frame * 8 : 14 + frame * 8])
    if not 0 < at < len(data) or at + fh * 2 > len(data):
        raise ValueError("grp frame offset out of range")
    index, painted = np.zeros((h, w), dtype=np.uint8), np.zeros((h, w), dtype=bool)
    for y in range(fh):
        p, x = at + struct.unpack_from("<H", data, at + y * 2)[0], 0
        while x < fw and p < len(data):
            c, p = data[p], p + 1
            if c & 0x80:
                x += c & 0x7F
                continue
            if strict and c == 0:
                break
            if c & 0x40:
                run, values, p = c & 0x3F, data[p : p + 1] * (c & 0x3F), p + 1
            else:
                run, values, p = c, data[p : p + c], p + c
            row, lo = y0 + y, x0 + x
            keep = min(len(values), fw - x, max(w - lo, 0))
            if 0 <= row < h and keep > 0:
                index[row, lo : lo + keep] = np.frombuffer(values[:keep], dtype=np.uint8)
                painted[row, lo : lo + keep] = True
            x += run
    return index, painted


def dds(data: bytes) -> np.ndarray:
    """RGBA of a DDS image with BC1 or BC3 blocks."""
    if len(data) < 128 or data[:4] != b"DDS ":
        raise ValueError("bad dds header")
    h, w = struct.unpack("<II", data[12:20])
    code = data[84:88]
    if code not in (b"DXT1", b"BC1\0", b"DXT5", b"BC3\0"):
        raise ValueError("unsupported dds format")
    wide = code in (b"DXT5", b"BC3\0")
    bw, bh = (w + 3) // 4, (h + 3) // 4
    size = 16 if wide else 8
    if len(data) < 128 + bw * bh * size:
        raise ValueError("dds: truncated pixel data")
    blocks = np.frombuffer(data[128 : 128 + bw * bh * size], dtype=np.uint8).reshape(-1, size).astype(np.int64)
    colour = blocks[:, -8:]
    ends = np.stack((colour[:, 0] | colour[:, 1] << 8, colour[:, 2] | colour[:, 3] << 8), axis=1)
    rgb = np.stack(((ends >> 11) * 255 // 31, (ends >> 5 & 63) * 255 // 63, (ends & 31) * 255 // 31), axis=-1)
    a, b = rgb[:, 0], rgb[:, 1]
    four = (ends[:, 0] > ends[:, 1])[:, None]
    table = np.stack((a, b, np.where(four, (2 * a + b) // 3, (a + b) // 2), np.where(four, (a + 2 * b) // 3, 0)), axis=1)
    bits = colour[:, 4] | colour[:, 5] << 8 | colour[:, 6] << 16 | colour[:, 7] << 24
    pick = bits[:, None] >> (2 * np.arange(16)) & 3
    out = np.zeros((len(blocks), 16, 4), dtype=np.uint8)
    out[..., :3] = np.take_along_axis(table, pick[..., None], axis=1)
    if wide:
        a0, a1 = blocks[:, 0:1], blocks[:, 1:2]
        i7, i5 = np.arange(1, 7), np.arange(1, 5)
        more = np.where(a0 > a1, (a0 * (7 - i7) + a1 * i7) // 7, np.concatenate(((a0 * (5 - i5) + a1 * i5) // 5, np.zeros_like(a0), np.full_like(a0, 255)), axis=1))
        alpha = np.concatenate((a0, a1, more), axis=1)
        word = sum(blocks[:, 2 + k] << (8 * k) for k in range(6))
        out[..., 3] = np.take_along_axis(alpha, word[:, None] >> (3 * np.arange(16)) & 7, axis=1)
    else:
        out[..., 3] = np.where((pick == 3) & ~four, 0, 255)
    return out.reshape(bh, bw, 4, 4, 4).transpose(0, 2, 1, 3, 4).reshape(bh * 4, bw * 4, 4)[:h, :w]


ANIM_ENTRY = np.dtype([("frames", "<u2"), ("ref", "<u2"), ("width", "<u2"), ("height", "<u2"), ("frames_at", "<u4")])
ANIM_LAYER = np.dtype([("at", "<u4"), ("size", "<u4"), ("width", "<u2"), ("height", "<u2")])
ANIM_FRAME = np.dtype([("x", "<u2"), ("y", "<u2"), ("dx", "<i2"), ("dy", "<i2"), ("w", "<u2"), ("h", "<u2"), ("", "V4")])
ANIM_HEAD = np.dtype([("magic", "S4"), ("", "V8"), ("names", "S32", 10), ("entry", ANIM_ENTRY), ("layers", ANIM_LAYER, 10)])


def records(data: bytes, kind: np.dtype, count: int, at: int, what: str) -> np.ndarray:
    """``count`` records of a format at a place of a file."""
    if at < 0 or count < 0 or at + count * kind.itemsize > len(data):
        raise ValueError(f"{what}: the file ends early")
    return np.frombuffer(data, dtype=kind, count=count, offset=at)


def anim(data: bytes) -> dict:
    """Frames (rect, origin) and the diffuse and teamcolor layers of an ANIM container; coordinates are halved."""
    head = records(data, ANIM_HEAD, 1, 0, "anim header")[0]
    entry, places = head["entry"], head["layers"]
    if head["magic"] != b"ANIM" or not entry["frames"]:
        raise ValueError("no ANIM container with frames of its own")
    f = records(data, ANIM_FRAME, int(entry["frames"]), int(entry["frames_at"]), "anim frames")
    f = {k: f[k].astype(int) for k in ("x", "y", "dx", "dy", "w", "h")}
    rects = np.stack((f["x"] // 2, f["y"] // 2, (f["x"] + f["w"]) // 2, (f["y"] + f["h"]) // 2), axis=1)
    # towards zero, as whole-number division of signed values
    origins = np.trunc(np.stack((int(entry["width"]) - 2 * f["dx"], int(entry["height"]) - 2 * f["dy"]), axis=1) / 4).astype(int)
    layers = {}
    for name, place in zip(head["names"].tolist(), places):
        if name in (b"diffuse", b"teamcolor") and place["at"] and place["size"]:
            blob = records(data, np.dtype(np.uint8), int(place["size"]), int(place["at"]), "anim layer").tobytes()
            layers[name.decode()] = dds(blob[max(blob.find(b"DDS "), 0) :])
    if (base := layers.get("diffuse")) is None:
        raise ValueError("an animation without a diffuse layer")
    if layers.get("teamcolor", base).shape != base.shape:
        layers.pop("teamcolor")
    frames = [{"rect": tuple(r), "origin": tuple(o)} for r, o in zip(rects.tolist(), origins.tolist())]
    return {"size": (int(entry["width"]) // 2, int(entry["height"]) // 2), "frames": frames, "layers": layers}


def anim_frame(a: dict, number: int) -> dict:
    """A frame of ``anim`` with its cut-outs of the layers; it must lie within the texture."""
    if not 0 <= number < len(a["frames"]):
        raise ValueError(f"no frame {number}")
    f = a["frames"][number]
    x0, y0, x1, y1 = f["rect"]
    high, wide = a["layers"]["diffuse"].shape[:2]
    if x0 < x1 and y0 < y1 and not (x1 <= wide and y1 <= high):
        raise ValueError(f"frame {number} reaches beyond the texture")
    return f | {"layers": {k: v[y0:y1, x0:x1] for k, v in a["layers"].items()}}


SPRITE_FILE = re.compile(r"^(u(\d+)(?:_([a-z]+))?)\.qoi$")


def sprite_name(path: str) -> tuple[str, int, str] | None:
    """(name, unit id, variant) of a sprite file."""
    m = SPRITE_FILE.match(path.rsplit("/", 1)[-1])
    return (m[1], int(m[2]), m[3] or "") if m else None


# ---- game tables ----------------------------------------------------------------------------------------------------

# Numbers of rows of the game's tables.
UNITS, FLINGIES, SPRITES, IMAGES = 228, 209, 517, 999
DRAW_SHADOW = 10
# Widths in bytes of the operands of the script operations, by code from 0, eight to a line.
SCRIPT_OPERANDS = [
    (2,), (2,), (1,), (1,), (1, 1), (1,), (1, 1), (2,),
    (2, 1, 1), (2, 1, 1), (2,), (2,), (), (2, 1, 1), (2, 1, 1), (2, 1, 1),
    (2, 1, 1), (2, 1, 1), (2,), (2, 1, 1), (2, 1, 1), (2, 1), (), (1,),
    (2,), (), (2, 2), (), (), (), (1, 2), (1,),
    (1,), (), (1,), (1,), (1,), (1,), (), (),
    (1,), (1,), (), (1,), (1,), (), (), (),
    (), (1,), (), (), (1,), (2,), (), (2,),
    (1,), (2,), (2, 2), (2, 2, 2), (2, 2, 2), (1, 1), (), (2,),
    (2,), (1,), (2, 1, 1), (), (),
]
SCRIPT_LISTS = (25, 28)  # a count byte, then so many words
SCRIPT_JUMP, SCRIPT_END, SCRIPT_IMAGE_BELOW = 7, 22, 9
SCRIPT_MOST = 32  # operations looked at


def u16(data: bytes, at: int, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2", count=n, offset=at).astype(int)


def unit_table(data: bytes) -> list[dict]:
    return [{"unit": i, "flingy": data[i], "subunit": int(s)} for i, s in enumerate(u16(data, UNITS, UNITS))]


def first_words(data: bytes, n: int) -> list[int]:
    """The leading column of flingy (sprite) and sprite (image) tables."""
    return u16(data, 0, n).tolist()


def image_table(data: bytes) -> list[dict]:
    """Columnar: 4-byte and 1-byte columns one after another."""
    if len(data) != IMAGES * 38:
        raise ValueError("images table of unexpected size")
    at, cols = 0, []
    for width in (4, 1, 1, 1, 1, 1, 1, 4, 4, 4, 4, 4):
        cols.append(np.frombuffer(data, dtype="<u4" if width == 4 else np.uint8, count=IMAGES, offset=at).astype(int))
        at += IMAGES * width
    return [{"image": i, "grp": int(cols[0][i]), "draw": int(cols[5][i]), "script": int(cols[7][i]), "special": int(cols[11][i])} for i in range(IMAGES)]


def string_table(data: bytes) -> list[str]:
    """Strings from 1; number 0 is empty."""
    n = int(u16(data, 0, 1)[0])
    return ["", *(data[a : data.index(b"\0", a)].decode("latin-1") for a in u16(data, 2, n))]


SCRIPT_ROW = np.dtype([("number", "<i2"), ("at", "<u2")])


def script_start(data: bytes, script: int) -> int:
    """Place of a script's init animation, by the table of scripts, which a negative number closes."""
    table_at = int(records(data, np.dtype("<u4"), 1, 0, "script file")[0])
    rows = records(data, SCRIPT_ROW, max(0, len(data) - table_at) // SCRIPT_ROW.itemsize, table_at, "script table")
    rows = rows[: int(np.argmax(rows["number"] == -1))] if (rows["number"] == -1).any() else rows
    at = rows["at"][rows["number"] == script]
    start = int(records(data, np.dtype("<u2"), 1, int(at[0]) + 8, "script header")[0]) if len(at) else 0
    if not start:
        raise ValueError(f"no init animation of script {script}")
    return start


def script_walk(data: bytes, at: int, most: int = SCRIPT_MOST) -> list[tuple[int, list[int]]]:
    """(code, operands) of a straight run: up to and with a jump or the end, or what cannot be read."""
    out: list[tuple[int, list[int]]] = []
    while len(out) < most and at < len(data) and (code := data[at]) < len(SCRIPT_OPERANDS):
        widths = (1, *(2,) * data[at + 1]) if code in SCRIPT_LISTS and at + 1 < len(data) else SCRIPT_OPERANDS[code]
        ends = np.cumsum((at + 1, *widths)).tolist()
        if ends[-1] > len(data):
            break
        out.append((code, [int.from_bytes(data[a:b], "little") for a, b in zip(ends, ends[1:])]))
        at = len(data) if code in (SCRIPT_JUMP, SCRIPT_END) else ends[-1]
    return out


def shadow_of(script: bytes, images: list[dict], image: int) -> tuple[int, int, int] | None:
    """(shadow image, dx, dy) that an image's init animation attaches below it."""
    try:
        run = script_walk(script, script_start(script, images[image]["script"]))
    except ValueError:
        return None
    below = [args for code, args in run if code == SCRIPT_IMAGE_BELOW and images[args[0]]["draw"] == DRAW_SHADOW]
    return next(((n, *np.array([dx, dy], dtype=np.uint8).view(np.int8).tolist()) for n, dx, dy in below), None)


def lo_offset(data: bytes, frame: int) -> tuple[int, int]:
    if frame >= struct.unpack("<I", data[:4])[0]:
        raise ValueError("LO file has too few frames")
    at = struct.unpack_from("<I", data, 8 + frame * 4)[0]
    return struct.unpack_from("<bb", data, at)


# ---- archives -------------------------------------------------------------------------------------------------------


BLTE_HEAD = np.dtype([("magic", "S4"), ("size", ">u4")])
BLTE_CHUNK = np.dtype([("packed", ">u4"), ("plain", ">u4"), ("sum", "V16")])
INDEX_HEAD = np.dtype([("", "V8"), ("version", "<u2"), ("bucket", "u1"), ("", "V1"), ("fields", "u1", 3), ("bits", "u1"), ("", "V16"), ("size", "<u4"), ("", "V4")])
INDEX_ENTRY = np.dtype([("key", "V9"), ("place", "u1", 5), ("size", "<u4")])
ENCODING_HEAD = np.dtype([("magic", "S2"), ("version", "u1"), ("keys", "u1", 2), ("page_kb", ">u2", 2), ("pages", ">u4", 2), ("", "V1"), ("spec", ">u4")])
INFLATED = 1 << 30  # bytes that a chunk of unstated size may inflate to


def _inflate(body: bytes, size: int | None) -> bytes:
    try:
        return zlib.decompressobj().decompress(body, (INFLATED if size is None else size) + 1)
    except zlib.error as e:
        raise ValueError(f"chunk cannot be inflated: {e}") from e


def blte(data: bytes) -> bytes:
    """The chunks of a container, each raw ("N"), deflated ("Z") or a container again ("F"), of the sizes stated."""
    head = records(data, BLTE_HEAD, 1, 0, "container")[0]
    if head["magic"] != b"BLTE":
        raise ValueError("no BLTE container")
    body = int(head["size"])
    if not body:  # one chunk of unstated size
        return _chunk(data[8:], None)
    flag, *count = records(data, np.dtype("u1"), 4, 8, "chunk table").tolist()
    table = records(data, BLTE_CHUNK, int.from_bytes(bytes(count), "big"), 12, "chunk table")
    ends = body + np.cumsum(np.append(0, table["packed"].astype(np.int64)))
    if flag != 0x0F or 12 + table.nbytes > body or (table["packed"] == 0).any() or ends[-1] > len(data):
        raise ValueError("chunk table does not fit its container")
    return b"".join(_chunk(data[a:b], int(n)) for a, b, n in zip(ends, ends[1:], table["plain"]))


def _chunk(data: bytes, size: int | None) -> bytes:
    decode = {b"N": lambda body: body, b"Z": lambda body: _inflate(body, size), b"F": blte}.get(data[:1])
    if decode is None:
        raise ValueError(f"chunks of kind {data[:1]!r} cannot be read")
    out = decode(data[1:])
    if size not in (None, len(out)):
        raise ValueError(f"chunk of {len(out)} bytes, {size} were stated")
    return out


def index_rows(data: bytes, bucket: int) -> list[tuple[bytes, int, int, int]]:
    """(9-byte key, archive, offset, size) of an index file."""
    head = records(data, INDEX_HEAD, 1, 0, "index")[0]
    if (head["version"], head["bucket"], *head["fields"]) != (7, bucket, 4, 5, 9) or head["size"] % INDEX_ENTRY.itemsize:
        raise ValueError(f"no index of bucket {bucket} in a known version")
    rows = records(data, INDEX_ENTRY, int(head["size"]) // INDEX_ENTRY.itemsize, INDEX_HEAD.itemsize, "index entries")
    place = rows["place"].astype(np.int64) @ (1 << np.arange(32, -1, -8))
    bits = int(head["bits"])
    return list(zip([bytes(k) for k in rows["key"].tolist()], (place >> bits).tolist(), (place & (1 << bits) - 1).tolist(), rows["size"].astype(int).tolist()))


def newest_indexes(names: list[str]) -> dict[int, str]:
    """The newest index file of each bucket."""
    best: dict[int, tuple[int, str]] = {}
    for n in names:
        if re.fullmatch(r"0[0-9a-fA-F][0-9a-fA-F]{8}\.idx", n):
            b = int(n[:2], 16)
            best[b] = max(best.get(b, (-1, "")), (int(n[2:10], 16), n))
    return {b: n for b, (_, n) in best.items()}


def encoding_rows(data: bytes) -> dict[bytes, bytes]:
    """Content key -> first encoded key. A page holds entries of a count, a size, the content key and so many encoded keys."""
    head = records(data, ENCODING_HEAD, 1, 0, "encoding table")[0]
    if head["magic"] != b"EN" or tuple(head["keys"]) != (16, 16) or not head["page_kb"][0]:
        raise ValueError("no encoding table with keys of 16 bytes")
    n, size = int(head["pages"][0]), int(head["page_kb"][0]) * 1024
    first = ENCODING_HEAD.itemsize + int(head["spec"]) + 32 * n  # a text and an index of the pages come before them
    out = {}
    for page in records(data, np.dtype((np.void, size)), n, first, "encoding pages"):
        rest = page.tobytes()
        while len(rest) >= 22 and (keys := rest[0]):
            entry, rest = rest[: 22 + 16 * keys], rest[22 + 16 * keys :]
            if len(entry) < 22 + 16 * keys:
                raise ValueError("an encoding entry leaves its page")
            out[entry[6:22]] = entry[22:38]
    return out


def file_key(name: str) -> str:
    return name.replace("\\", "/").lower()


def root_rows(text: str) -> dict[str, bytes]:
    out = {}
    for line in text.split("\n"):
        name, mark, key = line.rstrip("\r").partition("|")
        if mark and re.fullmatch("[0-9a-fA-F]{32}", key):
            out[file_key(name)] = bytes.fromhex(key)
    if not out:
        raise ValueError("root lists no files")
    return out


def active_build(text: str) -> str:
    """Build key of the first active row of a pipe table whose header cells carry types."""
    lines = text.replace("\r\n", "\n").split("\n")
    head = [c.split("!")[0] for c in lines[0].split("|")]
    if "Build Key" not in head:
        raise ValueError("no Build Key column")
    for line in lines[1:]:
        row = dict(zip(head, line.split("|")))
        if row.get("Build Key") and row.get("Active", "1") == "1":
            return row["Build Key"]
    raise ValueError("no active build")


def build_config(text: str) -> dict[str, str]:
    out = {}
    for line in text.split("\n"):
        name, mark, value = line.strip().partition(" = ")
        if mark and not name.startswith("#"):
            out[name] = value
    for need in ("root", "encoding"):
        if not out.get(need):
            raise ValueError(f"build config has no {need}")
    return out


class Archive:
    """A local content-addressed store: root name -> content key -> encoded key -> place -> checked bytes."""

    def __init__(self, folder: str):
        read = lambda *p: open(os.path.join(folder, *p), "rb").read()  # noqa: E731, SIM115
        self.folder, self.build = folder, active_build(read(".build.info").decode())
        k = self.build
        self.config = build_config(read("Data", "config", k[:2], k[2:4], k).decode())
        data = os.path.join(folder, "Data", "data")
        self.places = {}
        for bucket, name in newest_indexes(os.listdir(data)).items():
            self.places |= {key: rest for key, *rest in index_rows(read("Data", "data", name), bucket)}
        content, encoded = (bytes.fromhex(x) for x in self.config["encoding"].split()[:2])
        table = self._encoded(encoded)
        if hashlib.md5(table).digest() != content:
            raise ValueError("encoding table fails its checksum")
        self.encoding = encoding_rows(table)
        self.root = root_rows(self._content(bytes.fromhex(self.config["root"].split()[0])).decode())

    def _encoded(self, key: bytes) -> bytes:
        archive, at, size = self.places[key[:9]]
        with open(os.path.join(self.folder, "Data", "data", f"data.{archive:03d}"), "rb") as f:
            f.seek(at)
            raw = f.read(size)
        if raw[:16][::-1][:9] != key[:9]:
            raise ValueError("the archive holds another entry")
        return blte(raw[30:])

    def _content(self, key: bytes) -> bytes:
        data = self._encoded(self.encoding[key])
        if hashlib.md5(data).digest() != key:
            raise ValueError("content fails its checksum")
        return data

    def read(self, name: str) -> bytes:
        return self._content(self.root[file_key(name)])


# ---- folders as tables ----------------------------------------------------------------------------------------------


def files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, content) of a folder's files at every depth."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path", "content")


def nibble_rows(content: DataFrame, magic: bytes) -> DataFrame:
    """(path, tile_id, mini, value, error) of nibble files; a bad file is one error row."""
    schema = pa.schema([("path", pa.string()), ("tile_id", pa.int32()), ("mini", pa.int32()), ("value", pa.int16()), ("error", pa.string())])

    def run(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    v = nibbles(data, magic)
                except ValueError as e:
                    yield pa.RecordBatch.from_pylist([{"path": path, "error": str(e)}], schema=schema)
                    continue
                t, m = np.divmod(np.arange(v.size), 16)
                yield pa.RecordBatch.from_arrays([pa.array([path] * v.size), pa.array(t.astype(np.int32)), pa.array(m.astype(np.int32)), pa.array(v.reshape(-1).astype(np.int16)), pa.nulls(v.size, pa.string())], schema=schema)

    return content.mapInArrow(run, "path string, tile_id int, mini int, value short, error string")


def cached_results(spark: SparkSession, folder: str) -> DataFrame:
    """Result documents of a folder, with their file: explicit schema, a broken document fails the read."""
    from tilewright.schema import RESULT

    return spark.read.schema(RESULT).option("mode", "FAILFAST").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder).withColumn("file", F.input_file_name())


def metadata_files(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded replay metadata as JSON lines or Parquet; unreadable lines are dropped, as unreadable replays are."""
    from tilewright.schema import METADATA

    if folder.endswith(".parquet"):
        return spark.read.schema(METADATA).parquet(folder)
    return spark.read.schema(METADATA).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(folder)
