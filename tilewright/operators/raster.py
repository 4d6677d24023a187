"""Raster operators: tile rendering, sprites, blending, overlays, tinting, and the image codecs PNG and QOI.

Images are numpy arrays [row, column, channel]; kernels run per map or per file inside Arrow batches.
"""

from __future__ import annotations

import math
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

from tilewright import constants as K


# ---- codecs ---------------------------------------------------------------------------------------------------------


def png(image: np.ndarray, level: int = 1) -> bytes:
    """PNG of a grey [h, w], RGB [h, w, 3] or RGBA [h, w, 4] image; level 1 is fastest, 9 smallest."""
    a = np.ascontiguousarray(image, dtype=np.uint8)
    kind = {2: 0, 3: {3: 2, 4: 6}.get(a.shape[-1])}[a.ndim]
    h, w = a.shape[:2]
    rows = np.concatenate((np.zeros((h, 1), dtype=np.uint8), a.reshape(h, -1)), axis=1)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """An 8-bit PNG without interlacing, any filter."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, head = 8, b"", None
    while at < len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            packed += body
        at += 12 + n
    w, h, depth, kind, _, _, interlaced = head
    if depth != 8 or interlaced or kind not in (0, 2, 6):
        raise ValueError("unsupported PNG")
    c = {0: 1, 2: 3, 6: 4}[kind]
    raw = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h, w * c), dtype=np.uint8)
    for y in range(h):
        mode, line = raw[y, 0], raw[y, 1:].astype(int)
        up = out[y - 1].astype(int) if y else np.zeros(w * c, dtype=int)
        if mode in (0, 2):
            out[y] = (line + (up if mode == 2 else 0)) & 255
            continue
        row = [0] * (w * c)
        for i in range(w * c):
            left, corner = (row[i - c], int(up[i - c])) if i >= c else (0, 0)
            above = int(up[i])
            if mode == 1:
                guess = left
            elif mode == 3:
                guess = (left + above) // 2
            else:
                p = left + above - corner
                guess = min((abs(p - left), 0, left), (abs(p - above), 1, above), (abs(p - corner), 2, corner))[2]
            row[i] = (int(line[i]) + guess) & 255
        out[y] = row
    return out.reshape(h, w) if c == 1 else out.reshape(h, w, c)


def _slot(r, g, b, a) -> int:
    return (r * 3 + g * 5 + b * 7 + a * 11) & 255 & 63


def qoi(image: np.ndarray) -> bytes:
    """QOI of an RGBA image."""
    h, w = image.shape[:2]
    if w <= 0 or h <= 0 or image.ndim != 3 or image.shape[2] != 4:
        raise ValueError("qoi: invalid dimensions")
    out = bytearray(b"qoif" + struct.pack(">IIBB", w, h, 4, 0))
    seen: list = [(0, 0, 0, 0)] * 64
    last, run = (0, 0, 0, 255), 0
    for px in map(tuple, image.reshape(-1, 4).tolist()):
        if px == last:
            run += 1
            if run == 62:
                out.append(0xC0 | 61)
                run = 0
            continue
        if run:
            out.append(0xC0 | (run - 1))
            run = 0
        k = _slot(*px)
        if seen[k] == px:
            out.append(k)
        else:
            seen[k] = px
            r, g, b = ((px[i] - last[i] + 128) % 256 - 128 if abs(px[i] - last[i]) > 255 else px[i] - last[i] for i in range(3))
            if px[3] != last[3]:
                out += bytes((0xFF, *px))
            elif -3 < r < 2 and -3 < g < 2 and -3 < b < 2:
                out.append(0x40 | (r + 2) << 4 | (g + 2) << 2 | (b + 2))
            elif -33 < g < 32 and -9 < r - g < 8 and -9 < b - g < 8:
                out += bytes((0x80 | (g + 32), (r - g + 8) << 4 | (b - g + 8)))
            else:
                out += bytes((0xFE, *px[:3]))
        last = px
    if run:
        out.append(0xC0 | (run - 1))
    return bytes(out) + b"\0\0\0\0\0\0\0\1"


def read_qoi(data: bytes) -> np.ndarray:
    if len(data) < 22 or data[:4] != b"qoif":
        raise ValueError("qoi: bad header")
    w, h, channels, _ = struct.unpack(">IIBB", data[4:14])
    if channels not in (3, 4) or not w or not h:
        raise ValueError("qoi: unsupported")
    seen: list = [(0, 0, 0, 0)] * 64
    px, out, p, end = (0, 0, 0, 255), [], 14, len(data) - 8
    n = w * h
    while len(out) < n:
        if p >= end:
            raise ValueError("qoi: truncated stream")
        b = data[p]
        p += 1
        if b == 0xFE:
            px, p = (*data[p : p + 3], px[3]), p + 3
        elif b == 0xFF:
            px, p = tuple(data[p : p + 4]), p + 4
        elif b >> 6 == 0:
            px = seen[b]
        elif b >> 6 == 1:
            px = ((px[0] + (b >> 4 & 3) - 2) & 255, (px[1] + (b >> 2 & 3) - 2) & 255, (px[2] + (b & 3) - 2) & 255, px[3])
        elif b >> 6 == 2:
            g = (b & 63) - 32
            px, p = ((px[0] + g - 8 + (data[p] >> 4)) & 255, (px[1] + g) & 255, (px[2] + g - 8 + (data[p] & 15)) & 255, px[3]), p + 1
        else:
            out += [px] * (b & 63)
        seen[_slot(*px)] = px
        out.append(px)
    return np.array(out[:n], dtype=np.uint8).reshape(h, w, 4)


# ---- tiles and sprites ----------------------------------------------------------------------------------------------


@dataclass
class Pack:
    """Palette [256, 3]; megatile of each tile; minitile references [megatile, 16]; minitiles [minitile, 8, 8]."""

    palette: np.ndarray
    tile_megatile: np.ndarray
    megatiles: np.ndarray
    minitiles: np.ndarray


def inside_map(width: int, height: int, x: int, y: int, w: int, h: int) -> bool:
    return w > 0 and h > 0 and x >= 0 and y >= 0 and x + w <= width and y + h <= height


def render_indices(pack: Pack, width: int, height: int, tiles: np.ndarray, rect=None) -> np.ndarray:
    """Palette indices of a map or of a rectangle of its tiles: 32 pixels a tile; bad references stay 0."""
    if len(tiles) != width * height:
        raise ValueError("tiles length mismatch")
    x, y, w, h = rect or (0, 0, width, height)
    if not inside_map(width, height, x, y, w, h):
        raise ValueError("tile rect out of map bounds")
    t = np.asarray(tiles).reshape(height, width)[y : y + h, x : x + w]
    ok = t < len(pack.tile_megatile)
    mega = np.where(ok, pack.tile_megatile[np.where(ok, t, 0)] if len(pack.tile_megatile) else 0, 0)
    ok &= mega < len(pack.megatiles)
    refs = pack.megatiles[np.where(ok, mega, 0)] if len(pack.megatiles) else np.zeros((*t.shape, 16), dtype=int)
    mini = refs >> 1
    good = ok[..., None] & (mini < len(pack.minitiles))
    art = pack.minitiles[np.where(good, mini, 0)] if len(pack.minitiles) else np.zeros((*mini.shape, 8, 8), dtype=np.uint8)
    art = np.where((refs & 1).astype(bool)[..., None, None], art[..., ::-1], art)
    art = np.where(good[..., None, None], art, 0)
    return art.reshape(h, w, 4, 4, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(h * 32, w * 32).astype(np.uint8)


def coloured(indices: np.ndarray, palette: np.ndarray) -> np.ndarray:
    rgb = palette[indices]
    return np.concatenate((rgb, np.full((*indices.shape, 1), 255, dtype=np.uint8)), axis=-1)


def over(canvas: np.ndarray, sprite: np.ndarray, x: int, y: int) -> None:
    """Draw an RGBA sprite, clipped to the canvas; whole numbers, premultiplied as stored."""
    h, w = sprite.shape[:2]
    y0, y1, x0, x1 = max(y, 0), min(y + h, canvas.shape[0]), max(x, 0), min(x + w, canvas.shape[1])
    if y0 >= y1 or x0 >= x1:
        return
    s = sprite[y0 - y : y1 - y, x0 - x : x1 - x].astype(int)
    d = canvas[y0:y1, x0:x1].astype(int)
    canvas[y0:y1, x0:x1] = s + d * (255 - s[..., 3:4]) // 255


@dataclass
class Layers:
    """What to draw: terrain, resources with their shadows."""

    terrain: bool = True
    resources: bool = False
    shadows: bool = False
    sprites: dict = field(default_factory=dict)


def render(pack: Pack, width, height, tiles, minerals=(), geysers=(), layers: Layers | None = None, rect=None) -> np.ndarray:
    """RGBA of a rectangle of a map. Minerals cycle through their sprites by index, then geysers are drawn."""
    layers = layers or Layers()
    x, y, w, h = rect or (0, 0, width, height)
    if not inside_map(width, height, x, y, w, h):
        raise ValueError("tile rect out of map bounds")
    if layers.terrain:
        canvas = coloured(render_indices(pack, width, height, tiles, (x, y, w, h)), pack.palette)
    else:
        canvas = np.zeros((h * 32, w * 32, 4), dtype=np.uint8)
    if not layers.resources:
        return canvas
    placed = [(K.MINERAL_SPRITES[i % len(K.MINERAL_SPRITES)], p) for i, p in enumerate(minerals)] + [(K.GEYSER_SPRITE, p) for p in geysers]
    for shadow in (True, False) if layers.shadows else (False,):
        for name, (px, py) in placed:
            art = layers.sprites.get(f"{name}:shadow" if shadow else name)
            if art is None:
                continue
            if shadow:
                art = np.where(art[..., 3:4] > 0, np.array([0, 0, 0, K.RESOURCE_SHADOW_ALPHA], dtype=np.uint8), art)
            over(canvas, art, px - art.shape[1] // 2 - x * 32, py - art.shape[0] // 2 - y * 32)
    return canvas


def downsample_factor(w: int, h: int, most: int) -> int:
    f = 1
    while max(w, h) // f > most:
        f *= 2
    return f


def box_downsample(image: np.ndarray, f: int) -> np.ndarray:
    """Box averages in whole numbers; rows and columns that fill no box are dropped."""
    h, w = image.shape[0] // f, image.shape[1] // f
    boxes = image[: h * f, : w * f].reshape(h, f, w, f, -1).sum(axis=(1, 3), dtype=np.uint32) // (f * f)
    return boxes.astype(np.uint8).reshape(h, w, *image.shape[2:])


def tint(image: np.ndarray, mask: np.ndarray, team) -> np.ndarray:
    """Team colour under a mask: twice the colour times the grey below."""
    d, m, t = image[..., :3].astype(int), mask[..., None].astype(int), np.array(team, dtype=int)
    out = image.copy()
    out[..., :3] = (d * (255 - m) + np.minimum(255, d * t * 2 // 255) * m) // 255
    return out


def shadow_image(coverage: np.ndarray) -> np.ndarray:
    out = np.zeros((*coverage.shape, 4), dtype=np.uint8)
    out[..., 3] = (coverage * K.SHADOW_OPACITY + 0.5).astype(int)
    return out


def composite(layers: list[tuple[np.ndarray, np.ndarray | None, int, int]], trim: int = 8):
    """Layers (RGBA, team mask, x, y) from bottom to top: (image, mask, anchor of the origin), trimmed by alpha."""
    x0, y0 = min(l[2] for l in layers), min(l[3] for l in layers)
    x1, y1 = max(l[2] + l[0].shape[1] for l in layers), max(l[3] + l[0].shape[0] for l in layers)
    rgba, team = np.zeros((y1 - y0, x1 - x0, 4)), np.zeros((y1 - y0, x1 - x0))
    for art, mask, x, y in layers:
        part = np.s_[y - y0 : y - y0 + art.shape[0], x - x0 : x - x0 + art.shape[1]]
        a = art[..., 3] / 255.0
        below = rgba[part]
        alpha = a + below[..., 3] * (1 - a)
        safe = np.where(alpha > 0, alpha, 1)[..., None]
        rgb = (art[..., :3] * a[..., None] + below[..., :3] * (below[..., 3] * (1 - a))[..., None]) / safe
        rgba[part] = np.concatenate((rgb, alpha[..., None]), axis=-1)
        team[part] = (mask if mask is not None else np.zeros(a.shape)) * a + team[part] * (1 - a)
    image = np.concatenate((rgba[..., :3], rgba[..., 3:] * 255), axis=-1)
    image = (image + 0.5).astype(np.uint8)
    ys, xs = np.nonzero(image[..., 3] >= trim)
    if not len(ys):
        return image, team.astype(np.uint8), (-x0, -y0)
    cut = np.s_[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
    return image[cut], (team[cut] + 0.5).astype(np.uint8), (-x0 - int(xs.min()), -y0 - int(ys.min()))


def locate(atlas: np.ndarray, want: np.ndarray, rects) -> tuple[int, int, int] | None:
    """(frame, x, y) at which a crop lies in an atlas: the first by frame, row, column. Transparent pixels match by alpha."""
    h, w = want.shape[:2]
    solid = want[..., 3] > 0
    for f, (x0, y0, x1, y1) in enumerate(rects):
        if y1 - y0 < h or x1 - x0 < w:
            continue
        windows = np.lib.stride_tricks.sliding_window_view(atlas[y0:y1, x0:x1], (h, w), axis=(0, 1))
        ok = (windows[:, :, 3] == want[..., 3]).all(axis=(-1, -2))
        for c in range(3):
            ok &= ((windows[:, :, c] == want[..., c]) | ~solid).all(axis=(-1, -2))
        hits = np.argwhere(ok)
        if len(hits):
            return f, x0 + int(hits[0][1]), y0 + int(hits[0][0])
    return None


# ---- creep ----------------------------------------------------------------------------------------------------------

# Neighbour bits (0 SE, 1 S, 2 SW, 3 E, 4 W, 5 NE, 6 N, 7 NW) that must all be set, and the code bits they give.
CREEP_RULES = ((0x02, 0x10), (0x08, 0x24), (0x10, 0x09), (0x40, 0x02), (0xC0, 0x01), (0x60, 0x04), (0x03, 0x20), (0x06, 0x08))
CREEP_JOINED = (0x21, 0x0C)  # code bits that together add 0x40


def creep_frames() -> np.ndarray:
    """Edge frame of each of the 256 neighbourhoods: dense rank of its code."""
    n = np.arange(256)
    code = np.zeros(256, dtype=int)
    for need, bits in CREEP_RULES:
        code |= np.where(n & need == need, bits, 0)
    code |= np.where(np.logical_or.reduce([code & j == j for j in CREEP_JOINED]), 0x40, 0)
    return np.unique(code, return_inverse=True)[1]


def creep_texture(pack: Pack) -> np.ndarray:
    """The creep ground: the first sixteen slots of tile group 1 as 4 by 4 tiles."""
    return render_indices(pack, 4, 4, np.arange(16) + 16)


# ---- overlays -------------------------------------------------------------------------------------------------------

START, NATURAL, OTHER, STROKE = (0, 230, 255, 120), (150, 255, 0, 120), (255, 140, 0, 120), (255, 255, 255, 230)
CHOKE_OPEN, CHOKE_LINKED, BLACK = (255, 60, 200, 255), (255, 235, 0, 255), (0, 0, 0, 255)


def blend(canvas: np.ndarray, where: np.ndarray, colour) -> None:
    """Source over the canvas at a mask of pixels, truncated; the result is opaque."""
    a = colour[3] / 255.0
    old = canvas[where][:, :3].astype(float)
    canvas[where] = np.concatenate(((np.array(colour[:3]) * a + old * (1 - a)).astype(np.uint8), np.full((len(old), 1), 255, dtype=np.uint8)), axis=1)


def edges_of(n: int, step: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pixel spans of n cells of a step, each at least one pixel, clipped."""
    at = (step * np.arange(n + 1) + 0.5).astype(int)
    return np.minimum(at[:-1], most), np.minimum(np.maximum(at[1:], at[:-1] + 1), most)


def draw_mask(canvas: np.ndarray, mask: np.ndarray, w: int, h: int, fill, stroke=None) -> None:
    """Paint a mask's cells, then stroke the sides at which it ends."""
    m = mask.reshape(h, w)
    (x0, x1), (y0, y1) = edges_of(w, canvas.shape[1] / w, canvas.shape[1]), edges_of(h, canvas.shape[0] / h, canvas.shape[0])
    wide = np.repeat(np.repeat(m, y1 - y0, axis=0), x1 - x0, axis=1)
    full = np.zeros(canvas.shape[:2], dtype=bool)
    full[: wide.shape[0], : wide.shape[1]] = wide
    blend(canvas, full, fill)
    if stroke is None:
        return
    p = np.pad(m, 1)
    for dy, dx in ((0, -1), (0, 1), (-1, 0), (1, 0)):
        line = np.zeros(canvas.shape[:2], dtype=bool)
        for y, x in np.argwhere(m & ~p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]):
            ys = slice(y0[y], y1[y]) if dy == 0 else (y0[y] if dy < 0 else y1[y] - 1)
            xs = slice(x0[x], x1[x]) if dx == 0 else (x0[x] if dx < 0 else x1[x] - 1)
            line[ys, xs] = True
        blend(canvas, line, stroke)


def thick_line(canvas: np.ndarray, a, b, thick: float, colour) -> None:
    """All pixels whose centre lies within half the thickness of a segment."""
    x0, x1 = max(0, math.floor(min(a[0], b[0]) - thick)), min(canvas.shape[1], math.ceil(max(a[0], b[0]) + thick) + 1)
    y0, y1 = max(0, math.floor(min(a[1], b[1]) - thick)), min(canvas.shape[0], math.ceil(max(a[1], b[1]) + thick) + 1)
    if x0 >= x1 or y0 >= y1:
        return
    py, px = np.mgrid[y0:y1, x0:x1] + 0.5
    dx, dy = b[0] - a[0], b[1] - a[1]
    l2 = dx * dx + dy * dy
    t = np.clip(((px - a[0]) * dx + (py - a[1]) * dy) / l2, 0, 1) if l2 else 0.0
    where = np.zeros(canvas.shape[:2], dtype=bool)
    where[y0:y1, x0:x1] = np.hypot(px - a[0] - t * dx, py - a[1] - t * dy) <= thick / 2
    blend(canvas, where, colour)


def base_shapes(terrain: np.ndarray, bases: list[dict], owner: np.ndarray, w: int, h: int, scale: int = 1, chokes: bool = True) -> np.ndarray:
    """Base regions over the terrain at ``scale`` pixels a minitile, with their chokes."""
    rows = (np.arange(h * scale) * terrain.shape[0] // (h * scale)).astype(int)
    cols = (np.arange(w * scale) * terrain.shape[1] // (w * scale)).astype(int)
    canvas = terrain[rows][:, cols].copy()
    for i, b in enumerate(bases):
        fill = START if b["kind"] == "start" else NATURAL if b["name"].startswith("natural") else OTHER
        draw_mask(canvas, owner == i, w, h, fill, STROKE)
    if chokes:
        for b in bases:
            for c in b["chokes"] or []:
                ends = [((p["x"] + 0.5) * scale, (p["y"] + 0.5) * scale) for p in c["ends"]]
                thick_line(canvas, *ends, scale * 2.6, BLACK)
                thick_line(canvas, *ends, scale * 1.6, CHOKE_LINKED if c["connects_to"] else CHOKE_OPEN)
    return canvas


def replay_overlay(base: np.ndarray, grid, bases, owner, links) -> np.ndarray:
    """Debug picture: walls, ramps, base regions, walking paths to naturals, chokes."""
    canvas = base.copy()
    draw_mask(canvas, ~grid.passable, grid.w, grid.h, (255, 0, 0, 70))
    draw_mask(canvas, grid.ramp, grid.w, grid.h, (0, 0, 255, 90))
    step = canvas.shape[1] / grid.w
    for i, b in enumerate(bases):
        draw_mask(canvas, owner == i, grid.w, grid.h, START if b["kind"] == "start" else NATURAL if b["kind"] == "natural" else OTHER, STROKE)
    for *_, path in links:
        mask = np.zeros(grid.w * grid.h, dtype=bool)
        mask[path] = True
        draw_mask(canvas, mask, grid.w, grid.h, (255, 255, 255, 200))
    for b in bases:
        for c in b["chokes"] or []:
            ends = [((p["x"] + 0.5) * step, (p["y"] + 0.5) * step) for p in c["ends"]]
            thick_line(canvas, *ends, step * 1.6, CHOKE_LINKED if c["connects_to"] else CHOKE_OPEN)
    return canvas


def mask_centroid(mask: np.ndarray, w: int) -> tuple[float, float] | None:
    cells = np.flatnonzero(mask)
    return (float((cells % w + 0.5).mean()), float((cells // w + 0.5).mean())) if len(cells) else None


def label_scale(vertices, step: float, text: str) -> int:
    """Text scale that fills a polygon's width: 7 pixels a letter, between 2 and 10, 5 where there is nothing to fit."""
    if not vertices or not text:
        return 5
    wide = (max(v[0] for v in vertices) - min(v[0] for v in vertices)) * step
    return min(10, max(2, int(wide * 0.85 / (7 * len(text))))) if wide > 0 else 5
