"""Baseline JPEG, whole in numpy: colour transform, block DCT, quantisation, run-length and prefix coding without loops over blocks.

The prefix codes are canonical codes whose lengths follow a rule (longer for longer runs and larger values); they are
written into the file, so every decoder reads them.
"""

from __future__ import annotations

import struct

import numpy as np

# Quantisation of luminance and chrominance at quality 50, row by row.
LUMA = """16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"""
CHROMA = "17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99 " + "99 " * 32
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_k = np.arange(8)
DCT = np.where(_k[:, None] == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16))
DC_LENGTHS = {s: n for s, n in enumerate((2, 3, 3, 3, 3, 3, 4, 5, 6, 7, 8, 9))}
AC_LENGTHS = {0x00: 2, 0xF0: 8} | {run << 4 | size: min(16, 2 + run + size) for run in range(16) for size in range(1, 11)}


def quant(table: str, quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table.split(), dtype=int) * scale + 50) // 100, 1, 255)


def canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(code of each symbol, its length, the table as stored)."""
    code, size, nxt, last, order = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64), 0, 0, sorted(lengths, key=lambda s: (lengths[s], s))
    for s in order:
        nxt <<= lengths[s] - last
        last = lengths[s]
        code[s], size[s] = nxt, last
        nxt += 1
    return code, size, bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)) + bytes(order)


def _bits_of(v: np.ndarray) -> np.ndarray:
    """Bits of the absolute value."""
    return np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)


def encode(image: np.ndarray, quality: int = 85) -> bytes:
    """JPEG of an RGB or RGBA image (alpha is dropped)."""
    if not 1 <= quality <= 100:
        raise ValueError(f"invalid quality {quality}")
    h, w = image.shape[:2]
    if not h or not w or h > 65535 or w > 65535:
        raise ValueError("invalid image size")
    rgb = np.pad(image[..., :3].astype(float), ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    planes = (0.299 * r + 0.587 * g + 0.114 * b - 128, -0.168736 * r - 0.331264 * g + 0.5 * b, 0.5 * r - 0.418688 * g - 0.081312 * b)
    tables = (quant(LUMA, quality), quant(CHROMA, quality))
    rows, cols = rgb.shape[0] // 8, rgb.shape[1] // 8
    parts = []
    for k, plane in enumerate(planes):
        blocks = plane.reshape(rows, 8, cols, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        z = np.rint((DCT @ blocks @ DCT.T).reshape(-1, 64) / tables[min(k, 1)]).astype(np.int64)[:, ZIGZAG]
        z[:, 1:] = np.clip(z[:, 1:], -1023, 1023)
        parts.append(z)
    z = np.stack(parts, axis=1).reshape(-1, 64)  # the three blocks of a place follow one another
    dc = np.concatenate([p[:, :1] - np.concatenate((np.zeros((1, 1), dtype=np.int64), p[:-1, :1])) for p in parts], axis=1).reshape(-1)
    dc_code, dc_size, dc_table = canonical(DC_LENGTHS)
    ac_code, ac_size, ac_table = canonical(AC_LENGTHS)

    def amplitude(v, n):
        return np.where(v < 0, v + (np.int64(1) << n) - 1, v)

    n = _bits_of(dc)
    code = [dc_code[n] << n | amplitude(dc, n)]
    size = [dc_size[n] + n]
    key = [np.arange(len(z)) * 256]
    block, at = np.nonzero(z[:, 1:])
    at = at + 1
    before = np.where(np.concatenate(([True], block[1:] != block[:-1])), 0, np.concatenate(([0], at[:-1]))) if len(block) else at
    run, v = at - before - 1, z[block, at]
    n = _bits_of(v)
    symbol = (run % 16) << 4 | n
    code.append(ac_code[symbol] << n | amplitude(v, n))
    size.append(ac_size[symbol] + n)
    key.append(block * 256 + at * 2 + 1)
    long_ = np.repeat(np.arange(len(run)), run // 16)  # sixteen zeros at a time
    code.append(np.full(len(long_), ac_code[0xF0]))
    size.append(np.full(len(long_), ac_size[0xF0]))
    key.append((block * 256 + at * 2)[long_])
    ends = np.flatnonzero(z[:, 63] == 0)
    code.append(np.full(len(ends), ac_code[0]))
    size.append(np.full(len(ends), ac_size[0]))
    key.append(ends * 256 + 255)
    order = np.argsort(np.concatenate(key), kind="stable")
    code, size = np.concatenate(code)[order], np.concatenate(size)[order]
    start = np.cumsum(size) - size
    bits = np.ones(-(-int(size.sum()) // 8) * 8, dtype=np.uint8)
    for k in range(int(size.max())):
        more = size > k
        bits[start[more] + k] = code[more] >> (size[more] - 1 - k) & 1
    data = np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")
    seg = lambda mark, body: bytes((0xFF, mark)) + struct.pack(">H", len(body) + 2) + body
    return (
        b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + b"".join(seg(0xDB, bytes((i,)) + bytes(t[ZIGZAG].tolist())) for i, t in enumerate(tables))
        + seg(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes((1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1)))
        + seg(0xC4, b"\x00" + dc_table) + seg(0xC4, b"\x10" + ac_table) + seg(0xDA, bytes((3, 1, 0, 2, 0, 3, 0, 0, 63, 0))) + data + b"\xff\xd9"
    )
