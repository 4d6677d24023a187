"""Outlines of masks: boundary walk over cell corners, then closed line simplification."""

from __future__ import annotations

import math

import numpy as np

from tilewright import constants as K
from tilewright.operators.terrain import largest_component

Point = tuple[int, int]


def boundary(w: int, h: int, mask: np.ndarray) -> list[Point]:
    """Corners of the outer boundary of a connected mask, clockwise (y down), from its first cell.

    Each boundary side is a directed edge with the mask on its right; where two leave a corner, the right turn is taken.
    """
    m = np.pad(np.asarray(mask, dtype=bool).reshape(h, w), 1)
    inside = m[1:-1, 1:-1]
    follow: dict[Point, dict[int, Point]] = {}
    for direction, outer, start, step in (
        (0, m[:-2, 1:-1], (0, 0), (1, 0)), (1, m[1:-1, 2:], (1, 0), (0, 1)), (2, m[2:, 1:-1], (1, 1), (-1, 0)), (3, m[1:-1, :-2], (0, 1), (0, -1)),
    ):
        for y, x in np.argwhere(inside & ~outer):
            p = (int(x) + start[0], int(y) + start[1])
            follow.setdefault(p, {})[direction] = (p[0] + step[0], p[1] + step[1])
    y, x = (int(v) for v in np.argwhere(inside)[0])
    at, direction, corners = (x, y), 0, []
    first = at
    while True:
        nxt = follow[at][direction]
        if nxt == first and direction == 3:
            corners.append(nxt)
            break
        turn = next(t for t in (1, 0, 3) if (direction + t) % 4 in follow[nxt])
        if turn:
            corners.append(nxt)
        at, direction = nxt, (direction + turn) % 4
    return corners[-1:] + corners[:-1]


def segment_distance(p: Point, a: Point, b: Point) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    l2 = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / l2)) if l2 else 0.0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def simplify_line(points: list[Point], epsilon: float) -> list[Point]:
    """Douglas-Peucker with an explicit stack; the first of several farthest points splits."""
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        lo, hi = stack.pop()
        if hi - lo < 2:
            continue
        far = max(range(lo + 1, hi), key=lambda i: (segment_distance(points[i], points[lo], points[hi]), -i))
        if segment_distance(points[far], points[lo], points[hi]) > epsilon:
            keep.add(far)
            stack += [(lo, far), (far, hi)]
    return [points[i] for i in sorted(keep)]


def simplify_closed(points: list[Point], epsilon: float = K.OUTLINE_EPSILON) -> list[Point]:
    """A closed line, cut at its first point and the one farthest from it."""
    if len(points) < 4:
        return points
    far = max(range(len(points)), key=lambda i: (math.hypot(points[i][0] - points[0][0], points[i][1] - points[0][1]), -i))
    return simplify_line(points[: far + 1], epsilon)[:-1] + simplify_line([*points[far:], points[0]], epsilon)[:-1]


def outline(w: int, h: int, mask: np.ndarray) -> list[Point] | None:
    """Simplified outline of the largest component; None of an empty mask."""
    part = largest_component(w, h, mask)
    return None if part is None else simplify_closed(boundary(w, h, part))


def inside(px, py, polygon: list[Point]) -> np.ndarray:
    """Even-odd test of many points."""
    px, py = np.asarray(px, dtype=float), np.asarray(py, dtype=float)
    out = np.zeros(px.shape, dtype=bool)
    for (x0, y0), (x1, y1) in zip(polygon, polygon[1:] + polygon[:1]):
        if y0 != y1:
            out ^= ((y0 > py) != (y1 > py)) & (px < (x1 - x0) * (py - y0) / (y1 - y0) + x0)
    return out


def iou(a: list[Point], b: list[Point]) -> float:
    """Overlap of two polygons by cell centres over their common box; two empty ones do not overlap."""
    every = [*a, *b]
    if not every:
        return 0.0
    x0, y0 = min(p[0] for p in every), min(p[1] for p in every)
    x1, y1 = max(p[0] for p in every), max(p[1] for p in every)
    y, x = np.mgrid[y0 : y1 + 1, x0 : x1 + 1] + 0.5
    ia = inside(x, y, a) if a else np.zeros(x.shape, dtype=bool)
    ib = inside(x, y, b) if b else np.zeros(x.shape, dtype=bool)
    union = int((ia | ib).sum())
    return float((ia & ib).sum() / union) if union else 0.0
