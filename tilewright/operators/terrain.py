"""Minitile grids: expansion of tiles, altitude, watershed areas, walking distances.

Grids are flat row-major arrays; a kernel sees one map at a time, so no cell is ever shuffled.
"""

from __future__ import annotations

import numpy as np

from tilewright import constants as K

FOUR = ((1, 0), (-1, 0), (0, 1), (0, -1))


class Grid:
    """Features and elevation of a map in minitiles."""

    def __init__(self, w: int, h: int, feat: np.ndarray, elev: np.ndarray | None = None):
        self.w, self.h = w, h
        self.feat = np.asarray(feat, dtype=np.uint8) & 15
        self.elev = np.zeros(w * h, dtype=np.uint8) if elev is None else np.asarray(elev, dtype=np.uint8)
        self.passable = (self.feat & (K.WALK | K.RAMP)) != 0
        self.ramp = (self.feat & K.RAMP) != 0


def expand(width: int, height: int, tiles: np.ndarray, feat: np.ndarray, elev: np.ndarray) -> Grid:
    """Each tile's 4 by 4 minitiles by lookup ``feat[tile, mini]``; unknown tiles are feature 0, elevation 0."""
    if width <= 0 or height <= 0:
        raise ValueError("invalid map dimensions")
    if len(tiles) != width * height:
        raise ValueError("tile grid mismatch")
    known = (tiles >= 0) & (tiles < len(feat))
    at = np.where(known, tiles, 0)
    spread = lambda table: np.where(known[:, None], table[at], 0).reshape(height, width, 4, 4).transpose(0, 2, 1, 3).reshape(-1)
    return Grid(width * 4, height * 4, spread(feat), spread(elev))


def altitude(w: int, h: int, passable: np.ndarray) -> np.ndarray:
    """Chamfer distance to the nearest blocked cell or the outside, in single precision.

    The contribution of the row before is vectorised; only the step along the row is sequential.
    """
    one, diagonal = np.float32(1), np.float32(np.sqrt(2.0))
    ok = passable.reshape(h, w)
    out = np.where(ok, np.float32(3e38), np.float32(0)).astype(np.float32)

    def sweep(grid, mask):
        before = np.zeros(w + 2, dtype=np.float32)
        for y in range(h):
            row = np.minimum(grid[y], np.minimum(before[1:-1] + one, np.minimum(before[:-2], before[2:]) + diagonal))
            row = np.where(mask[y], row, np.float32(0))
            left, values = np.float32(0), list(row)
            for x, v in enumerate(values):
                step = left + one
                if step < v:
                    v = values[x] = step
                left = v
            grid[y] = values
            before[1:-1] = grid[y]

    sweep(out, ok)
    flipped = out[::-1, ::-1].copy()
    sweep(flipped, ok[::-1, ::-1])
    return flipped[::-1, ::-1].reshape(-1).copy()


class Areas:
    """Watershed areas of a grid: area of each cell (-1 on walls) and the frontier cells between areas."""

    def __init__(self, grid: Grid):
        self.grid = grid
        self.altitude = altitude(grid.w, grid.h, grid.passable)
        self.area, self.count, self.frontier = flood(grid, self.altitude)


def flood(grid: Grid, alt: np.ndarray):
    """Areas flooded from the widest open ground downwards.

    A cell joins the neighbouring flood of its own elevation, else the largest. Where floods meet, a tiny one, or one on
    the same elevation seen through an opening nearly as wide as its widest point, is swallowed; otherwise the cell is frontier.
    Returns (area per cell, number of areas, [(cell, area a, area b)], a < b).
    """
    w, n = grid.w, grid.w * grid.h
    cells = np.flatnonzero(grid.passable)
    order = cells[np.lexsort((cells, -alt[cells]))].tolist()
    height, elevation = alt.tolist(), grid.elev.tolist()
    flood_of = [-1] * n
    up: list[int] = []
    size: list[int] = []
    peak: list[float] = []
    level: list[int] = []
    meets: list[tuple[int, int, int]] = []

    def root(f):
        while up[f] != f:
            up[f] = up[up[f]]
            f = up[f]
        return f

    last_row = n - w
    for c in order:
        near: list[int] = []
        x = c % w
        for ok, other in ((x + 1 < w, c + 1), (x > 0, c - 1), (c < last_row, c + w), (c >= w, c - w)):
            if ok and flood_of[other] >= 0:
                r = root(flood_of[other])
                if r not in near:
                    near.append(r)
        a, e = height[c], elevation[c]
        if not near:
            near = [len(up)]
            up.append(near[0])
            size.append(0)
            peak.append(a)
            level.append(e)
        elif len(near) > 1:
            near.sort(key=lambda f: (level[f] != e, -size[f]))
        here = near[0]
        for other in near[1:]:
            other, here = root(other), root(here)
            if other == here:
                continue
            low, big = (other, here) if size[other] <= size[here] else (here, other)
            tiny = size[low] < K.MERGE_SIZE or peak[low] < K.MERGE_ALTITUDE
            if tiny or (level[low] == level[big] and np.float32(a) / np.float32(min(peak[low], peak[big])) >= np.float32(K.MERGE_RATIO)):
                up[low] = big
                size[big] += size[low]
                peak[big] = max(peak[big], peak[low])
                here = big
            else:
                meets.append((c, here, other))
        here = root(here)
        flood_of[c] = here
        size[here] += 1

    dense: dict[int, int] = {}
    area = np.full(n, -1, dtype=np.int32)
    for c in cells.tolist():
        area[c] = dense.setdefault(root(flood_of[c]), len(dense))
    frontier = []
    for c, a, b in meets:
        a, b = sorted((dense[root(a)], dense[root(b)]))
        if a != b:
            frontier.append((c, a, b))
    return area, len(dense), frontier


def spread(w: int, h: int, free: np.ndarray, start, most: int | None = None, want_paths: bool = False):
    """Breadth-first distances from ``start`` (cells, in order) over free cells, -1 where out of reach; predecessors too if wanted.

    A whole front advances at a time; the order within it (parents in order, then E, W, S, N) is that of a queue, which
    decides the predecessors.
    """
    n = w * h
    dist, prev = np.full(n, -1, dtype=np.int32), np.full(n if want_paths else 0, -1, dtype=np.int64)
    front = np.atleast_1d(np.asarray(start, dtype=np.int64))
    dist[front] = 0
    d = 0
    while len(front) and (most is None or d < most):
        d += 1
        x = front % w
        nxt = np.stack((np.where(x + 1 < w, front + 1, -1), np.where(x > 0, front - 1, -1), np.where(front < n - w, front + w, -1), front - w), axis=1)
        src = np.repeat(front, 4)
        nxt = nxt.reshape(-1)
        ok = nxt >= 0
        ok[ok] = free[nxt[ok]] & (dist[nxt[ok]] < 0)
        nxt, src = nxt[ok], src[ok]
        _, first = np.unique(nxt, return_index=True)
        first.sort()
        front = nxt[first]
        dist[front] = d
        if want_paths:
            prev[front] = src[first]
    return dist, prev


def components(w: int, h: int, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label per cell from 0 in row-major order of first cells, -1 outside; sizes) of the 4-connected components.

    All edges hook the larger root to the smaller at once, then every path is halved until it is flat; a handful of rounds.
    """
    m = np.asarray(mask, dtype=bool).reshape(h, w)
    cell = np.arange(w * h).reshape(h, w)
    across, down = m[:, :-1] & m[:, 1:], m[:-1] & m[1:]
    u = np.concatenate((cell[:, :-1][across], cell[:-1][down]))
    v = np.concatenate((cell[:, 1:][across], cell[1:][down]))
    root = np.arange(w * h)
    while len(u):
        a, b = root[u], root[v]
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            flat = root[root]
            if (flat == root).all():
                break
            root = flat
    label = np.full(w * h, -1, dtype=np.int32)
    inside = m.reshape(-1)
    _, at, sizes = np.unique(root[inside], return_inverse=True, return_counts=True)
    label[inside] = at
    return label, sizes


def largest_component(w: int, h: int, mask: np.ndarray) -> np.ndarray | None:
    """The largest 4-connected component, the first on ties; None of an empty mask. Works on the mask's bounding box."""
    mask = np.asarray(mask, dtype=bool)
    if not mask.any():
        return None
    ys, xs = np.nonzero(mask.reshape(h, w))
    y0, y1, x0, x1 = ys.min(), ys.max() + 1, xs.min(), xs.max() + 1
    box = mask.reshape(h, w)[y0:y1, x0:x1]
    label, sizes = components(x1 - x0, y1 - y0, box.reshape(-1))
    out = np.zeros((h, w), dtype=bool)
    out[y0:y1, x0:x1] = (label == int(np.argmax(sizes))).reshape(box.shape)
    return out.reshape(-1)


def nearest_cell(w: int, h: int, free: np.ndarray, x: int, y: int, most: int = K.SEED_RADIUS) -> int | None:
    """The free cell nearest to (x, y), clamped to the map, by (Chebyshev distance, row, column)."""
    x, y = min(max(x, 0), w - 1), min(max(y, 0), h - 1)
    y0, y1, x0, x1 = max(y - most, 0), min(y + most + 1, h), max(x - most, 0), min(x + most + 1, w)
    ys, xs = np.nonzero(free.reshape(h, w)[y0:y1, x0:x1])
    if not len(ys):
        return None
    ys, xs = ys + y0, xs + x0
    k = np.lexsort((xs, ys, np.maximum(abs(ys - y), abs(xs - x))))[0]
    return int(ys[k] * w + xs[k])


def blocked_for_naturals(grid: Grid) -> np.ndarray:
    """Walls and the map's outer ring."""
    free = grid.passable.reshape(grid.h, grid.w).copy()
    free[0, :] = free[-1, :] = False
    free[:, 0] = free[:, -1] = False
    return ~free.reshape(-1)


def naturals(grid: Grid, starts, expansions) -> list[tuple[int, int, int, list[int]]]:
    """(start, expansion, steps, path) of the expansion nearest to each start on foot; the lower index on ties."""
    from tilewright.operators.cluster import half_away

    free = ~blocked_for_naturals(grid)
    seed = lambda c: nearest_cell(grid.w, grid.h, free, half_away(c[0]), half_away(c[1]))
    goals = [seed(e) for e in expansions]
    out = []
    for i, s in enumerate(starts):
        at = seed(s)
        if at is None:
            continue
        dist, prev = spread(grid.w, grid.h, free, at, want_paths=True)
        reached = [(int(dist[g]), j) for j, g in enumerate(goals) if g is not None and dist[g] >= 0]
        if reached:
            d, j = min(reached)
            path, c = [goals[j]], goals[j]
            while c != at:
                c = int(prev[c])
                path.append(c)
            out.append((i, j, d, path[::-1]))
    return out
