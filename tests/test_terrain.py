"""Grid kernels against the fixtures and against plain versions."""

import heapq
import math

import numpy as np
import pytest

from tilewright.operators import analysis, cluster, outline, regions, terrain


def mask(rows):
    a = np.array([[c == "#" for c in r] for r in rows])
    return a.shape[1], a.shape[0], a.reshape(-1)


@pytest.mark.parametrize("rows,want", [
    (["....", ".##.", ".##.", "...."], [(1, 1), (3, 1), (3, 3), (1, 3)]),
    (["###....."] * 3 + ["########"] * 3, [(0, 0), (3, 0), (3, 3), (8, 3), (8, 6), (0, 6)]),
    (["##..", "##..", "..#."], [(0, 0), (2, 0), (2, 2), (0, 2)]),
])
def test_outline(rows, want):
    got = outline.outline(*mask(rows))
    k = got.index(want[0])
    assert got[k:] + got[:k] == want


def test_outline_of_nothing():
    assert outline.outline(3, 3, np.zeros(9, dtype=bool)) is None


def rooms():
    w, h = 60, 22
    y, x = np.divmod(np.arange(w * h), w)
    return w, h, ((y >= 1) & (y < 21) & (x >= 1) & (x < 59) & ((x < 21) | (x >= 39) | ((y >= 9) & (y < 13)))).astype(int)


def test_two_rooms_and_a_corridor():
    w, h, f = rooms()
    a = terrain.Areas(terrain.Grid(w, h, f))
    assert a.area[10 * w + 10] >= 0 and a.area[10 * w + 50] >= 0 and a.area[10 * w + 10] != a.area[10 * w + 50]
    (choke,) = regions.area_chokes(a)
    s = choke[2]
    assert 21 <= s.center[0] < 39 and 9 <= s.center[1] < 13 and 3.5 <= s.width <= 5


def plain_altitude(w, h, ok):
    d = {}
    for i in range(w * h):
        d[i] = math.inf
    walls = [(x, y) for y in range(-1, h + 1) for x in range(-1, w + 1) if not (0 <= x < w and 0 <= y < h) or not ok[y * w + x]]
    for y in range(h):
        for x in range(w):
            d[y * w + x] = 0 if not ok[y * w + x] else min(max(abs(x - a), abs(y - b)) - min(abs(x - a), abs(y - b)) + math.sqrt(2) * min(abs(x - a), abs(y - b)) for a, b in walls)
    return np.array([d[i] for i in range(w * h)])


def test_altitude_is_the_octile_distance():
    rng = np.random.default_rng(3)
    w, h = 23, 17
    ok = rng.random(w * h) > 0.1
    assert np.allclose(terrain.altitude(w, h, ok), plain_altitude(w, h, ok), atol=1e-4)


def plain_bfs(w, h, free, start):
    dist, prev, queue = {start: 0}, {}, [start]
    for c in queue:
        x, y = c % w, c // w
        for nx, ny in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            o = ny * w + nx
            if 0 <= nx < w and 0 <= ny < h and free[o] and o not in dist:
                dist[o], prev[o] = dist[c] + 1, c
                queue.append(o)
    return dist, prev


def test_spread_is_a_queue():
    rng = np.random.default_rng(5)
    for seed in range(4):
        w, h = 19 + seed, 14
        free = rng.random(w * h) > 0.3
        start = int(np.flatnonzero(free)[7])
        dist, prev = terrain.spread(w, h, free, start, want_paths=True)
        d, p = plain_bfs(w, h, free, start)
        assert {c: int(v) for c, v in enumerate(dist) if v >= 0} == d
        assert {c: int(v) for c, v in enumerate(prev) if v >= 0} == p


def test_components_and_nearest():
    rng = np.random.default_rng(7)
    w, h = 31, 29
    m = rng.random(w * h) > 0.45
    label, sizes = terrain.components(w, h, m)
    for c in np.flatnonzero(m):
        assert (label == label[c]).sum() == sizes[label[c]]
        assert set(np.flatnonzero(label == label[c]).tolist()) == set(plain_bfs(w, h, m, int(c))[0])
    firsts = [int(np.flatnonzero(label == k)[0]) for k in range(len(sizes))]
    assert firsts == sorted(firsts)
    assert terrain.largest_component(w, h, np.zeros(w * h, dtype=bool)) is None
    free = np.zeros(25, dtype=bool)
    assert terrain.nearest_cell(5, 5, free, 2, 2) is None
    free[[1, 10]] = True
    assert terrain.nearest_cell(5, 5, free, 2, 2) == 1  # same ring: the smaller row


def plain_grow(areas, seeds, starting):
    g = areas.grid
    dist, owner = {}, {}
    heap = []
    for i, c in enumerate(seeds):
        if c is not None and c not in dist:
            dist[c], owner[c] = 0.0, i
            heapq.heappush(heap, (0.0, i, c))
    while heap:
        d, i, c = heapq.heappop(heap)
        if d > dist[c] or owner[c] != i:
            continue
        x, y = c % g.w, c // g.w
        inside = lambda a, b: 0 <= a < g.w and 0 <= b < g.h and areas.area[b * g.w + a] == areas.area[seeds[i]]  # noqa: E731, B023
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                if (dx or dy) and inside(x + dx, y + dy) and (not (dx and dy) or (inside(x + dx, y) and inside(x, y + dy))):
                    nd = float(np.float32(d + (float(np.float32(math.sqrt(2))) if dx and dy else 1.0)))
                    o = (y + dy) * g.w + x + dx
                    if nd <= (200 if starting[i] else 52) and nd < dist.get(o, math.inf):
                        dist[o], owner[o] = nd, i
                        heapq.heappush(heap, (nd, i, o))
    return owner


def test_growth():
    w, h, f = rooms()
    a = terrain.Areas(terrain.Grid(w, h, f))
    seeds = [10 * w + 5, 3 * w + 15, 10 * w + 50, None]
    got = regions.grow(a, seeds, [True, False, False, False])
    assert {c: int(o) for c, o in enumerate(got) if o >= 0} == plain_grow(a, seeds, [True, False, False, False])


def test_plateau_and_exits():
    # a raised room with one ramp into a low room
    w, h = 40, 20
    y, x = np.divmod(np.arange(w * h), w)
    feat = np.where((y > 0) & (y < 19) & (x > 0) & (x < 39) & ((x < 14) | (x > 17) | ((y > 7) & (y < 13))), 1, 0)
    feat = np.where((x >= 14) & (x <= 17) & (y > 7) & (y < 13), 3, feat)
    elev = np.where(x < 14, 1, 0)
    areas = terrain.Areas(terrain.Grid(w, h, feat, elev))
    owner, chokes = regions.build(areas, [(6.0, 10.0), (30.0, 10.0)], [True, False])
    assert (owner[(x > 0) & (x < 14) & (y > 0) & (y < 19)] == 0).all()
    assert len(chokes[0]) == 1 and chokes[0][0].other == 1
    assert regions.distinct([chokes[0][0], chokes[0][0]]) == [chokes[0][0]]


def test_expansion_of_tiles():
    feat, elev = np.zeros((4, 16), dtype=np.uint8), np.zeros((4, 16), dtype=np.uint8)
    feat[1], feat[3], elev[3] = 9, 9, 2
    feat[2] = 3
    g = terrain.expand(2, 1, np.array([1, 9]), feat, elev)
    assert g.w == 8 and g.h == 4 and g.passable.reshape(4, 8)[:, :4].all() and not g.passable.reshape(4, 8)[:, 4:].any()
    with pytest.raises(ValueError):
        terrain.expand(2, 1, np.array([1]), feat, elev)
    with pytest.raises(ValueError):
        terrain.expand(0, 1, np.array([], dtype=int), feat, elev)


def synthetic_map():
    rng = np.random.default_rng(11)
    w = h = 64
    spots = [(300, 300), (1700, 1700), (300, 1700), (1700, 300), (1000, 300), (300, 1000), (1024, 1024)]
    minerals, geysers = [], []
    for i, (cx, cy) in enumerate(spots):
        minerals += [(cx + int(rng.integers(-90, 90)), cy + int(rng.integers(-90, 90))) for _ in range(8)]
        if i != 4:
            geysers.append((cx + 100, cy))
    return w, h, minerals, geysers, [(310, 310), (1690, 1690)]


def test_whole_analysis():
    w, h, minerals, geysers, starts = synthetic_map()
    feat = np.zeros((2, 16), dtype=np.uint8)
    feat[1] = 9
    tiles = np.ones(w * h, dtype=int)
    r = analysis.analyse(w, h, tiles, minerals, geysers, starts, feat, np.zeros_like(feat))
    assert len(r["starting_locations"]) == 2 and all(b["kind"] == "start" and b["natural_expansion"] for b in r["starting_locations"])
    names = [b["name"] for b in r["expansions"]]
    assert len(names) == len(set(names)) and any(n.startswith("natural of") for n in names)
    assert sum(b["mineral_only"] for b in r["starting_locations"] + r["expansions"]) == 1
    for bad in ((w, h, tiles[:-1], minerals, geysers, starts), (w, h, tiles, [], [], starts), (w, h, tiles, minerals, geysers, [])):
        with pytest.raises(ValueError):
            analysis.analyse(*bad, feat, np.zeros_like(feat))


def test_names_of_expansions():
    # two in one sector are told apart by the dial, stacked ones by inner and outer
    centers = [(500.0, 256.0), (420.0, 250.0), (256.0, 256.0)]
    got = analysis.name_expansions(128, 128, [9], centers, [0, 0, 0.9], [])
    assert got[2] == ("center expa", "expa", 0)
    assert {g[0] for g in got[:2]} == {"expa 3", "inner expa 3"}
    twins = analysis.name_expansions(128, 128, [9, 3], [(10.0, 10.0)], [0], [(0, 0), (1, 0)])
    assert twins[0][:2] == ("natural of 3 & 9", "natural")


def test_clusters_against_plain():
    w, h, minerals, geysers, starts = synthetic_map()
    p = np.array(minerals + geysers, dtype=float)
    lay = cluster.Layout(p)
    # tree: same weight as Kruskal's
    n = len(p)
    edges = sorted((lay.d[i, j], i, j) for i in range(n) for j in range(i))
    f, total = cluster.Forest(n), 0.0
    for d, i, j in edges:
        if f.find(i) != f.find(j):
            f.join(i, j)
            total += d
    assert sum(e[2] for e in lay.tree) == pytest.approx(total)
    labels, k = lay.labels(1.9, 2.3)
    plain = 0.0
    for i in range(n):
        mine = [j for j in range(n) if labels[j] == labels[i] and j != i]
        a = sum(lay.d[i, j] for j in mine) / len(mine) if mine else 0.0
        b = min(np.mean([lay.d[i, j] for j in range(n) if labels[j] == c]) for c in range(k) if c != labels[i])
        plain += (b - a) / max(a, b)
    assert lay.silhouette(labels, k) == pytest.approx(plain / n)
    assert cluster.detect(64, 64, [], [], []) == []
    assert cluster.detect(64, 64, [(1, 1)], [], [(1, 1)]) == []
    bases = cluster.detect(w, h, minerals, geysers, starts)
    assert [b["base_id"] for b in bases] == list(range(len(bases))) and sum(b["start_count"] for b in bases) == 2
    one = cluster.detect(64, 64, [(10, 10), (20, 20), (30, 10), (10, 30), (15, 15)], [], [(10, 10)])
    assert len(one) == 1 and one[0]["geo_radius"] > 0
