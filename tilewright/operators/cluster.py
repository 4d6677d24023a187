"""Resource points to bases: minimum spanning tree, cuts, parameter search, centre merge, radii.

One numpy kernel per map, run over Arrow batches, once per distinct layout however many uploads have it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright import constants as K
from tilewright.session import respread


def distances(p: np.ndarray) -> np.ndarray:
    d = p[:, None, :] - p[None, :, :]
    return np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1])


def kth_distance(d: np.ndarray, k: int = K.NEIGHBOUR) -> np.ndarray:
    """Distance of each point to its k-th nearest other point, k clamped to what there is."""
    n = len(d)
    k = min(max(k, 1), n - 1)
    if k < 1:
        return np.zeros(n)
    other = d.copy()
    np.fill_diagonal(other, np.inf)
    return np.partition(other, k - 1, axis=1)[:, k - 1]


def percentile(values: np.ndarray, p: float) -> float:
    return float(np.quantile(values, p)) if len(values) else 0.0


def spanning_tree(d: np.ndarray) -> list[tuple[int, int, float]]:
    """(parent, new point, weight), grown from point 0, the lowest index first on ties."""
    n = len(d)
    near, parent, out = d[0].copy(), np.zeros(n, dtype=int), []
    open_ = np.ones(n, dtype=bool)
    open_[0] = False
    for _ in range(n - 1):
        u = int(np.argmin(np.where(open_, near, np.inf)))
        out.append((int(parent[u]), u, float(near[u])))
        open_[u] = False
        closer = open_ & (d[u] < near)
        near[closer], parent[closer] = d[u][closer], u
    return out


class Forest:
    """Union-find with ranks; the identity of the roots decides later ties."""

    def __init__(self, n: int):
        self.up, self.rank = list(range(n)), [0] * n

    def find(self, x: int) -> int:
        root = x
        while self.up[root] != root:
            root = self.up[root]
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            if self.rank[a] < self.rank[b]:
                a, b = b, a
            self.up[b] = a
            self.rank[a] += self.rank[a] == self.rank[b]


class Layout:
    """The points of one map, with what does not depend on the parameters computed once."""

    def __init__(self, points: np.ndarray):
        self.p = points
        self.d = distances(points)
        self.scale = kth_distance(self.d) if len(points) > 1 else np.zeros(len(points))
        self.median = percentile(self.scale, 0.5)
        self.tree = spanning_tree(self.d) if len(points) else []

    def labels(self, alpha: float, beta: float) -> tuple[np.ndarray, int]:
        """Cluster of each point, numbered as they first occur."""
        n = len(self.p)
        f = Forest(n)
        for a, b, w in self.tree:
            if w <= alpha * max(self.scale[a], self.scale[b]) and w <= beta * self.median:
                f.join(a, b)
        root = np.array([f.find(i) for i in range(n)], dtype=int)
        roots, size = np.unique(root, return_counts=True)
        big = roots[size >= K.LEAST_COMPONENT]
        if not len(big):
            big = roots
        centers = np.array([self.p[root == r].sum(axis=0) / (root == r).sum() for r in big]).reshape(-1, 2)
        out = root.copy()
        for r, s in zip(roots, size):
            if s < K.LEAST_COMPONENT:  # small components join the one they lie nearest on average
                mine = self.p[root == r]
                far = [np.sqrt(((mine - c) ** 2).sum(axis=1)).sum() / len(mine) for c in centers]
                out[root == r] = big[int(np.argmin(far))]
        _, first, inverse = np.unique(out, return_index=True, return_inverse=True)
        return np.argsort(np.argsort(first))[inverse], len(first)

    def silhouette(self, labels: np.ndarray, k: int) -> float:
        """Mean silhouette in which a point alone in its cluster has no inner distance."""
        n = len(self.p)
        if not n or k < 1:
            return 0.0
        one_hot = np.zeros((n, k))
        one_hot[np.arange(n), labels] = 1
        size = one_hot.sum(axis=0)
        total = self.d @ one_hot
        own = size[labels]
        a = np.where(own > 1, total[np.arange(n), labels] / np.maximum(own - 1, 1), 0.0)
        other = np.where((one_hot == 0) & (size > 0), total / np.maximum(size, 1), np.inf)
        b = other.min(axis=1)
        den = np.maximum(a, b)
        ok = np.isfinite(b) & (den > 0)
        return float(((b - a)[ok] / den[ok]).sum() / n)

    def search(self) -> tuple[float, float, int, np.ndarray, float]:
        """(alpha, beta, clusters, labels, score) of the best parameters, the first on ties."""
        best, top, known = None, -math.inf, {}
        for alpha in K.ALPHAS:
            for beta in K.BETAS:
                labels, k = self.labels(alpha, beta)
                if k < 4:
                    continue
                key = labels.tobytes()
                score = known.get(key)
                if score is None:
                    size = np.bincount(labels, minlength=k)
                    score = self.silhouette(labels, k) - 0.04 * np.maximum(5 - size, 0).sum() - 0.03 * np.maximum(size - 22, 0).sum()
                    score = known[key] = float(score - 0.06 * max(8 - k, 0) - 0.04 * max(k - 24, 0))
                if score > top:
                    best, top = (alpha, beta, k, labels, score), score
        if best is None:
            labels, k = self.labels(*K.FALLBACK)
            best = (*K.FALLBACK, k, labels, self.silhouette(labels, max(k, 1)))
        return best


def merge_center(points, labels, width_tiles, height_tiles, starts) -> np.ndarray:
    """Clusters about the middle of the map become one, unless somebody starts there."""
    cx, cy, r = width_tiles * 16.0, height_tiles * 16.0, K.CENTER_MERGE * min(width_tiles, height_tiles) * 32
    if any(math.sqrt((x - cx) ** 2 + (y - cy) ** 2) <= r for x, y in starts):
        return labels
    inner = []
    for l in np.unique(labels):
        c = points[labels == l].sum(axis=0) / (labels == l).sum()
        if math.sqrt((c[0] - cx) ** 2 + (c[1] - cy) ** 2) <= r:
            inner.append(l)
    return labels if len(inner) < 2 else np.where(np.isin(labels, inner), inner[0], labels)


def grow_starts(center: np.ndarray, radius: np.ndarray, starting: np.ndarray) -> np.ndarray:
    """Starting bases grow in falling steps, in turn, until they touch a neighbour."""
    radius, room = radius.copy(), distances(center) * K.RADIUS_SAFETY
    np.fill_diagonal(room, np.inf)
    who = np.flatnonzero(starting)
    for step in K.GROWTH_STEPS:
        for _ in range(K.GROWTH_TURNS):
            grown = False
            for i in who:
                if (radius[i] + step + radius <= room[i]).all():
                    radius[i] += step
                    grown = True
            if not grown or len(center) == 1:  # alone on the map, growth would never end
                break
    return radius


def sector(width_tiles, height_tiles, x, y) -> int:
    a = math.degrees(math.atan2(y - height_tiles * 16.0, x - width_tiles * 16.0)) % 360.0
    return (3, 5, 6, 7, 9, 11, 12, 1)[int(((a + 22.5) % 360.0) // 45.0)]


def half_away(v: float) -> int:
    return int(math.copysign(math.floor(abs(v) + 0.5), v))


def detect(width_tiles, height_tiles, minerals, geysers, starts) -> list[dict]:
    """Bases of a map in order of their labels."""
    points = np.array([*minerals, *geysers], dtype=float).reshape(-1, 2)
    if not len(points):
        return []
    labels = merge_center(points, Layout(points).search()[3], width_tiles, height_tiles, starts)
    center, natural = [], []
    for l in np.unique(labels):
        mine = points[labels == l]
        if len(mine) >= K.LEAST_COMPONENT:
            c = mine.sum(axis=0) / len(mine)
            center.append(c)
            natural.append(np.sqrt(((mine - c) ** 2).sum(axis=1)).max())
    if not center:
        return []
    center, natural = np.array(center), np.array(natural)
    count = np.zeros(len(center), dtype=int)
    for x, y in starts:
        count[int(np.argmin(np.sqrt(((center - (x, y)) ** 2).sum(axis=1))))] += 1
    between = distances(center)
    np.fill_diagonal(between, np.inf)
    half = natural if len(center) == 1 else between.min(axis=1) / 2
    geo = grow_starts(center, np.minimum(natural, half * K.RADIUS_SAFETY), count > 0)
    gas = set()
    for x, y in geysers:
        d = np.hypot(center[:, 0] - x, center[:, 1] - y)
        if d.min() <= K.GEYSER_REACH:
            gas.add(int(np.argmin(d)))
    out = []
    for i, (c, n) in enumerate(zip(center, natural)):
        hour = sector(width_tiles, height_tiles, half_away(c[0]), half_away(c[1]))
        out.append({
            "base_id": i, "center_x": float(c[0]), "center_y": float(c[1]), "natural_radius": float(n), "geo_radius": float(geo[i]), "start_count": int(count[i]),
            "is_starting": bool(count[i]), "display_name": f"at {hour}" if count[i] else f"an expa near {hour}", "mineral_only": i not in gas,
        })
    return out


def xy(column) -> list[list[tuple[int, int]]]:
    """Points of each row; null lists are empty, null points and points without a coordinate are left out."""
    return [[(p["x"], p["y"]) for p in row or [] if p is not None and p["x"] is not None and p["y"] is not None] for row in column.to_pylist()]


LAYOUT = ("width_tiles", "height_tiles", "mineral_fields", "geysers", "start_locations")
BASE_SQL = "base_id int, center_x double, center_y double, natural_radius double, geo_radius double, start_count int, is_starting boolean, display_name string, mineral_only boolean"
_ARROW = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "long": pa.int64()}


def arrow_schema(sql: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in sql.split(","))])


def per_layout(uploads: DataFrame, key: str, kernel, sql: str) -> DataFrame:
    """Rows ``kernel(w, h, minerals, geysers, starts) -> list of dicts`` of each upload.

    Uploads of one map repeat its layout, so the kernel runs once per distinct layout, told by a 96-bit hash, and its rows
    are joined back by that hash: narrow on the side of the uploads, so that a layout on a third of them only makes a long
    join partition, which the adaptive planner splits.
    """
    schema = arrow_schema(f"layout string, {sql}")
    id_ = F.concat_ws("-", F.xxhash64(*LAYOUT).cast("string"), F.hash(*LAYOUT).cast("string"))
    u = uploads.select(key, id_.alias("layout"), *LAYOUT)

    def run(batches):
        for b in batches:
            rows: dict[str, list] = {n: [] for n in schema.names}
            for i, w, h, *points in zip(*(b.column(c).to_pylist() for c in range(3)), *(xy(b.column(c)) for c in (3, 4, 5))):
                for r in kernel(w or 0, h or 0, *points):
                    rows["layout"].append(i)
                    for n, v in r.items():
                        rows[n].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    distinct = u.groupBy("layout").agg(F.first(F.struct(*LAYOUT)).alias("l")).select("layout", "l.*")
    done = respread(distinct).mapInArrow(run, f"layout string, {sql}")
    return u.select(key, "layout").join(done, "layout").drop("layout")


def bases(uploads: DataFrame, key: str = "replay_id") -> DataFrame:
    """All bases of each upload. A map without points or without a cluster of four gives none."""
    return per_layout(uploads, key, detect, BASE_SQL)


def tree_edges(uploads: DataFrame, key: str = "replay_id") -> DataFrame:
    def kernel(w, h, minerals, geysers, starts):
        p = np.array([*minerals, *geysers], dtype=float).reshape(-1, 2)
        return [{"a": a, "b": b, "w": d} for a, b, d in spanning_tree(distances(p))] if len(p) else []

    return per_layout(uploads, key, kernel, "a int, b int, w double")


def point_labels(uploads: DataFrame, key: str = "replay_id") -> DataFrame:
    """The chosen cluster of each point and the parameters and score that chose it."""

    def kernel(w, h, minerals, geysers, starts):
        p = np.array([*minerals, *geysers], dtype=float).reshape(-1, 2)
        if not len(p):
            return []
        alpha, beta, k, labels, score = Layout(p).search()
        merged = merge_center(p, labels, w, h, starts)
        return [{"point": i, "label": int(l), "merged": int(m), "alpha": alpha, "beta": beta, "clusters": k, "score": score} for i, (l, m) in enumerate(zip(labels, merged))]

    return per_layout(uploads, key, kernel, "point int, label int, merged int, alpha double, beta double, clusters int, score double")


def point_scales(uploads: DataFrame, key: str = "replay_id") -> DataFrame:
    """Distance of each point to its third neighbour, and the map's median of it."""

    def kernel(w, h, minerals, geysers, starts):
        p = np.array([*minerals, *geysers], dtype=float).reshape(-1, 2)
        if len(p) < 2:
            return []
        s = kth_distance(distances(p))
        m = percentile(s, 0.5)
        return [{"point": i, "scale": float(v), "median_scale": m} for i, v in enumerate(s)]

    return per_layout(uploads, key, kernel, "point int, scale double, median_scale double")


def quadrant_silhouette(uploads: DataFrame, key: str = "replay_id") -> DataFrame:
    """Silhouette of the points clustered by quarter of the map: a measure with given labels."""

    def kernel(w, h, minerals, geysers, starts):
        p = np.array([*minerals, *geysers], dtype=float).reshape(-1, 2)
        if not len(p):
            return []
        q = (p[:, 0] >= w * 16).astype(int) * 2 + (p[:, 1] >= h * 16)
        return [{"silhouette": Layout(p).silhouette(q, 4)}]

    return per_layout(uploads, key, kernel, "silhouette double")
