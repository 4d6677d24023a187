"""The whole analysis of a map: bases, regions, chokes, naturals, names, outlines. One map per kernel call, one row out.

Errors do not stop the job; they are the row's ``error``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright import constants as K
from tilewright.operators import cluster, outline, regions, terrain

TILES = 65_536  # tiles of a tileset are 16-bit numbers: at most so many rows of 16 minitiles each and folder


def folder_of(key: str | None) -> str:
    k = (key or "").strip().lower()
    if not k:
        raise ValueError("empty tileset key")
    if k in K.DIRECT_FOLDERS:
        return k
    slug = k[3:] if len(k) >= 3 and k[:2].isdigit() and k[2] == "-" else k
    slug = slug.removesuffix("-missing-era")
    if slug not in K.TILESET_FOLDERS:
        raise ValueError(f"unsupported tileset {key!r}")
    return K.TILESET_FOLDERS[slug]


def dial_hour(width_tiles, height_tiles, x, y) -> int:
    """Nearest of twelve hours, the smaller on ties."""
    import math

    h = (math.degrees(math.atan2(y - height_tiles * 16.0, x - width_tiles * 16.0)) % 360.0 / 30.0 + 3.0) % 12.0
    return min(range(1, 13), key=lambda k: (min(abs(k % 12 - h), 12 - abs(k % 12 - h)), k))


def natural_label(hours) -> str:
    h = [str(x) for x in sorted(set(hours))]
    if len(h) < 2:
        return f"natural of {h[0]}" if h else "natural"
    return f"natural of {', '.join(h[:-1])} & {h[-1]}"


def center_share(w: int, h: int, mask: np.ndarray) -> float:
    """Share of a mask's cells within the circle about the middle."""
    cells = np.flatnonzero(mask)
    if not len(cells):
        return 0.0
    dx, dy = cells % w + 0.5 - w / 2, cells // w + 0.5 - h / 2
    return float((dx * dx + dy * dy <= (0.5 * K.CENTER_DIAMETER * max(w, h)) ** 2).mean())


def name_expansions(width_tiles, height_tiles, start_hours, centers, shares, links) -> list[tuple[str, str, int]]:
    """(name, kind, hour) of each expansion: naturals first, then one in the middle, then by hour, row and column."""
    n = len(centers)
    pixel = [(cluster.half_away(x * 8), cluster.half_away(y * 8)) for x, y in centers]
    hour = [cluster.sector(width_tiles, height_tiles, *p) for p in pixel]
    owners = [sorted({s for s, e, *_ in links if e == i}) for i in range(n)]
    out: list = [None] * n
    used: set[str] = set()

    def take(base: str) -> str:
        name, k = base, 2
        while name in used:
            name, k = f"{base} ({k})", k + 1
        used.add(name)
        return name

    for i in range(n):
        if owners[i]:
            out[i] = (take(natural_label(start_hours[s] for s in owners[i])), "natural", hour[i])
    middle = [i for i in range(n) if not owners[i] and shares[i] >= K.CENTER_OVERLAP]
    if len(middle) == 1:
        out[middle[0]] = (take("center expa"), "expa", 0)
    plain = [i for i in range(n) if out[i] is None]
    shared = {h for h in hour if sum(hour[i] == h for i in plain) > 1}
    final = {i: dial_hour(width_tiles, height_tiles, *pixel[i]) if hour[i] in shared else hour[i] for i in plain}
    far = lambda i: (centers[i][0] * 8 - width_tiles * 16.0) ** 2 + (centers[i][1] * 8 - height_tiles * 16.0) ** 2
    inner = set()
    for h in set(final.values()):
        group = [i for i in plain if final[i] == h]
        outer = max(group, key=lambda i: (far(i), -i))
        inner |= set(group) - {outer}
    tile = [(cluster.half_away(y), cluster.half_away(x)) for x, y in centers]
    for i in sorted(plain, key=lambda i: (final[i], tile[i])):
        out[i] = (take(("inner " if i in inner else "") + f"expa {final[i]}"), "expa", final[i])
    return out


def analyse(width_tiles, height_tiles, tiles, minerals, geysers, starts, feat, elev, paths: bool = False) -> dict:
    """The result of one map; ValueError where it cannot be analysed."""
    if len(tiles) != width_tiles * height_tiles:
        raise ValueError("tile grid mismatch")
    grid = terrain.expand(width_tiles, height_tiles, tiles, feat, elev)
    found = cluster.detect(width_tiles, height_tiles, minerals, geysers, starts)
    if not found:
        raise ValueError("no bases detected")
    first = [b for b in found if b["is_starting"]]
    rest = [b for b in found if not b["is_starting"]]
    if not first or not rest:
        raise ValueError("expected both starts and expansions")
    place = lambda b: (b["center_x"] / 8.0, b["center_y"] / 8.0)
    at_start, at_rest = [place(b) for b in first], [place(b) for b in rest]
    areas = terrain.Areas(grid)
    owner, chokes = regions.build(areas, at_start + at_rest, [True] * len(first) + [False] * len(rest))
    links = terrain.naturals(grid, at_start, at_rest)
    hours = [cluster.sector(width_tiles, height_tiles, cluster.half_away(x * 8), cluster.half_away(y * 8)) for x, y in at_start]
    shares = [center_share(grid.w, grid.h, owner == len(first) + i) for i in range(len(rest))]
    names = [(f"start {h}", "start", h) for h in hours] + name_expansions(width_tiles, height_tiles, hours, at_rest, shares, links)
    natural = {s: names[len(first) + e][0] for s, e, *_ in links}
    point = lambda p: {"x": int(p[0]), "y": int(p[1])}
    out = []
    for i, (b, c, (name, kind, hour)) in enumerate(zip(first + rest, at_start + at_rest, names)):
        line = outline.outline(grid.w, grid.h, owner == i)
        out.append({
            "name": name, "kind": kind, "clock": hour, "center_tile": {"x": cluster.half_away(c[0]), "y": cluster.half_away(c[1])},
            "polygon_vertices": None if line is None else [point(p) for p in line], "mineral_only": b["mineral_only"], "natural_expansion": natural.get(i),
            "chokes": [{"center": point(s.center), "ends": [point(s.a), point(s.b)], "width": cluster.half_away(s.width), "connects_to": names[s.other][0] if s.other >= 0 else None} for s in chokes[i]] or None,
        })
    result = {"starting_locations": out[: len(first)], "expansions": out[len(first) :]}
    if paths:
        result["debug"] = {"grid": grid, "areas": areas, "owner": owner, "links": links}
    return result


_POINT = pa.struct([("x", pa.int32()), ("y", pa.int32())])
_CHOKE = pa.struct([("center", _POINT), ("ends", pa.list_(_POINT)), ("width", pa.int32()), ("connects_to", pa.string())])
_BASE = pa.struct([
    ("name", pa.string()), ("kind", pa.string()), ("clock", pa.int32()), ("center_tile", _POINT), ("polygon_vertices", pa.list_(_POINT)),
    ("mineral_only", pa.bool_()), ("natural_expansion", pa.string()), ("chokes", pa.list_(_CHOKE)),
])
_OUT = pa.schema([("map_id", pa.int64()), ("map_name", pa.string()), ("tileset_key", pa.string()), ("starting_locations", pa.list_(_BASE)), ("expansions", pa.list_(_BASE)), ("error", pa.string())])
_BASE_SQL = (
    "array<struct<name:string,kind:string,clock:int,center_tile:struct<x:int,y:int>,polygon_vertices:array<struct<x:int,y:int>>,mineral_only:boolean,"
    "natural_expansion:string,chokes:array<struct<center:struct<x:int,y:int>,ends:array<struct<x:int,y:int>>,width:int,connects_to:string>>>>"
)
OUT_SQL = f"map_id long, map_name string, tileset_key string, starting_locations {_BASE_SQL}, expansions {_BASE_SQL}, error string"


def tile_tables(attributes: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Folder -> (feature, elevation) by [tile, minitile], of the folders that a tileset key can name.

    Bounded by the 16-bit tile numbers: eight folders of TILES x 16 rows, in columns. Rows said twice count once.
    """
    known = attributes.where(F.col("folder").isin(*K.DIRECT_FOLDERS) & F.col("tile_id").between(0, TILES - 1) & F.col("mini").between(0, 15))
    t = known.groupBy("folder", "tile_id", "mini").agg(F.max(F.coalesce("feat", F.lit(0))).alias("feat"), F.max(F.coalesce("elev", F.lit(0))).alias("elev")).toArrow()
    folder = np.array(t.column("folder").to_pylist(), dtype=object)
    tile, mini, feat, elev = (t.column(c).to_numpy() for c in ("tile_id", "mini", "feat", "elev"))
    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for name in sorted(set(folder)):
        mine = folder == name
        table = np.zeros((2, int(tile[mine].max()) + 1, 16), dtype=np.uint8)
        table[:, tile[mine], mini[mine]] = feat[mine], elev[mine]
        out[name] = table[0], table[1]
    return out


MAPS = 32  # maps to a task, beyond four tasks a core


def per_map(maps: DataFrame, attributes: DataFrame, kernel, columns: list[str], sql: str, schema: pa.Schema) -> DataFrame:
    """``kernel(row dict, tables) -> iterable of row dicts`` over maps; each map is a task's unit, spread over all tasks."""
    shared = maps.sparkSession.sparkContext.broadcast(tile_tables(attributes))

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):  # a map at a time: its tiles as they lie, no row is built from all
                rows = list(kernel(b.slice(k, 1).to_pylist()[0], shared.value))
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # the number follows the maps; one of its own keeps the adaptive planner from merging the few bytes of many maps
    n = maps.select(columns[0]).count()
    tasks = max(1, min(n, max(4 * maps.sparkSession.sparkContext.defaultParallelism, -(-n // MAPS))))
    return maps.select(*columns).repartition(tasks, F.col(columns[0])).mapInArrow(run, sql)


MAP_COLUMNS = ["map_id", "map_name", "tileset_key", "width_tiles", "height_tiles", "tiles", "mineral_fields", "geysers", "start_locations"]


def points(row, name):
    return [(p["x"], p["y"]) for p in row[name] or [] if p is not None and p["x"] is not None and p["y"] is not None]


def analyze(maps: DataFrame, attributes: DataFrame) -> DataFrame:
    """One result per map (columns ``MAP_COLUMNS``): the nested document, or the error."""

    def kernel(row, tables):
        out = {k: row[k] for k in ("map_id", "map_name", "tileset_key")}
        try:
            folder = folder_of(row["tileset_key"])
            if folder not in tables:
                raise ValueError(f"no attributes of {folder}")
            w, h = row["width_tiles"] or 0, row["height_tiles"] or 0
            tiles = np.array(row["tiles"] or [], dtype=np.int64)
            out |= analyse(w, h, tiles, points(row, "mineral_fields"), points(row, "geysers"), points(row, "start_locations"), *tables[folder]) | {"error": None}
        except ValueError as e:
            out |= {"starting_locations": None, "expansions": None, "error": str(e)}
        yield out

    return per_map(maps, attributes, kernel, MAP_COLUMNS, OUT_SQL, _OUT)
