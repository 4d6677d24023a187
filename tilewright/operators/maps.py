"""Per-map kernels as tables: grids joined with a layout, and one query per stage of the analysis."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright import constants as K
from tilewright.operators import analysis as A
from tilewright.operators import cluster, jpeg, outline, raster, regions, terrain
from tilewright.operators.cluster import arrow_schema
from tilewright.session import collect_bounded


def maps(grids: DataFrame, catalog: DataFrame, metadata: DataFrame) -> DataFrame:
    """Grids with the resource layout of the first upload that bears the map's exact name and size.

    The metadata side is aggregated to one row per name before it meets the grids: partial minima, so no name is hot.
    """
    n = F.col("width_tiles") * F.col("height_tiles")
    g = grids.join(catalog.select("catalog_id", "canonical_name"), "catalog_id").select(
        F.col("catalog_id").alias("map_id"), F.col("canonical_name").alias("map_name"), "tileset_key", "width_tiles", "height_tiles", F.slice("tiles", F.lit(1), F.greatest(n, F.lit(1))).alias("tiles")
    )
    names = g.select("map_name", "width_tiles", "height_tiles")
    usable = metadata.where("mineral_fields is not null and start_locations is not null").select("map_name", "width_tiles", "height_tiles", "replay_id", "mineral_fields", "geysers", "start_locations")
    first = (
        usable.join(names, ["map_name", "width_tiles", "height_tiles"], "left_semi")
        .groupBy("map_name", "width_tiles", "height_tiles").agg(F.min_by(F.struct("mineral_fields", "geysers", "start_locations"), F.col("replay_id")).alias("l"))
    )
    return g.join(first, ["map_name", "width_tiles", "height_tiles"], "left").select("map_id", "map_name", "tileset_key", "width_tiles", "height_tiles", "tiles", "l.mineral_fields", "l.geysers", "l.start_locations")


def grid_of(row, tables) -> terrain.Grid | None:
    """The minitile grid of a map row; None where it has none."""
    try:
        return terrain.expand(row["width_tiles"] or 0, row["height_tiles"] or 0, np.array(row["tiles"] or [], dtype=np.int64), *tables[A.folder_of(row["tileset_key"])])
    except (ValueError, KeyError):
        return None


def _per_grid(maps_: DataFrame, attributes: DataFrame, kernel, sql: str) -> DataFrame:
    def run(row, tables):
        g = grid_of(row, tables)
        if g is not None:
            for r in kernel(row, g):
                yield {"map_id": row["map_id"]} | r

    return A.per_map(maps_, attributes, run, A.MAP_COLUMNS, f"map_id long, {sql}", arrow_schema(f"map_id long, {sql}"))


def altitudes(m, a):
    """Per row of minitiles: sum and largest altitude."""

    def kernel(row, g):
        alt = terrain.altitude(g.w, g.h, g.passable).reshape(g.h, g.w)
        return [{"y": y, "total": round(float(v.sum(dtype=np.float64)), 3), "highest": round(float(v.max()), 3)} for y, v in enumerate(alt)]

    return _per_grid(m, a, kernel, "y int, total double, highest double")


def areas(m, a):
    """Watershed areas with their size, elevation and frontier cells."""

    def kernel(row, g):
        t = terrain.Areas(g)
        size = np.bincount(t.area[t.area >= 0], minlength=t.count)
        edge = np.zeros(t.count, dtype=int)
        for _, i, j in t.frontier:
            edge[i] += 1
            edge[j] += 1
        return [{"area": i, "cells": int(size[i]), "frontier": int(edge[i])} for i in range(t.count)]

    return _per_grid(m, a, kernel, "area int, cells int, frontier int")


def chokes(m, a):
    """Crossings between watershed areas."""

    def kernel(row, g):
        return [
            {"area_a": i, "area_b": j, "center_x": s.center[0], "center_y": s.center[1], "ax": s.a[0], "ay": s.a[1], "bx": s.b[0], "by": s.b[1], "width": s.width}
            for i, j, s in regions.area_chokes(terrain.Areas(g))
        ]

    return _per_grid(m, a, kernel, "area_a int, area_b int, center_x int, center_y int, ax int, ay int, bx int, by int, width double")


def largest_parts(m, a):
    """The largest passable component of each map, with the corners of its outline."""

    def kernel(row, g):
        part = terrain.largest_component(g.w, g.h, g.passable)
        if part is None:
            return []
        line = outline.boundary(g.w, g.h, part)
        return [{"cells": int(part.sum()), "corners": len(line), "simplified": len(outline.simplify_closed(line))}]

    return _per_grid(m, a, kernel, "cells int, corners int, simplified int")


def parts(m, a):
    """The connected passable parts of each map, numbered in order of their first cells: their sizes."""

    def kernel(row, g):
        _, sizes = terrain.components(g.w, g.h, g.passable)
        return [{"part": i, "cells": int(n)} for i, n in enumerate(sizes)]

    return _per_grid(m, a, kernel, "part int, cells int")


def growth(m, a):
    """Ground that each base reaches by walking cost within its own area: cells, starts first."""

    def kernel(row, g):
        found = cluster.detect(row["width_tiles"], row["height_tiles"], A.points(row, "mineral_fields"), A.points(row, "geysers"), A.points(row, "start_locations"))
        found.sort(key=lambda b: not b["is_starting"])
        t = terrain.Areas(g)
        seeds = [terrain.nearest_cell(g.w, g.h, t.area >= 0, int(b["center_x"] / 8.0), int(b["center_y"] / 8.0)) for b in found]
        owner = regions.grow(t, seeds, [b["is_starting"] for b in found])
        return [{"base": b["base_id"], "is_starting": b["is_starting"], "cells": int((owner == i).sum())} for i, b in enumerate(found)]

    return _per_grid(m, a, kernel, "base int, is_starting boolean, cells int")


def middles(m, a):
    """Share of each expansion's region that lies within the circle about the map's middle."""

    def kernel(row, g):
        found = cluster.detect(row["width_tiles"], row["height_tiles"], A.points(row, "mineral_fields"), A.points(row, "geysers"), A.points(row, "start_locations"))
        found.sort(key=lambda b: not b["is_starting"])
        owner, _ = regions.build(terrain.Areas(g), [(b["center_x"] / 8.0, b["center_y"] / 8.0) for b in found], [b["is_starting"] for b in found])
        return [{"base": b["base_id"], "share": round(A.center_share(g.w, g.h, owner == i), 6)} for i, b in enumerate(found) if not b["is_starting"]]

    return _per_grid(m, a, kernel, "base int, share double")


def walks(m, a):
    """Walking distances from the passable cell nearest to the middle: cells reached, their sum, the farthest."""

    def kernel(row, g):
        free = ~terrain.blocked_for_naturals(g)
        seed = terrain.nearest_cell(g.w, g.h, free, g.w // 2, g.h // 2)
        if seed is None:
            return []
        d = terrain.spread(g.w, g.h, free, seed)[0]
        return [{"seed_x": seed % g.w, "seed_y": seed // g.w, "reached": int((d >= 0).sum()), "steps": int(d[d >= 0].sum(dtype=np.int64)), "farthest": int(d.max())}]

    return _per_grid(m, a, kernel, "seed_x int, seed_y int, reached int, steps long, farthest int")


def start_seeds(m, a):
    """The passable cell nearest to each start location."""

    def kernel(row, g):
        for i, (x, y) in enumerate(A.points(row, "start_locations")):
            c = terrain.nearest_cell(g.w, g.h, g.passable, x // 8, y // 8)
            yield {"start_no": i, "x": None if c is None else c % g.w, "y": None if c is None else c // g.w}

    return _per_grid(m, a, kernel, "start_no int, x int, y int")


def natural_links(m, a):
    """For each start base: the expansion nearest on foot, the steps and the turns of the way."""

    def kernel(row, g):
        found = cluster.detect(row["width_tiles"], row["height_tiles"], A.points(row, "mineral_fields"), A.points(row, "geysers"), A.points(row, "start_locations"))
        place = lambda b: (b["center_x"] / 8.0, b["center_y"] / 8.0)
        first, rest = [b for b in found if b["is_starting"]], [b for b in found if not b["is_starting"]]
        for s, e, d, path in terrain.naturals(g, list(map(place, first)), list(map(place, rest))):
            step = np.diff(path)
            yield {"start_base": first[s]["base_id"], "expansion_base": rest[e]["base_id"], "steps": d, "turns": int((np.diff(step) != 0).sum())}

    return _per_grid(m, a, kernel, "start_base int, expansion_base int, steps int, turns int")


def pack_from(attributes: dict[str, tuple[np.ndarray, np.ndarray]], folder: str) -> raster.Pack:
    """A drawable pack out of tile attributes: each minitile is a flat tone of its feature and elevation."""
    feat, elev = attributes[folder]
    tone = (feat.astype(int) * 12 + elev.astype(int) * 20).astype(np.uint8)
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
    minis = np.broadcast_to(np.arange(256, dtype=np.uint8)[:, None, None], (256, 8, 8))
    return raster.Pack(palette, np.arange(len(feat)), tone.astype(int) << 1, np.ascontiguousarray(minis))


FOLDERS = 64  # rows of a table of packs, at most


def packs_of(packs: DataFrame) -> dict[str, raster.Pack]:
    """``packs(folder, pack)`` with the bytes of tile packs; one a folder, each bounded by its 16-bit numbers."""
    from tilewright.sources import binary

    one = packs.where("folder is not null and pack is not null").groupBy("folder").agg(F.min("pack").alias("pack"))
    return {r["folder"]: binary.tile_pack(bytes(r["pack"])) for r in collect_bounded(one, FOLDERS, "tile packs")}


RENDER = pa.schema([("map_id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("png", pa.binary()), ("error", pa.string())])


def _drawer(maps_: DataFrame, packs: DataFrame | None, layers: raster.Layers | None, rect, most: int | None):
    """Draw a map row: with its tileset's pack where a table of packs is given, else in flat tones of the tile attributes."""
    given = maps_.sparkSession.sparkContext.broadcast(packs_of(packs)) if packs is not None else None

    def draw(row, tables):
        folder = A.folder_of(row["tileset_key"])
        pack = pack_from(tables, folder) if given is None else given.value[folder]
        tiles = np.array(row["tiles"] or [], dtype=np.int64)
        image = raster.render(pack, row["width_tiles"] or 0, row["height_tiles"] or 0, tiles, A.points(row, "mineral_fields"), A.points(row, "geysers"), layers, rect)
        if most and (f := raster.downsample_factor(image.shape[1], image.shape[0], most)) > 1:
            image = raster.box_downsample(image, f)
        return image

    return draw


def _images(m: DataFrame, attributes: DataFrame, draw, encode, column: str) -> DataFrame:
    """(map_id, width, height, <column>, error); what cannot be drawn is an error row."""

    def kernel(row, tables):
        try:
            image = draw(row, tables)
            yield {"map_id": row["map_id"], "width": image.shape[1], "height": image.shape[0], column: encode(image), "error": None}
        except (ValueError, KeyError) as e:
            yield {"map_id": row["map_id"], "error": str(e)}

    sql = f"map_id long, width int, height int, {column} binary, error string"
    return A.per_map(m, attributes, kernel, A.MAP_COLUMNS, sql, pa.schema([f if f.name != "png" else pa.field(column, pa.binary()) for f in RENDER]))


def render(m: DataFrame, attributes: DataFrame, most: int | None = None, layers: raster.Layers | None = None, packs: DataFrame | None = None, rect=None) -> DataFrame:
    """(map_id, width, height, png, error): each map, or a rectangle (x, y, w, h) of its tiles, halved until it fits ``most`` pixels.

    ``packs(folder, pack)``: the tilesets' art; a map whose tileset has none is an error row. Without it, tones of the attributes.
    """
    return _images(m, attributes, _drawer(m, packs, layers, rect, most), raster.png, "png")


def render_jpeg(m: DataFrame, attributes: DataFrame, most: int = K.IMAGE_MAX_DIM, quality: int = 85, packs: DataFrame | None = None, rect=None) -> DataFrame:
    """(map_id, width, height, jpeg, error): as ``render``, in JPEG."""
    if most <= 0 or not 1 <= quality <= 100:
        raise ValueError("invalid size or quality")
    return _images(m, attributes, _drawer(m, packs, None, rect, most), lambda image: jpeg.encode(image, quality), "jpeg")


def creep(packs: DataFrame) -> DataFrame:
    """(folder, png, error): the creep ground of each tileset's pack."""
    schema = pa.schema([("folder", pa.string()), ("png", pa.binary()), ("error", pa.string())])

    def run(batches):
        from tilewright.sources import binary

        for b in batches:
            for folder, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    pack = binary.tile_pack(data or b"")
                    row = {"folder": folder, "png": raster.png(raster.coloured(raster.creep_texture(pack), pack.palette))}
                except ValueError as e:
                    row = {"folder": folder, "error": str(e)}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return packs.select("folder", "pack").mapInArrow(run, "folder string, png binary, error string")


def overlay(m: DataFrame, attributes: DataFrame, scale: int = 1, packs: DataFrame | None = None) -> DataFrame:
    """(map_id, width, height, png, error): base regions and chokes over the drawn terrain."""

    draw = _drawer(m, packs, None, None, None)

    def shapes(row, tables):
        w, h, tiles = row["width_tiles"] or 0, row["height_tiles"] or 0, np.array(row["tiles"] or [], dtype=np.int64)
        got = A.analyse(w, h, tiles, A.points(row, "mineral_fields"), A.points(row, "geysers"), A.points(row, "start_locations"), *tables[A.folder_of(row["tileset_key"])], paths=True)
        d = got["debug"]
        return raster.base_shapes(draw(row, tables), got["starting_locations"] + got["expansions"], d["owner"], d["grid"].w, d["grid"].h, scale)

    return _images(m, attributes, shapes, raster.png, "png")


def qoi_round_trip(m: DataFrame, attributes: DataFrame) -> DataFrame:
    """Each map's tile tones as a QOI image, coded and decoded again: its size and whether it came back unchanged."""

    def kernel(row, tables):
        try:
            tone = tables[A.folder_of(row["tileset_key"])][0].astype(int).sum(axis=1) & 255
        except (ValueError, KeyError):
            return
        w, h = row["width_tiles"] or 0, row["height_tiles"] or 0
        t = np.array(row["tiles"] or [], dtype=np.int64)
        if w <= 0 or h <= 0 or len(t) != w * h:
            return
        v = np.where(t < len(tone), tone[np.minimum(t, len(tone) - 1)], 0).reshape(h, w)
        image = np.stack((v, 255 - v, v // 2, np.where(v > 8, 255, v * 16)), axis=-1).astype(np.uint8)
        coded = raster.qoi(image)
        yield {"map_id": row["map_id"], "bytes": len(coded), "same": bool((raster.read_qoi(coded) == image).all())}

    return A.per_map(m, attributes, kernel, A.MAP_COLUMNS, "map_id long, bytes int, same boolean", arrow_schema("map_id long, bytes int, same boolean"))
