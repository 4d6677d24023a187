"""Relational operators over uploads and results: arg-min joins, grouped aggregates, windows, set operations.

Everything here is a DataFrame plan. What belongs to one map is computed within its row by higher-order functions, so
nothing is exploded and shuffled that need not be; what joins rows does so by equality on a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright import constants as K
from tilewright.functions import scalar as S
from tilewright.operators.nested import once
from tilewright.session import beside

LOOKUP = 100_000  # tiles whose attributes are broadcast


def uploads_once(metadata: DataFrame) -> DataFrame:
    """Uploads delivered twice are equal but for the time of delivery: one row per replay_id, the wide columns by any copy."""
    return metadata.dropDuplicates(["replay_id"])


def bases_of(results: DataFrame) -> DataFrame:
    """Flat bases with their place: result_id, base_no (starts first), is_start and the base's own fields."""
    both = F.concat(
        F.transform(F.coalesce("starting_locations", F.array()), lambda b, i: F.struct(F.lit(True).alias("is_start"), i.cast("int").alias("pos"), b.alias("b"))),
        F.transform(F.coalesce("expansions", F.array()), lambda b, i: F.struct(F.lit(False).alias("is_start"), i.cast("int").alias("pos"), b.alias("b"))),
    )
    return (
        once(results).select("result_id", F.posexplode(both).alias("base_no", "s"))
        .where("s.b is not null").select("result_id", "base_no", "s.is_start", "s.pos", "s.b.*")
    )


# ---- scans, checks and selection ------------------------------------------------------------------------------------


def replay_files(metadata: DataFrame) -> DataFrame:
    """Paths that are replays, whatever their case and style, in order of path."""
    path = F.regexp_replace("replay_path", r"[\\/]+", "/")
    return (
        metadata.where(F.lower("replay_path").endswith(".rep")).select(path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("file")).distinct().orderBy("path")
    )


def checked_tiles(grids: DataFrame) -> DataFrame:
    """Longer tile lists are cut to width x height, shorter ones are errors."""
    n = F.col("width_tiles") * F.col("height_tiles")
    have = F.coalesce(F.size("tiles"), F.lit(0))
    return grids.select(
        "catalog_id", "width_tiles", "height_tiles", "tileset_key",
        F.when((n > 0) & (have >= n), F.slice("tiles", F.lit(1), n)).alias("tiles"),
        F.when(F.coalesce(n, F.lit(0)) <= 0, "invalid map dimensions").when(have < n, "tile grid mismatch").alias("error"),
    )


def slug_key() -> Column:
    """The map key of selection: the ASCII slug of the typed name, else of the data name; null if neither has one."""
    return F.coalesce(F.nullif(S.ascii_slug(F.col("map_name")), F.lit("")), F.nullif(S.ascii_slug(F.col("map_data_name")), F.lit("")))


def first_per_key(metadata: DataFrame) -> DataFrame:
    """The first upload of each map key in order of path. Names without ASCII letters or digits fall back to the data name."""
    return (
        metadata.select(slug_key().alias("map_key"), "replay_path", "replay_id").where("map_key is not null")
        .groupBy("map_key").agg(F.min(F.struct("replay_path", "replay_id")).alias("first"), F.count_distinct("replay_id").alias("uploads"))
        .select("map_key", "first.replay_path", "first.replay_id", "uploads")
    )


def select_maps(metadata: DataFrame, selector: str = "") -> DataFrame:
    """The first upload in order of path of each map key that a selector picks: by the key or by the data name's slug.

    An empty selector picks every map. The selection is made before the first is taken.
    """
    want = S.ascii_slug(F.lit(selector or ""))
    picked = metadata.where((want == "") | (slug_key() == want) | (S.ascii_slug(F.col("map_data_name")) == want))
    return first_per_key(picked).select("map_key", "replay_path", "replay_id")


# ---- nearest base, mineral-only, radii -------------------------------------------------------------------------------


def _argmin(candidates: Column, distance) -> Column:
    """struct(d, i, c): nearest candidate, the first on ties; null of none."""
    return F.array_min(F.transform(F.filter(candidates, lambda c: c.isNotNull()), lambda c, i: F.named_struct(F.lit("d"), distance(c), F.lit("i"), i, F.lit("c"), c)))


def _with_results(metadata: DataFrame, results: DataFrame) -> DataFrame:
    """Uploads beside the bases (name, centre in pixels) of their results: one equality join on the narrow keys."""
    base = F.transform(
        F.filter(F.concat(F.coalesce("starting_locations", F.array()), F.coalesce("expansions", F.array())), lambda b: b.isNotNull() & b["center_tile"]["x"].isNotNull() & b["center_tile"]["y"].isNotNull()),
        lambda b: F.struct(b["name"].alias("name"), (b["center_tile"]["x"] * 8.0).alias("x"), (b["center_tile"]["y"] * 8.0).alias("y")),
    )
    r = once_with(results, "replay_id").select("result_id", "replay_id", base.alias("bases"))
    # only uploads with a result: their keys go ahead of the wide columns
    keys = results.select("replay_id").where("replay_id is not null").distinct()
    m = uploads_once(metadata.select("replay_id", "width_tiles", "height_tiles", "geysers", "start_locations").join(keys, "replay_id", "left_semi"))
    return r.where("replay_id is not null").join(m, "replay_id")


def once_with(results: DataFrame, *more: str) -> DataFrame:
    return results.select("result_id", "starting_locations", "expansions", *more).dropDuplicates(["result_id"])


def nearest_base(metadata: DataFrame, results: DataFrame) -> DataFrame:
    """For each start location of an analysed upload: the nearest base, its distance and hour."""
    j = _with_results(metadata, results).select("result_id", "width_tiles", "height_tiles", "bases", F.posexplode("start_locations").alias("start_no", "s"))
    near = _argmin(F.col("bases"), lambda c: S.distance(F.col("s.x"), F.col("s.y"), c["x"], c["y"]))
    return j.where("s.x is not null and s.y is not null").withColumn("n", near).where("n is not null").select(
        "result_id", "start_no", F.col("n.i").cast("int").alias("base_no"), F.col("n.c.name").alias("base_name"), F.round("n.d", 6).alias("distance"),
        S.sector_hour(S.ray_angle(F.col("width_tiles"), F.col("height_tiles"), F.col("n.c.x"), F.col("n.c.y"))).alias("hour"),
    )


def mineral_only(metadata: DataFrame, results: DataFrame) -> DataFrame:
    """Bases to which no geyser belongs: a geyser belongs to its nearest base, if within reach."""
    j = _with_results(metadata, results)
    own = lambda g: _argmin(F.col("bases"), lambda c: S.distance(g["x"], g["y"], c["x"], c["y"]))
    nearest = F.transform(F.filter(F.coalesce("geysers", F.array()), lambda g: g["x"].isNotNull() & g["y"].isNotNull()), own)
    owners = F.transform(nearest, lambda o: F.when(o["d"] <= K.GEYSER_REACH, o["i"].cast("int")))
    return j.select("result_id", owners.alias("gas"), F.posexplode("bases").alias("base_no", "b")).select(
        "result_id", "base_no", F.col("b.name").alias("base_name"), (~F.exists("gas", lambda g: F.coalesce(g == F.col("base_no"), F.lit(False)))).alias("mineral_only")
    )


def base_radii(results: DataFrame) -> DataFrame:
    """Half the distance to the nearest other base of the result, times the safety; null for a base alone."""
    places = lambda c: F.transform(F.coalesce(c, F.array()), lambda b: F.struct(b["name"].alias("name"), (b["center_tile"]["x"] * 8.0).alias("x"), (b["center_tile"]["y"] * 8.0).alias("y"), b.isNull().alias("none")))
    r = once(results).select("result_id", F.concat(places(F.col("starting_locations")), places(F.col("expansions"))).alias("bs"))
    numbered = F.transform("bs", lambda b, i: F.struct(i.cast("int").alias("base_no"), b["name"].alias("name"), b["x"].alias("x"), b["y"].alias("y"), b["none"].alias("none")))
    r = r.select("result_id", F.filter(numbered, lambda b: ~b["none"] & b["x"].isNotNull() & b["y"].isNotNull()).alias("bs"))
    near = lambda b: F.array_min(F.transform(F.filter("bs", lambda o: o["base_no"] != b["base_no"]), lambda o: S.distance(b["x"], b["y"], o["x"], o["y"]) / 2))
    rows = F.transform("bs", lambda b: F.struct(b["base_no"].alias("base_no"), b["name"].alias("name"), F.round(near(b) * K.RADIUS_SAFETY, 6).alias("most_radius")))
    return r.select("result_id", F.explode(rows).alias("b")).select("result_id", "b.*")


# ---- geometry of results --------------------------------------------------------------------------------------------


def polygon_stats(results: DataFrame) -> DataFrame:
    """Centre, box and whether the base's centre lies inside, of each base's polygon."""
    v = F.filter("polygon_vertices", lambda p: p.isNotNull())
    c = S.polygon_center(F.col("polygon_vertices"))
    lo = lambda f, k: f(F.transform(v, lambda p: p[k]))
    return bases_of(results).where("polygon_vertices is not null").select(
        "result_id", "base_no", F.round(c["x"], 6).alias("center_x"), F.round(c["y"], 6).alias("center_y"),
        lo(F.array_min, "x").alias("min_x"), lo(F.array_min, "y").alias("min_y"), lo(F.array_max, "x").alias("max_x"), lo(F.array_max, "y").alias("max_y"),
        S.point_in_polygon(F.col("center_tile.x") + F.lit(0.5), F.col("center_tile.y") + F.lit(0.5), F.col("polygon_vertices")).alias("holds_center"),
    )


def vertex_deviation(results: DataFrame) -> DataFrame:
    """Distance of each vertex from the line between its neighbours: what a simplification would lose."""
    v = bases_of(results).select("result_id", "base_no", F.filter("polygon_vertices", lambda p: p.isNotNull()).alias("v")).where("size(v) >= 3")
    at = lambda i: F.element_at("v", (F.pmod(i, F.size("v")) + 1).cast("int"))
    d = F.transform("v", lambda p, i: S.segment_distance(*(x.cast("double") for x in (p["x"], p["y"], at(i - 1)["x"], at(i - 1)["y"], at(i + 1)["x"], at(i + 1)["y"]))))
    return v.select("result_id", "base_no", F.posexplode(d).alias("vertex_no", "d")).select("result_id", "base_no", "vertex_no", F.round("d", 6).alias("deviation"))


def start_clocks(metadata: DataFrame) -> DataFrame:
    """Angle, sector hour, continuous and nearest dial hour of each start location."""
    s = uploads_once(metadata).select("replay_id", "width_tiles", "height_tiles", F.posexplode("start_locations").alias("start_no", "s")).where("s.x is not null and s.y is not null and width_tiles > 0 and height_tiles > 0")
    a = S.ray_angle(F.col("width_tiles"), F.col("height_tiles"), F.col("s.x"), F.col("s.y"))
    h = S.dial_value(a)
    return s.select("replay_id", "start_no", F.round(a, 6).alias("angle"), S.sector_hour(a).alias("sector_hour"), F.round(h, 6).alias("dial"), S.nearest_hour(h).cast("int").alias("dial_hour"), F.round(S.dial_separation(h, S.sector_hour(a)), 6).alias("apart"))


# ---- windows and names ----------------------------------------------------------------------------------------------


def unique_names(metadata: DataFrame, results: DataFrame) -> DataFrame:
    """Names of plain expansions: by hour, row and column; the farthest of an hour is outer, repeats are numbered.

    Far is far from the middle of the upload's map; where the upload or its size is unknown, from the middle of the expansions.
    """
    b = bases_of(results).where("not is_start and kind = 'expa' and clock is not null and center_tile.x is not null and center_tile.y is not null").select("result_id", "base_no", "clock", F.col("center_tile.x").alias("x"), F.col("center_tile.y").alias("y"))
    keys = results.select("result_id", "replay_id").where("replay_id is not null").dropDuplicates(["result_id"])
    m = metadata.select("replay_id", "width_tiles", "height_tiles").where("width_tiles > 0 and height_tiles > 0").join(keys, "replay_id", "left_semi").dropDuplicates(["replay_id"])
    b = b.join(keys.join(m, "replay_id").select("result_id", "width_tiles", "height_tiles"), "result_id", "left")
    hour = Window.partitionBy("result_id", "clock")
    mid = Window.partitionBy("result_id")
    far = (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my"))
    middle = lambda size, c: F.coalesce(F.col(size) * 2.0, (F.min(c).over(mid) + F.max(c).over(mid)) / 2)
    n = b.withColumn("mx", middle("width_tiles", "x")).withColumn("my", middle("height_tiles", "y")).withColumn("far", far)
    n = n.withColumn("rank", F.row_number().over(hour.orderBy(F.desc("far"), "base_no"))).withColumn("base_name", F.concat(F.when(F.col("rank") > 1, "inner ").otherwise(""), F.lit("expa "), F.col("clock").cast("string")))
    again = F.row_number().over(Window.partitionBy("result_id", "base_name").orderBy("y", "x", "base_no"))
    n = n.withColumn("k", again)
    return n.select("result_id", "base_no", F.when(F.col("k") > 1, F.concat("base_name", F.lit(" ("), F.col("k").cast("string"), F.lit(")"))).otherwise(F.col("base_name")).alias("unique_name"), (F.count("*").over(hour) > 1).alias("hour_shared"))


def natural_names(results: DataFrame) -> DataFrame:
    """The label of each natural by the hours of the starts that link to it."""
    b = bases_of(results)
    s = b.where("is_start and natural_expansion is not null and natural_expansion <> ''").groupBy("result_id", F.col("natural_expansion").alias("name")).agg(F.collect_set("clock").alias("hours"))
    return s.select("result_id", "name", S.natural_label(F.col("hours")).alias("label"))


def duplicate_names(results: DataFrame) -> DataFrame:
    return bases_of(results).where("name is not null").groupBy("result_id", "name").agg(F.count("*").alias("copies")).where("copies > 1")


def distinct_chokes(results: DataFrame) -> DataFrame:
    """Chokes of a base without those that repeat one already kept at nearly the same spot: a fold over the ordered list."""
    apart = lambda a, b: F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"])
    kind = "array<struct<x:int,y:int>>"
    centers = F.transform(F.filter("chokes", lambda c: c.isNotNull() & c["center"].isNotNull()), lambda c: c["center"])
    kept = F.aggregate(
        F.col("c"), F.array().cast(kind),
        lambda acc, p: F.when(F.exists(acc, lambda k: apart(k, p) <= K.CHOKE_APART), acc).otherwise(F.concat(acc, F.array(p))),
    )
    b = bases_of(results).where("chokes is not null").select("result_id", "base_no", centers.alias("c")).where("size(c) > 0")
    return b.select("result_id", "base_no", F.size("c").alias("chokes"), F.posexplode(kept).alias("kept_no", "p")).select("result_id", "base_no", "chokes", "kept_no", "p.x", "p.y")


# ---- counters and comparisons ---------------------------------------------------------------------------------------


def semantic_counters(results: DataFrame) -> DataFrame:
    """Per result: bases at hour 0, starts with a choke, starts choked to their own natural, whether every start has one."""
    r = once(results)
    starts = F.filter(F.coalesce("starting_locations", F.array()), lambda b: b.isNotNull())
    rest = F.filter(F.coalesce("expansions", F.array()), lambda b: b.isNotNull())
    chokes = lambda b: F.filter(F.coalesce(b["chokes"], F.array()), lambda c: c.isNotNull())
    true = lambda c: F.coalesce(c, F.lit(False))
    has = lambda b: true(b["natural_expansion"] != "")
    count = lambda a, f: F.size(F.filter(a, f))
    return r.select(
        "result_id", F.size(starts).alias("starts"), F.size(rest).alias("expansions"),
        (count(starts, lambda b: true(b["clock"] == 0)) + count(rest, lambda b: true(b["clock"] == 0))).alias("hour_0"),
        (F.size(F.filter(starts, lambda b: ~has(b))) == 0).alias("every_start_has_natural"),
        count(starts, lambda b: F.size(chokes(b)) > 0).alias("starts_with_choke"),
        count(starts, lambda b: has(b) & F.exists(chokes(b), lambda c: true(c["connects_to"] == b["natural_expansion"]))).alias("starts_choked_to_natural"),
    )


def center_bases(metadata: DataFrame, results: DataFrame) -> DataFrame:
    """Bases whose centre lies within the circle about the map's middle."""
    j = _with_results(metadata, results).where("width_tiles > 0 and height_tiles > 0")
    r = K.CENTER_MERGE * F.least("width_tiles", "height_tiles") * 32.0
    inner = F.filter("bases", lambda b: S.distance(b["x"], b["y"], F.col("width_tiles") * 16.0, F.col("height_tiles") * 16.0) <= r)
    return j.select("result_id", F.size("bases").alias("bases"), F.size(inner).alias("center_bases"))


def key_difference(metadata: DataFrame, results: DataFrame) -> DataFrame:
    """Map keys that only one side has, both ways."""
    k = lambda d, side: d.select(S.map_key(F.col("map_name")).alias("map_key"), F.lit(side).alias("side")).where("map_key <> ''").distinct()
    both = k(metadata, "uploads").unionByName(k(results, "results"))
    return both.groupBy("map_key").agg(F.min("side").alias("side"), F.count("*").alias("n")).where("n = 1").select("map_key", "side")


def compare(golden: DataFrame, current: DataFrame, key: str = "map_key") -> DataFrame:
    """Full comparison of two sets of bases by (key, name): missing, extra, changed, drifted or equal.

    ``golden`` and ``current``: key, name, kind, clock, mineral_only, natural_expansion, x, y, polygon.
    """
    from tilewright.operators import shapes

    same = ["kind", "clock", "mineral_only", "natural_expansion"]
    g = golden.select(key, "name", *(F.col(c).alias(f"g_{c}") for c in (*same, "x", "y", "polygon")), F.lit(True).alias("g"))
    c = current.select(key, "name", *(F.col(c).alias(f"c_{c}") for c in (*same, "x", "y", "polygon")), F.lit(True).alias("c"))
    j = g.join(c, [key, "name"], "full_outer")
    changed = ~F.array_min(F.array(*(F.col(f"g_{x}").eqNullSafe(F.col(f"c_{x}")) for x in same)))
    drift = S.distance(F.col("g_x"), F.col("g_y"), F.col("c_x"), F.col("c_y"))
    j = j.withColumn("drift", F.round(drift, 6)).withColumn("iou", F.round(shapes.iou(F.col("g_polygon"), F.col("c_polygon")), 6))
    verdict = F.when(F.col("c").isNull(), "missing").when(F.col("g").isNull(), "extra").when(changed, "changed").when((F.coalesce("drift", F.lit(0.0)) > K.DRIFT_MOST) | (F.col("iou") < K.IOU_LEAST), "drifted").otherwise("equal")
    return j.select(key, "name", verdict.alias("verdict"), "drift", "iou")


# ---- digest ---------------------------------------------------------------------------------------------------------


def digest(results: DataFrame, key: str = "result_id") -> DataFrame:
    """The Markdown section of each result (headings are fixed values): title, duplicate names, starts with naturals, expansions with their starts."""
    r = results.select(*dict.fromkeys(["result_id", key]), "map_name", "starting_locations", "expansions").dropDuplicates(["result_id"])
    starts = F.filter(F.coalesce("starting_locations", F.array()), lambda b: b.isNotNull())
    rest = F.filter(F.coalesce("expansions", F.array()), lambda b: b.isNotNull())
    text = lambda c: F.coalesce(c, F.lit(""))
    dash = lambda c: F.when(text(c) == "", "—").otherwise(S.md_cell(text(c)))
    names = F.concat(F.transform(starts, lambda b: text(b["name"])), F.transform(rest, lambda b: text(b["name"])))
    dupes = F.array_sort(F.array_distinct(F.filter(names, lambda n: F.size(F.filter(names, lambda m: m == n)) > 1)))
    title = S.clean_title(text(F.col("map_name")))
    links = lambda b: F.array_join(F.array_sort(F.transform(F.filter(starts, lambda s: (text(s["natural_expansion"]) != "") & (s["natural_expansion"] == b["name"])), lambda s: text(s["name"]))), ", ")
    rows = lambda a, f: F.array_join(F.transform(a, f), "")
    return r.select(
        "result_id",
        F.concat(
            F.lit("## "), F.when(title == "", F.col(key).cast("string")).otherwise(title), F.lit("\n\n- **JSON key:** `"), F.col(key).cast("string"), F.lit("`\n- **Duplicate base names:** "),
            F.when(F.size(dupes) == 0, "none").otherwise(F.array_join(F.transform(dupes, lambda d: F.concat(F.lit("`"), d, F.lit("`"))), ", ")),
            F.lit("\n\n### Starts\n\n| Name | Natural expansion |\n|------|--------------------|\n"),
            rows(starts, lambda b: F.concat(F.lit("| "), S.md_cell(text(b["name"])), F.lit(" | "), dash(b["natural_expansion"]), F.lit(" |\n"))),
            F.lit("\n### Expansions and naturals\n\n| Name | Kind | Linked from starts (natural of) |\n|------|------|-----------------------------------|\n"),
            rows(rest, lambda b: F.concat(F.lit("| "), S.md_cell(text(b["name"])), F.lit(" | "), S.md_cell(text(b["kind"])), F.lit(" | "), dash(links(b)), F.lit(" |\n"))),
            F.lit("\n"),
        ).alias("section"),
        F.size(dupes).alias("duplicates"),
    )


# ---- tiles as rows --------------------------------------------------------------------------------------------------


def minitile_rows(grids: DataFrame, attributes: DataFrame) -> DataFrame:
    """Every minitile as a row: catalog_id, x, y, feat, elev. Unknown tiles are feature 0, elevation 0.

    The attributes are the lookup side, broadcast while they are few.
    """
    table = F.create_map(*(F.lit(x) for kv in K.TILESET_FOLDERS.items() for x in kv))
    slug = F.regexp_replace(F.regexp_replace(F.lower("tileset_key"), "^[0-9][0-9]-", ""), "-missing-era$", "")
    t = checked_tiles(grids).where("error is null").select("catalog_id", "width_tiles", "height_tiles", F.element_at(table, slug).alias("folder"), F.posexplode("tiles").alias("i", "tile_id"))
    minis = attributes.groupBy("folder", "tile_id").agg(F.map_from_entries(F.collect_list(F.struct("mini", F.struct("feat", "elev")))).alias("m"))
    j = t.join(beside(minis, LOOKUP), ["folder", "tile_id"], "left")
    e = j.select("catalog_id", "width_tiles", "height_tiles", "i", "m", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    return e.select(
        "catalog_id", (F.col("width_tiles") * 4).alias("w"), (F.col("height_tiles") * 4).alias("h"),
        (F.expr("i % width_tiles") * 4 + F.expr("k % 4")).alias("x"), (F.expr("i div width_tiles").cast("int") * 4 + F.expr("k div 4").cast("int")).alias("y"),
        F.coalesce(F.element_at("m", F.col("k")).getField("feat"), F.lit(0)).cast("int").alias("feat"), F.coalesce(F.element_at("m", F.col("k")).getField("elev"), F.lit(0)).cast("int").alias("elev"),
    )


def tile_expansion(grids: DataFrame, attributes: DataFrame) -> DataFrame:
    """Per map and minitile row: cells and sums, the check that every minitile is there once."""
    return minitile_rows(grids, attributes).groupBy("catalog_id", "y").agg(
        F.count("*").alias("cells"), F.sum("x").alias("sum_x"), F.sum("feat").alias("sum_feat"), F.sum(F.col("feat") * F.col("x")).alias("feat_moment"), F.sum("elev").alias("sum_elev")
    )


def masks(grids: DataFrame, attributes: DataFrame) -> DataFrame:
    """Per map: passable, ramp and wall cells, and those free for naturals: passable and not on the outer ring."""
    ok, x, y = S.is_passable(F.col("feat")), F.col("x"), F.col("y")
    ring = (x == 0) | (y == 0) | (x == F.col("w") - 1) | (y == F.col("h") - 1)
    return minitile_rows(grids, attributes).groupBy("catalog_id").agg(
        F.count_if(ok).alias("passable"), F.count_if(S.is_ramp(F.col("feat"))).alias("ramp"), F.count_if(~ok).alias("wall"), F.count_if(ok & ~ring).alias("free")
    )


def box_downsample(grids: DataFrame, most: int = 64) -> DataFrame:
    """Box averages of the tile numbers at the smallest power of two that fits; remainders at the edges are dropped."""
    g = checked_tiles(grids).where("error is null").withColumn("f", S.downsample_factor(F.col("width_tiles"), F.col("height_tiles"), F.lit(most)))
    c = g.select("catalog_id", "width_tiles", "height_tiles", "f", F.posexplode("tiles").alias("i", "v")).select("catalog_id", "f", "v", F.expr("i % width_tiles").alias("x"), F.expr("i div width_tiles").alias("y"), "width_tiles", "height_tiles")
    c = c.where("x < (width_tiles div f) * f and y < (height_tiles div f) * f")
    return c.groupBy("catalog_id", F.expr("x div f").alias("x"), F.expr("y div f").alias("y")).agg(F.expr("sum(v) div first(f * f)").alias("v"))


def area_pairs(grids: DataFrame) -> DataFrame:
    """Neighbouring tile numbers: how often each unordered pair meets along rows; a histogram by pair."""
    g = checked_tiles(grids).where("error is null").select("catalog_id", "width_tiles", F.posexplode("tiles").alias("i", "t"))
    nxt = F.lead("t").over(Window.partitionBy("catalog_id", F.expr("i div width_tiles")).orderBy("i"))
    p = g.withColumn("n", nxt).where("n is not null and n <> t").select("catalog_id", F.least("t", "n").alias("a"), F.greatest("t", "n").alias("b"))
    return p.groupBy("catalog_id", "a", "b").agg(F.count("*").alias("meets"))
