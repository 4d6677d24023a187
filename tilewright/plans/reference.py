"""Queries of the map-geometry operators over the given tables, whole, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import scalar as S
from tilewright.operators import cluster as C
from tilewright.operators import relational as R
from tilewright.operators import units
from tilewright.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_BASES = """r AS (SELECT result_id, any_value(replay_id) AS replay_id, any_value(map_name) AS map_name, any_value(starting_locations) AS s, any_value(expansions) AS e FROM map_results GROUP BY result_id),
l AS (SELECT result_id, replay_id, list_concat(list_transform(coalesce(s, []), lambda b: {'is_start': true, 'b': b}), list_transform(coalesce(e, []), lambda b: {'is_start': false, 'b': b})) AS bs FROM r),
x AS (SELECT result_id, replay_id, unnest(bs) AS u, generate_subscripts(bs, 1) - 1 AS base_no FROM l WHERE len(bs) > 0),
b AS (SELECT result_id, replay_id, base_no::INT AS base_no, u.is_start AS is_start, u.b.name AS name, u.b.kind AS kind, u.b.clock AS clock, u.b.center_tile AS c, u.b.polygon_vertices AS v,
 u.b.natural_expansion AS nat, u.b.chokes AS chokes FROM x WHERE u.b IS NOT NULL)
"""
_UPLOADS = "m AS (SELECT replay_id, any_value(width_tiles) AS w, any_value(height_tiles) AS h, any_value(mineral_fields) AS minerals, any_value(geysers) AS geysers, any_value(start_locations) AS starts FROM map_metadata GROUP BY replay_id)"
_ANGLE = "(degrees(atan2({y} - h * 16.0, {x} - w * 16.0)) + CASE WHEN degrees(atan2({y} - h * 16.0, {x} - w * 16.0)) < 0 THEN 360.0 ELSE 0 END)"
_HOUR = "CASE WHEN a >= 337.5 OR a < 22.5 THEN 3 WHEN a < 67.5 THEN 5 WHEN a < 112.5 THEN 6 WHEN a < 157.5 THEN 7 WHEN a < 202.5 THEN 9 WHEN a < 247.5 THEN 11 WHEN a < 292.5 THEN 12 ELSE 1 END"
_KEY = r"trim(regexp_replace(lower(regexp_replace(regexp_replace({0}, '[\x00-\x1f]', '', 'g'), '[^\p{{L}}\p{{N}}\s\p{{Z}}\x{{85}}_./-]', '', 'g')), '[\s\p{{Z}}\x{{85}}_./-]+', '-', 'g'), '-')"
_SLUG = "trim(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '-', 'g'), '-')"


#: Edits between two keys, code point by code point, as a fold of folds over lists.
_CHARS = "regexp_extract_all({0}, '(?s).')"
_EDITS = """list_reduce(list_transform({a}, lambda fp: {{'c': fp, 'r': []::INT[]}}), lambda fu, fe: {{'c': fe.c, 'r': list_reduce(list_transform({b}, lambda fq: {{'c': fq, 'r': []::INT[]}}),
 lambda fv, fy: {{'c': fy.c, 'r': list_append(fv.r, least(fu.r[len(fv.r) + 1] + 1, fv.r[len(fv.r)] + 1, fu.r[len(fv.r)] + CASE WHEN fy.c = fe.c THEN 0 ELSE 1 END)::INT)}}, {{'c': '', 'r': [(fu.r[1] + 1)::INT]}}).r}}, {{'c': '', 'r': range(0, len({b}) + 1)::INT[]}}).r[-1]"""


# ---- scalars --------------------------------------------------------------------------------------------------------


@query(f"SELECT replay_id, {_KEY.format('map_name')} AS name_key, {_KEY.format('map_data_name')} AS data_key FROM map_metadata")
def norm_key(spark, d):
    m = table(spark, d, "map_metadata")
    return m.select("replay_id", S.map_key(F.col("map_name")).alias("name_key"), S.map_key(F.col("map_data_name")).alias("data_key"))


@query(f"SELECT replay_id, {_SLUG.format('map_name')} AS name_slug, {_SLUG.format('replay_path')} AS path_slug FROM map_metadata")
def ascii_slug(spark, d):
    m = table(spark, d, "map_metadata")
    return m.select("replay_id", S.ascii_slug(F.col("map_name")).alias("name_slug"), S.ascii_slug(F.col("replay_path")).alias("path_slug"))


@query(r"""SELECT replay_id, lpad(tileset::VARCHAR, 2, '0') || '-' || coalesce(nullif(trim(regexp_replace(lower(n), '[^\p{L}\p{Nd}]+', '-', 'g'), '-'), ''), 'unknown') AS own_key,
 CASE regexp_replace(regexp_replace(lower(trim(tileset_key)), '^[0-9][0-9]-', ''), '-missing-era$', '') WHEN 'badlands' THEN 'badlands' WHEN 'space-platform' THEN 'platform' WHEN 'platform' THEN 'platform'
 WHEN 'install' THEN 'install' WHEN 'installation' THEN 'install' WHEN 'ashworld' THEN 'ashworld' WHEN 'jungle' THEN 'jungle' WHEN 'desert' THEN 'desert' WHEN 'arctic' THEN 'ice' WHEN 'ice' THEN 'ice'
 WHEN 'twilight' THEN 'twilight' WHEN 'unknown' THEN 'badlands' END AS folder
 FROM (SELECT *, coalesce(nullif(trim(lower(tileset_name)), ''), 'unknown') || CASE WHEN tile_set_missing THEN '-missing-era' ELSE '' END AS n FROM map_metadata)""")
def tileset_key(spark, d):
    m = table(spark, d, "map_metadata")
    return m.select("replay_id", S.tileset_key(F.col("tileset"), F.col("tileset_name"), F.col("tile_set_missing")).alias("own_key"), S.tileset_folder(F.col("tileset_key")).alias("folder"))


@query(f"""WITH k AS (SELECT replay_id, {_KEY.format('map_name')} AS a, {_KEY.format('map_data_name')} AS b FROM map_metadata), p AS (SELECT DISTINCT a, b, {_CHARS.format('a')} AS ca, {_CHARS.format('b')} AS cb FROM k WHERE a <> '' AND b <> '' AND a <> b),
e AS (SELECT a, b, {_EDITS.format(a='ca', b='cb')} AS n, greatest(len(ca), len(cb)) AS longest FROM p)
SELECT replay_id, round(CASE WHEN k.a = '' OR k.b = '' THEN 0.0 WHEN k.a = k.b THEN 1.0 ELSE 1.0 - n / longest::DOUBLE END, 6) AS similarity FROM k LEFT JOIN e ON e.a = k.a AND e.b = k.b""")
def name_similarity(spark, d):
    """Likeness of the typed name and the name in the file, by characters."""
    m = table(spark, d, "map_metadata").select("replay_id", S.map_key(F.col("map_name")).alias("a"), S.map_key(F.col("map_data_name")).alias("b"))
    return m.select("replay_id", F.round(S.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"""WITH {_UPLOADS}, s AS (SELECT replay_id, w, h, unnest(starts) AS p, generate_subscripts(starts, 1) - 1 AS start_no FROM m WHERE len(starts) > 0),
a AS (SELECT *, {_ANGLE.format(x='p.x', y='p.y')} AS a FROM s WHERE p.x IS NOT NULL AND p.y IS NOT NULL AND w > 0 AND h > 0),
h AS (SELECT *, {_HOUR} AS sector_hour, CASE WHEN a / 30.0 + 3.0 > 12.0 THEN a / 30.0 - 9.0 ELSE a / 30.0 + 3.0 END AS dial FROM a)
SELECT replay_id, start_no::INT AS start_no, round(a, 6) AS angle, sector_hour::INT AS sector_hour, round(dial, 6) AS dial,
 (SELECT arg_min(k, (least(abs(dial % 12.0 - k % 12), 12.0 - abs(dial % 12.0 - k % 12)), k)) FROM range(1, 13) t(k))::INT AS dial_hour,
 round(least(abs(dial % 12.0 - sector_hour % 12), 12.0 - abs(dial % 12.0 - sector_hour % 12)), 6) AS apart FROM h""")
def start_clocks(spark, d):
    return R.start_clocks(table(spark, d, "map_metadata"))


@query(f"""WITH {_BASES}, p AS (SELECT result_id, base_no, list_filter(v, lambda q: q IS NOT NULL) AS v FROM b WHERE v IS NOT NULL),
e AS (SELECT result_id, base_no, unnest(v) AS p, v[(generate_subscripts(v, 1) - 2 + len(v)) % len(v) + 1] AS a, v[generate_subscripts(v, 1) % len(v) + 1] AS q, generate_subscripts(v, 1) - 1 AS vertex_no FROM p WHERE len(v) >= 3),
t AS (SELECT *, (q.x - a.x) * (q.x - a.x) + (q.y - a.y) * (q.y - a.y) AS l2 FROM e),
u AS (SELECT *, CASE WHEN l2 = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, ((p.x - a.x) * (q.x - a.x) + (p.y - a.y) * (q.y - a.y))::DOUBLE / l2)) END AS k FROM t)
SELECT result_id, base_no, vertex_no::INT AS vertex_no, round(sqrt(pow(p.x - a.x - k * (q.x - a.x), 2) + pow(p.y - a.y - k * (q.y - a.y), 2)), 6) AS deviation FROM u""")
def segment_distance(spark, d):
    return R.vertex_deviation(table(spark, d, "map_results"))


@query(f"""WITH {_BASES}, p AS (SELECT result_id, base_no, c.x + 0.5 AS px, c.y + 0.5 AS py, list_filter(v, lambda q: q IS NOT NULL) AS v FROM b WHERE v IS NOT NULL),
e AS (SELECT result_id, base_no, px, py, unnest(v) AS a, v[generate_subscripts(v, 1) % len(v) + 1] AS q FROM p WHERE len(v) > 0),
g AS (SELECT result_id, base_no, count(*) AS n, sum(a.x::DOUBLE * q.y - q.x::DOUBLE * a.y) * 0.5 AS area, sum((a.x + q.x) * (a.x::DOUBLE * q.y - q.x::DOUBLE * a.y)) AS sx, sum((a.y + q.y) * (a.x::DOUBLE * q.y - q.x::DOUBLE * a.y)) AS sy,
 min(a.x) AS min_x, max(a.x) AS max_x, min(a.y) AS min_y, max(a.y) AS max_y, avg(a.x) AS mx, avg(a.y) AS my,
 count(*) FILTER ((a.y > py) <> (q.y > py) AND px < (q.x - a.x) * (py - a.y) / nullif((q.y - a.y)::DOUBLE, 0) + a.x) AS hits FROM e GROUP BY result_id, base_no)
SELECT p.result_id, p.base_no, round(CASE WHEN n < 3 THEN mx WHEN area = 0 THEN (min_x + max_x) / 2.0 ELSE sx / (6 * area) END, 6) AS center_x, round(CASE WHEN n < 3 THEN my WHEN area = 0 THEN (min_y + max_y) / 2.0 ELSE sy / (6 * area) END, 6) AS center_y,
 min_x, min_y, max_x, max_y, coalesce(hits, 0) % 2 = 1 AS holds_center FROM p LEFT JOIN g USING (result_id, base_no)""")
def polygon_stats(spark, d):
    return R.polygon_stats(table(spark, d, "map_results"))


# ---- scans and selection --------------------------------------------------------------------------------------------


@query(r"""SELECT DISTINCT regexp_replace(replay_path, '[\\/]+', '/', 'g') AS path, string_split(regexp_replace(replay_path, '[\\/]+', '/', 'g'), '/')[-1] AS file FROM map_metadata WHERE lower(replay_path) LIKE '%.rep'""")
def replay_files(spark, d):
    return R.replay_files(table(spark, d, "map_metadata"))


@query("""SELECT catalog_id, width_tiles, height_tiles, tileset_key, CASE WHEN width_tiles * height_tiles > 0 AND coalesce(len(tiles), 0) >= width_tiles * height_tiles THEN tiles[1:width_tiles * height_tiles] END AS tiles,
 CASE WHEN coalesce(width_tiles * height_tiles, 0) <= 0 THEN 'invalid map dimensions' WHEN coalesce(len(tiles), 0) < width_tiles * height_tiles THEN 'tile grid mismatch' END AS error FROM map_grids""")
def checked_tiles(spark, d):
    return R.checked_tiles(table(spark, d, "map_grids"))


_SELECT = f"WITH k AS (SELECT coalesce(nullif({_SLUG.format('map_name')}, ''), nullif({_SLUG.format('map_data_name')}, '')) AS map_key, {_SLUG.format('map_data_name')} AS data_key, replay_path, replay_id FROM map_metadata)"


@query(f"""{_SELECT} SELECT map_key, arg_min(replay_path, (replay_path, replay_id)) AS replay_path, arg_min(replay_id, (replay_path, replay_id)) AS replay_id, count(DISTINCT replay_id) AS uploads FROM k WHERE map_key IS NOT NULL GROUP BY map_key""")
def corpus_dedupe(spark, d):
    return R.first_per_key(table(spark, d, "map_metadata"))


@query(f"""{_SELECT} SELECT map_key, arg_min(replay_path, (replay_path, replay_id)) AS replay_path, arg_min(replay_id, (replay_path, replay_id)) AS replay_id FROM k WHERE map_key IS NOT NULL AND (map_key = 'wandering-refinery' OR data_key = 'wandering-refinery') GROUP BY map_key""")
def select_maps(spark, d):
    return R.select_maps(table(spark, d, "map_metadata"), "Wandering Refinery")


# ---- nearest, radii, names ------------------------------------------------------------------------------------------

_JOINED = f"""WITH {_BASES}, {_UPLOADS}, g AS (SELECT result_id, replay_id, row_number() OVER (PARTITION BY result_id ORDER BY base_no) - 1 AS base_no, name, c.x * 8.0 AS x, c.y * 8.0 AS y FROM b WHERE c.x IS NOT NULL AND c.y IS NOT NULL),
"""


@query(_JOINED + f"""s AS (SELECT r.result_id, w, h, unnest(starts) AS p, generate_subscripts(starts, 1) - 1 AS start_no FROM r JOIN m USING (replay_id) WHERE len(starts) > 0),
n AS (SELECT s.result_id, start_no, any_value(w) AS w, any_value(h) AS h, arg_min(g, (sqrt((p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y)), g.base_no)) AS g, min(sqrt((p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y))) AS dist
 FROM s JOIN g ON s.result_id = g.result_id WHERE p.x IS NOT NULL AND p.y IS NOT NULL GROUP BY s.result_id, start_no),
a AS (SELECT *, {_ANGLE.format(x='g.x', y='g.y')} AS a FROM n)
SELECT result_id, start_no::INT AS start_no, g.base_no::INT AS base_no, g.name AS base_name, round(dist, 6) AS distance, {_HOUR}::INT AS hour FROM a""")
def nearest_base(spark, d):
    return R.nearest_base(table(spark, d, "map_metadata"), table(spark, d, "map_results"))


@query(_JOINED + """y AS (SELECT r.result_id, unnest(geysers) AS p, generate_subscripts(geysers, 1) AS k FROM r JOIN m USING (replay_id) WHERE len(geysers) > 0),
o AS (SELECT y.result_id, k, arg_min(g.base_no, (sqrt((p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y)), g.base_no)) AS base_no, min(sqrt((p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y))) AS dist
 FROM y JOIN g ON y.result_id = g.result_id WHERE p.x IS NOT NULL AND p.y IS NOT NULL GROUP BY y.result_id, k)
SELECT g.result_id, g.base_no::INT AS base_no, g.name AS base_name, NOT EXISTS (SELECT 1 FROM o WHERE o.result_id = g.result_id AND o.base_no = g.base_no AND dist <= 400) AS mineral_only
FROM g JOIN r USING (result_id) WHERE r.replay_id IN (SELECT replay_id FROM m)""")
def mineral_only(spark, d):
    return R.mineral_only(table(spark, d, "map_metadata"), table(spark, d, "map_results"))


@query(f"""WITH {_BASES}, g AS (SELECT result_id, base_no, name, c.x * 8.0 AS x, c.y * 8.0 AS y FROM b WHERE c.x IS NOT NULL AND c.y IS NOT NULL)
SELECT g.result_id, g.base_no, any_value(g.name) AS name, round(min(sqrt((g.x - o.x) * (g.x - o.x) + (g.y - o.y) * (g.y - o.y)) / 2) * 0.98, 6) AS most_radius
FROM g LEFT JOIN g o ON g.result_id = o.result_id AND g.base_no <> o.base_no GROUP BY g.result_id, g.base_no""")
def base_radii(spark, d):
    return R.base_radii(table(spark, d, "map_results"))


@query(f"""WITH {_BASES}, {_UPLOADS}, p AS (SELECT result_id, base_no, clock, c.x AS x, c.y AS y, m.w AS w0, m.h AS h0 FROM b LEFT JOIN m ON m.replay_id = b.replay_id AND m.w > 0 AND m.h > 0
 WHERE NOT is_start AND kind = 'expa' AND clock IS NOT NULL AND c.x IS NOT NULL AND c.y IS NOT NULL),
f AS (SELECT *, coalesce(w0 * 2.0, (min(x) OVER w + max(x) OVER w) / 2.0) AS mx, coalesce(h0 * 2.0, (min(y) OVER w + max(y) OVER w) / 2.0) AS my FROM p WINDOW w AS (PARTITION BY result_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY result_id, clock ORDER BY (x - mx) * (x - mx) + (y - my) * (y - my) DESC, base_no) AS rank, count(*) OVER (PARTITION BY result_id, clock) > 1 AS hour_shared FROM f),
n AS (SELECT *, CASE WHEN rank > 1 THEN 'inner ' ELSE '' END || 'expa ' || clock AS base_name FROM k),
u AS (SELECT *, row_number() OVER (PARTITION BY result_id, base_name ORDER BY y, x, base_no) AS again FROM n)
SELECT result_id, base_no, base_name || CASE WHEN again > 1 THEN ' (' || again || ')' ELSE '' END AS unique_name, hour_shared FROM u""")
def unique_names(spark, d):
    return R.unique_names(table(spark, d, "map_metadata"), table(spark, d, "map_results"))


@query(f"""WITH {_BASES}, s AS (SELECT result_id, nat AS name, list_sort(list_distinct(list(clock) FILTER (clock IS NOT NULL))) AS h FROM b WHERE is_start AND nat IS NOT NULL AND nat <> '' GROUP BY result_id, nat)
SELECT result_id, name, CASE WHEN coalesce(len(h), 0) = 0 THEN 'natural' WHEN len(h) = 1 THEN 'natural of ' || h[1] ELSE 'natural of ' || array_to_string(h[1:len(h) - 1], ', ') || ' & ' || h[len(h)] END AS label FROM s""")
def natural_names(spark, d):
    return R.natural_names(table(spark, d, "map_results"))


@query(f"WITH {_BASES} SELECT result_id, name, count(*) AS copies FROM b WHERE name IS NOT NULL GROUP BY result_id, name HAVING count(*) > 1")
def dup_names(spark, d):
    return R.duplicate_names(table(spark, d, "map_results"))


@query(f"""WITH RECURSIVE {_BASES}, p AS (SELECT result_id, base_no, list_transform(list_filter(chokes, lambda ch: ch IS NOT NULL AND ch.center IS NOT NULL), lambda ch: ch.center) AS c FROM b WHERE chokes IS NOT NULL),
f AS (SELECT result_id, base_no, c, 1 AS i, CASE WHEN false THEN c ELSE [] END AS kept FROM p WHERE len(c) > 0
 UNION ALL SELECT result_id, base_no, c, i + 1, CASE WHEN len(list_filter(kept, lambda k: abs(k.x - c[i].x) + abs(k.y - c[i].y) <= 8)) > 0 THEN kept ELSE list_append(kept, c[i]) END FROM f WHERE i <= len(c)),
z AS (SELECT result_id, base_no, len(c) AS chokes, kept FROM f WHERE i = len(c) + 1),
q AS (SELECT result_id, base_no, chokes::INT AS chokes, unnest(kept) AS p, generate_subscripts(kept, 1) - 1 AS kept_no FROM z)
SELECT result_id, base_no, chokes, kept_no::INT AS kept_no, p.x AS x, p.y AS y FROM q""")
def choke_dedupe(spark, d):
    return R.distinct_chokes(table(spark, d, "map_results"))


# ---- counters -------------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT result_id, list_filter(coalesce(any_value(starting_locations), []), lambda b: b IS NOT NULL) AS s, list_filter(coalesce(any_value(expansions), []), lambda b: b IS NOT NULL) AS e FROM map_results GROUP BY result_id)
SELECT result_id, len(s)::INT AS starts, len(e)::INT AS expansions, (len(list_filter(s, lambda b: b.clock = 0)) + len(list_filter(e, lambda b: b.clock = 0)))::INT AS hour_0,
 len(list_filter(s, lambda b: coalesce(b.natural_expansion, '') = '')) = 0 AS every_start_has_natural,
 len(list_filter(s, lambda b: len(list_filter(b.chokes, lambda c: c IS NOT NULL)) > 0))::INT AS starts_with_choke,
 len(list_filter(s, lambda b: coalesce(b.natural_expansion, '') <> '' AND len(list_filter(b.chokes, lambda c: c.connects_to = b.natural_expansion)) > 0))::INT AS starts_choked_to_natural FROM r""")
def semantic_counters(spark, d):
    return R.semantic_counters(table(spark, d, "map_results"))


@query(_JOINED + """t AS (SELECT r.result_id, w, h FROM r JOIN m USING (replay_id) WHERE w > 0 AND h > 0)
SELECT t.result_id, count(g.base_no)::INT AS bases, (count(*) FILTER (sqrt((g.x - w * 16.0) * (g.x - w * 16.0) + (g.y - h * 16.0) * (g.y - h * 16.0)) <= 0.11 * least(w, h) * 32.0))::INT AS center_bases FROM t LEFT JOIN g USING (result_id) GROUP BY t.result_id""")
def center_bases(spark, d):
    return R.center_bases(table(spark, d, "map_metadata"), table(spark, d, "map_results"))


@query(f"""WITH u AS (SELECT DISTINCT {_KEY.format('map_name')} AS map_key FROM map_metadata), s AS (SELECT DISTINCT {_KEY.format('map_name')} AS map_key FROM map_results)
SELECT map_key, 'uploads' AS side FROM u WHERE map_key <> '' AND map_key NOT IN (SELECT map_key FROM s WHERE map_key IS NOT NULL) UNION ALL SELECT map_key, 'results' FROM s WHERE map_key <> '' AND map_key NOT IN (SELECT map_key FROM u WHERE map_key IS NOT NULL)""")
def key_difference(spark, d):
    return R.key_difference(table(spark, d, "map_metadata"), table(spark, d, "map_results"))


# ---- tiles ----------------------------------------------------------------------------------------------------------

_MINI = """t AS (SELECT catalog_id, width_tiles AS w, height_tiles AS h, CASE regexp_replace(regexp_replace(lower(tileset_key), '^[0-9][0-9]-', ''), '-missing-era$', '') WHEN 'space-platform' THEN 'platform' WHEN 'installation' THEN 'install' WHEN 'arctic' THEN 'ice' WHEN 'unknown' THEN 'badlands'
 ELSE regexp_replace(regexp_replace(lower(tileset_key), '^[0-9][0-9]-', ''), '-missing-era$', '') END AS folder, unnest(tiles[1:width_tiles * height_tiles]) AS tile_id, generate_subscripts(tiles[1:width_tiles * height_tiles], 1) - 1 AS i FROM map_grids WHERE len(tiles) >= width_tiles * height_tiles AND width_tiles * height_tiles > 0),
c AS (SELECT catalog_id, w * 4 AS w, h * 4 AS h, (i % w) * 4 + k % 4 AS x, (i // w) * 4 + k // 4 AS y, coalesce(a.feat, 0) AS feat, coalesce(a.elev, 0) AS elev FROM t, range(16) r(k) LEFT JOIN tile_attr a ON a.folder = t.folder AND a.tile_id = t.tile_id AND a.mini = k)
"""


@query(f"WITH {_MINI} SELECT catalog_id, y::INT AS y, count(*) AS cells, sum(x)::BIGINT AS sum_x, sum(feat)::BIGINT AS sum_feat, sum(feat * x)::BIGINT AS feat_moment, sum(elev)::BIGINT AS sum_elev FROM c GROUP BY catalog_id, y")
def tile_expand(spark, d):
    return R.tile_expansion(table(spark, d, "map_grids"), table(spark, d, "tile_attr"))


@query(f"WITH {_MINI} SELECT catalog_id, count(*) FILTER (feat & 3 <> 0) AS passable, count(*) FILTER (feat & 2 <> 0) AS ramp, count(*) FILTER (feat & 3 = 0) AS wall, count(*) FILTER (feat & 3 <> 0 AND x > 0 AND y > 0 AND x < w - 1 AND y < h - 1) AS free FROM c GROUP BY catalog_id")
def grid_masks(spark, d):
    return R.masks(table(spark, d, "map_grids"), table(spark, d, "tile_attr"))


@query("""WITH g AS (SELECT catalog_id, width_tiles AS w, height_tiles AS h, tiles[1:width_tiles * height_tiles] AS tiles, (SELECT min(2 ** k)::INT FROM range(0, 21) t(k) WHERE greatest(width_tiles, height_tiles) // (2 ** k)::INT <= 64) AS f FROM map_grids WHERE len(tiles) >= width_tiles * height_tiles AND width_tiles * height_tiles > 0),
c AS (SELECT catalog_id, w, h, f, unnest(tiles) AS v, generate_subscripts(tiles, 1) - 1 AS i FROM g)
SELECT catalog_id, (i % w) // f AS x, (i // w) // f AS y, sum(v)::BIGINT // any_value(f * f) AS v FROM c WHERE i % w < (w // f) * f AND i // w < (h // f) * f GROUP BY 1, 2, 3""")
def box_downsample(spark, d):
    return R.box_downsample(table(spark, d, "map_grids"))


@query("""WITH g AS (SELECT catalog_id, width_tiles AS w, unnest(tiles[1:width_tiles * height_tiles]) AS t, generate_subscripts(tiles[1:width_tiles * height_tiles], 1) - 1 AS i FROM map_grids WHERE len(tiles) >= width_tiles * height_tiles AND width_tiles * height_tiles > 0),
n AS (SELECT catalog_id, t, lead(t) OVER (PARTITION BY catalog_id, i // w ORDER BY i) AS n FROM g)
SELECT catalog_id, least(t, n) AS a, greatest(t, n) AS b, count(*) AS meets FROM n WHERE n IS NOT NULL AND n <> t GROUP BY 1, 2, 3""")
def area_pairs(spark, d):
    return R.area_pairs(table(spark, d, "map_grids"))


@query("SELECT folder, tile_id, mini, trunc(feat * 17 * (120 / 255.0::DOUBLE) + elev * 100 * (1.0 - 120 / 255.0::DOUBLE))::INT AS blended FROM tile_attr")
def alpha_blend(spark, d):
    t = table(spark, d, "tile_attr")
    return t.select("folder", "tile_id", "mini", S.blend(F.col("feat") * 17, F.lit(120), F.col("elev") * 100).alias("blended"))


@query("SELECT folder, tile_id, mini, ((feat::INT * 17 * (255 - elev::INT * 100) + least(255, 2 * (feat::INT * 17) * 200 // 255) * (elev::INT * 100)) // 255)::INT AS tinted FROM tile_attr")
def team_tint(spark, d):
    t = table(spark, d, "tile_attr")
    return t.select("folder", "tile_id", "mini", S.tint(F.col("feat").cast("int") * 17, F.col("elev").cast("int") * 100, F.lit(200)).alias("tinted"))


# ---- clustering -----------------------------------------------------------------------------------------------------

_POINTS = f"{_UPLOADS}, q AS (SELECT replay_id, w, h, list_filter(list_concat(coalesce(minerals, []), coalesce(geysers, [])), lambda p: p.x IS NOT NULL AND p.y IS NOT NULL) AS ps FROM m), p AS (SELECT replay_id, w, h, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS k FROM q WHERE len(ps) > 0)"


@query(f"""WITH {_POINTS}, d AS (SELECT a.replay_id, a.k, sqrt((a.p.x - b.p.x) * (a.p.x - b.p.x) + (a.p.y - b.p.y) * (a.p.y - b.p.y)) AS d FROM p a JOIN p b ON a.replay_id = b.replay_id AND a.k <> b.k),
s AS (SELECT replay_id, k, list_sort(list(d)) AS ds FROM d GROUP BY replay_id, k), t AS (SELECT replay_id, k, ds[least(3, len(ds))] AS scale FROM s)
SELECT replay_id, k::INT AS point, round(scale, 6) AS scale, round(quantile_cont(scale, 0.5) OVER (PARTITION BY replay_id), 6) AS median_scale FROM t""")
def knn_scale(spark, d):
    s = C.point_scales(R.uploads_once(table(spark, d, "map_metadata")))
    return s.select("replay_id", "point", F.round("scale", 6).alias("scale"), F.round("median_scale", 6).alias("median_scale"))


@query(f"""WITH {_POINTS}, l AS (SELECT replay_id, k, p, (p.x >= w * 16)::INT * 2 + (p.y >= h * 16)::INT AS q FROM p), n AS (SELECT replay_id, q, count(*) AS n FROM l GROUP BY replay_id, q),
d AS (SELECT a.replay_id, a.k, a.q AS own, b.q, sum(sqrt((a.p.x - b.p.x) * (a.p.x - b.p.x) + (a.p.y - b.p.y) * (a.p.y - b.p.y))) AS s FROM l a JOIN l b ON a.replay_id = b.replay_id GROUP BY a.replay_id, a.k, a.q, b.q),
m2 AS (SELECT d.replay_id, k, max(CASE WHEN own = d.q THEN CASE WHEN n > 1 THEN s / (n - 1) ELSE 0 END END) AS a, min(CASE WHEN own <> d.q THEN s / n END) AS b FROM d JOIN n ON n.replay_id = d.replay_id AND n.q = d.q GROUP BY d.replay_id, k)
SELECT replay_id, round(sum(CASE WHEN b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) / count(*), 6) AS silhouette FROM m2 GROUP BY replay_id""")
def silhouette(spark, d):
    s = C.quadrant_silhouette(R.uploads_once(table(spark, d, "map_metadata")))
    return s.select("replay_id", F.round("silhouette", 6).alias("silhouette"))


@query()
def mst_edges(spark, d):
    return C.tree_edges(R.uploads_once(table(spark, d, "map_metadata")))


@query()
def mst_cut_labels(spark, d):
    return C.point_labels(R.uploads_once(table(spark, d, "map_metadata")))


@query()
def detect_bases(spark, d):
    return C.bases(R.uploads_once(table(spark, d, "map_metadata")))


@query(f"""WITH {_BASES} SELECT result_id, count(*) AS bases, count(*) FILTER (is_start) AS starts, avg(c.x) AS mean_x, avg(c.y) AS mean_y, min(c.x) AS min_x, max(c.x) AS max_x FROM b GROUP BY result_id""")
def base_centroids(spark, d):
    return R.bases_of(table(spark, d, "map_results")).groupBy("result_id").agg(
        F.count("*").alias("bases"), F.count_if("is_start").alias("starts"), F.avg("center_tile.x").alias("mean_x"), F.avg("center_tile.y").alias("mean_y"), F.min("center_tile.x").alias("min_x"), F.max("center_tile.x").alias("max_x")
    )


@query()
def param_search(spark, d):
    """The parameters of the tree cuts that score best on each upload, with the number of clusters and the score."""
    p = C.point_labels(R.uploads_once(table(spark, d, "map_metadata")))
    return p.groupBy("replay_id").agg(F.first("alpha").alias("alpha"), F.first("beta").alias("beta"), F.first("clusters").alias("clusters"), F.round(F.first("score"), 6).alias("score"), F.count("*").alias("points"))


# ---- unit joins, over tables that stand for the game's ---------------------------------------------------------------


@query(r"""WITH q AS (SELECT DISTINCT map_name AS name FROM map_metadata UNION SELECT catalog_id::VARCHAR FROM map_grids), n AS (SELECT trim(regexp_replace(lower(canonical_name), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS key, min(catalog_id) AS by_name FROM map_catalog GROUP BY 1 HAVING key <> ''),
k AS (SELECT name, trim(name, ' ') AS raw, trim(regexp_replace(lower(name), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS key, regexp_full_match(trim(name, ' '), '[0-9]+') AS digits FROM q),
j AS (SELECT k.*, by_name, c.catalog_id AS by_id FROM k LEFT JOIN n USING (key) LEFT JOIN (SELECT DISTINCT catalog_id FROM map_catalog) c ON k.digits AND length(raw) <= 9 AND try_cast(raw AS BIGINT) = c.catalog_id),
u AS (SELECT *, CASE WHEN digits THEN by_id ELSE by_name END AS unit_id FROM j)
SELECT name, unit_id, CASE WHEN coalesce(raw, '') = '' THEN 'name is empty' WHEN unit_id IS NULL AND digits THEN 'no sprite for this id' WHEN unit_id IS NULL THEN 'unknown name' END AS error FROM u""")
def unit_resolve(spark, d):
    """Names and decimal ids to the ids of a list; catalog maps stand for units."""
    asked = table(spark, d, "map_metadata").select(F.col("map_name").alias("name")).union(table(spark, d, "map_grids").select(F.col("catalog_id").cast("string"))).distinct()
    return units.resolve(asked, table(spark, d, "map_catalog").select(F.col("catalog_id").alias("unit_id"), F.col("canonical_name").alias("unit_name")))


@query("""WITH u AS (SELECT catalog_id AS unit_id, tileset_key AS variant, max_players > 2 AS shadow, 'u' || catalog_id || CASE WHEN coalesce(tileset_key, '') <> '' THEN '_' || tileset_key ELSE '' END AS sprite FROM map_catalog),
k AS (SELECT *, sprite || CASE WHEN shadow THEN '.shadow' ELSE '' END AS anchor_key FROM u), a AS (SELECT 'u' || catalog_id || '_' || tileset_key || CASE WHEN catalog_id % 2 = 0 THEN '.shadow' ELSE '' END AS anchor_key, width_tiles AS anchor_x, height_tiles AS anchor_y FROM map_grids)
SELECT k.unit_id, k.sprite, k.anchor_key, a.anchor_x, a.anchor_y FROM k LEFT JOIN a USING (anchor_key)""")
def unit_anchors(spark, d):
    """Sprite keys and anchors; catalog maps stand for units, grids for the table of anchors."""
    u = table(spark, d, "map_catalog").select(F.col("catalog_id").alias("unit_id"), F.col("tileset_key").alias("variant"), (F.col("max_players") > 2).alias("shadow"))
    a = table(spark, d, "map_grids").select(
        F.concat(F.lit("u"), F.col("catalog_id"), F.lit("_"), F.col("tileset_key"), F.when(F.col("catalog_id") % 2 == 0, ".shadow").otherwise("")).alias("anchor_key"), F.col("width_tiles").alias("anchor_x"), F.col("height_tiles").alias("anchor_y")
    )
    return units.anchors(u, a).select("unit_id", "sprite", "anchor_key", "anchor_x", "anchor_y")


@query("SELECT c_custkey AS unit, r_regionkey AS image FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def unit_images(spark, d):
    """The chain of three tables from unit to image; customers, nations and regions stand for the game's."""
    u = table(spark, d, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_nationkey").alias("flingy"))
    f = table(spark, d, "nation").select(F.col("n_nationkey").alias("flingy"), F.col("n_regionkey").alias("sprite"))
    return units.unit_images(u, f, table(spark, d, "region").select(F.col("r_regionkey").alias("sprite"), F.col("r_regionkey").alias("image")))


@query("""WITH i AS (SELECT p_partkey AS image, lower(p_brand) AS grp, p_size % 7 = 0 AS has FROM part), l AS (SELECT grp, min(image) AS sibling FROM i WHERE has GROUP BY grp)
SELECT image, CASE WHEN has THEN image ELSE sibling END AS source FROM i LEFT JOIN l USING (grp)""")
def sibling_sprites(spark, d):
    """The image whose animation each image uses: its own, or that of the lowest of its group that has one; parts stand for images."""
    p = table(spark, d, "part")
    images = p.select(F.col("p_partkey").alias("image"), F.col("p_brand").alias("grp_name"))
    return units.with_siblings(images, images, p.where("p_size % 7 = 0").select(F.col("p_partkey").alias("image")))
