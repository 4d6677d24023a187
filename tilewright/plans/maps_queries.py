"""Queries of the per-map kernels, the cache, the comparison, rendering and stream enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import scalar as S
from tilewright.operators import analysis, cache, maps, raster, relational
from tilewright.plans import batch
from tilewright.plans.reference import _BASES, _CHARS, _EDITS, _KEY, _MINI
from tilewright.session import table
from tilewright.streaming import zones

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _maps(spark, d):
    return maps.maps(table(spark, d, "map_grids"), table(spark, d, "map_catalog"), table(spark, d, "map_metadata")), table(spark, d, "tile_attr")


def _kernel(name, f):
    def run(spark, d):
        return f(*_maps(spark, d))

    run.__name__, run.__doc__ = name, f.__doc__
    QUERIES[name] = run


for _name, _f in (
    ("altitude", maps.altitudes), ("watershed", maps.areas), ("regions_chokes", maps.chokes), ("outline", maps.largest_parts), ("grid_bfs", maps.walks),
    ("naturals", maps.natural_links), ("components", maps.parts), ("dijkstra_grow", maps.growth), ("center_overlap", maps.middles), ("analyze", analysis.analyze), ("tile_render", maps.render), ("tile_jpeg", maps.render_jpeg), ("base_overlay", maps.overlay), ("qoi_roundtrip", maps.qoi_round_trip),
):
    _kernel(_name, _f)


@query(f"""WITH {_MINI}, g AS (SELECT catalog_id, canonical_name AS map_name, map_grids.width_tiles AS w0, map_grids.height_tiles AS h0 FROM map_grids JOIN map_catalog USING (catalog_id) WHERE len(tiles) >= map_grids.width_tiles * map_grids.height_tiles),
u AS (SELECT g.catalog_id, arg_min(start_locations, replay_id) AS s FROM g JOIN map_metadata m ON m.map_name = g.map_name AND m.width_tiles = g.w0 AND m.height_tiles = g.h0 WHERE mineral_fields IS NOT NULL AND start_locations IS NOT NULL GROUP BY 1),
f AS (SELECT catalog_id, list_filter(s, lambda p: p.x IS NOT NULL AND p.y IS NOT NULL) AS s FROM u), p AS (SELECT catalog_id, unnest(s) AS p, generate_subscripts(s, 1) - 1 AS start_no FROM f WHERE len(s) > 0),
q AS (SELECT p.catalog_id, start_no, least(greatest(p.x // 8, 0), w - 1) AS px, least(greatest(p.y // 8, 0), h - 1) AS py FROM p JOIN (SELECT DISTINCT catalog_id, w, h FROM c) z USING (catalog_id)),
n AS (SELECT q.catalog_id, start_no, arg_min((c.x, c.y), (greatest(abs(c.x - px), abs(c.y - py)), c.y, c.x)) AS b FROM q JOIN c ON c.catalog_id = q.catalog_id AND c.x BETWEEN px - 12 AND px + 12 AND c.y BETWEEN py - 12 AND py + 12 WHERE feat & 3 <> 0 GROUP BY 1, 2)
SELECT q.catalog_id AS map_id, q.start_no::INT AS start_no, b[1]::INT AS x, b[2]::INT AS y FROM q LEFT JOIN n USING (catalog_id, start_no)""")
def nearest_passable(spark, d):
    return maps.start_seeds(*_maps(spark, d))


@query("""WITH n AS (SELECT i::INT AS n FROM range(256) t(i)), c AS (SELECT n, (CASE WHEN n & 2 = 2 THEN 16 ELSE 0 END) | (CASE WHEN n & 8 = 8 THEN 36 ELSE 0 END) | (CASE WHEN n & 16 = 16 THEN 9 ELSE 0 END) | (CASE WHEN n & 64 = 64 THEN 2 ELSE 0 END)
 | (CASE WHEN n & 192 = 192 THEN 1 ELSE 0 END) | (CASE WHEN n & 96 = 96 THEN 4 ELSE 0 END) | (CASE WHEN n & 3 = 3 THEN 32 ELSE 0 END) | (CASE WHEN n & 6 = 6 THEN 8 ELSE 0 END) AS v FROM n),
j AS (SELECT n, v | CASE WHEN v & 33 = 33 OR v & 12 = 12 THEN 64 ELSE 0 END AS v FROM c) SELECT n AS neighbours, (dense_rank() OVER (ORDER BY v) - 1)::INT AS frame FROM j""")
def creep_edges(spark, d):
    """Frames of the 256 neighbourhoods, ranked in SQL; the tests compare with the kernel's table."""
    from pyspark.sql import Window

    n = spark.range(256).select(F.col("id").cast("int").alias("neighbours"))
    code = F.lit(0)
    for need, bits in raster.CREEP_RULES:
        code = code.bitwiseOR(F.when(F.col("neighbours").bitwiseAND(need) == need, bits).otherwise(0))
    n = n.withColumn("v", code)
    joined = F.lit(False)
    for j in raster.CREEP_JOINED:
        joined = joined | (F.col("v").bitwiseAND(j) == j)
    n = n.withColumn("v", F.col("v").bitwiseOR(F.when(joined, 0x40).otherwise(0)))
    ranks = n.select("v").distinct().withColumn("frame", (F.dense_rank().over(Window.orderBy("v")) - 1).cast("int"))  # 256 rows at most
    return n.join(F.broadcast(ranks), "v").select("neighbours", "frame")


@query()
def batch_job(spark, d):
    """What the batch job makes of the grids' uploads: one row per map key; the job itself also writes documents, images and digest."""
    m, a = _maps(spark, d)
    uploads = m.select(F.col("map_id").alias("replay_id"), F.col("map_id").cast("string").alias("replay_path"), F.lit(None).cast("string").alias("map_data_name"), *m.columns[1:])
    return batch.summary(batch.results(batch.picked(uploads), a))


# ---- cache and comparison -------------------------------------------------------------------------------------------


@query(f"""WITH e AS (SELECT {_KEY.format('map_name')} AS map_key, result_id, analyzed_at FROM map_results), k AS (SELECT map_key, arg_max(result_id, (analyzed_at, result_id)) AS result_id FROM e WHERE map_key <> '' GROUP BY map_key),
q AS (SELECT DISTINCT {_KEY.format('map_name')} AS req_key FROM map_metadata) SELECT req_key, result_id FROM q JOIN k ON k.map_key = q.req_key WHERE req_key <> ''""")
def cache_exact(spark, d):
    q = table(spark, d, "map_metadata").select(S.map_key(F.col("map_name")).alias("req_key")).distinct()
    return q.join(cache.entries(table(spark, d, "map_results")), F.col("req_key") == F.col("map_key")).select("req_key", "result_id")


_STORE = f"""e AS (SELECT {_KEY.format('map_name')} AS map_key, result_id, analyzed_at FROM map_results),
k AS (SELECT map_key, {_CHARS.format('map_key')} AS ck, arg_max(result_id, (analyzed_at, result_id)) AS result_id, arg_min(result_id, (analyzed_at, result_id)) AS first_id, min(analyzed_at) AS first_at FROM e WHERE map_key <> '' GROUP BY map_key)"""
_NEAR = f"""l AS (SELECT *, greatest(len(cr), len(ck)) AS longest FROM {{0}} q JOIN k ON least(len(cr), len(ck)) >= 0.82 * greatest(len(cr), len(ck)) - 1e-9 AND req_key <> map_key),
s AS (SELECT *, 1.0::DOUBLE - ({_EDITS.format(a='cr', b='ck')}) / longest::DOUBLE AS score FROM l)"""


@query(f"""WITH {_STORE}, q AS (SELECT DISTINCT {_KEY.format('map_name')} AS req_key FROM map_metadata), r AS (SELECT req_key, {_CHARS.format('req_key')} AS cr FROM q WHERE req_key <> ''),
x AS (SELECT req_key, result_id FROM r JOIN k ON map_key = req_key), o AS (SELECT * FROM r WHERE req_key NOT IN (SELECT req_key FROM x)), {_NEAR.replace('{0}', 'o')},
n AS (SELECT req_key, first_id, score, row_number() OVER (PARTITION BY req_key ORDER BY score DESC, first_at, first_id, map_key) AS rn FROM s WHERE score >= 0.82)
SELECT r.req_key, coalesce(x.result_id, n.first_id) AS result_id, CASE WHEN x.result_id IS NOT NULL THEN 'exact' WHEN n.first_id IS NOT NULL THEN 'fuzzy' ELSE 'miss' END AS how, round(CASE WHEN x.result_id IS NOT NULL THEN 1.0 ELSE n.score END, 6) AS score
FROM r LEFT JOIN x USING (req_key) LEFT JOIN n ON n.req_key = r.req_key AND rn = 1""")
def cache_lookup(spark, d):
    """Every map key asked for: exact hit, fuzzy hit or miss."""
    q = table(spark, d, "map_metadata").select(S.map_key(F.col("map_name")).alias("req_key"))
    return cache.lookup(q, cache.entries(table(spark, d, "map_results")))


@query(f"""WITH {_STORE}, r AS (SELECT map_key AS req_key, ck AS cr FROM k), {_NEAR.replace('{0}', 'r')} SELECT req_key, map_key, score FROM s WHERE score >= 0.82""")
def fuzzy_lookup(spark, d):
    """Pairs of cached keys alike enough to answer for each other."""
    k = cache.entries(table(spark, d, "map_results"))
    return cache.fuzzy_pairs(k.select(F.col("map_key").alias("req_key")), k.select("map_key"))


@query()
def golden_compare(spark, d):
    """The later half of the results against the earlier half, by map key and base name."""
    r = table(spark, d, "map_results")
    mid = r.agg(F.percentile_approx(F.unix_micros(F.col("analyzed_at").cast("timestamp")), 0.5)).first()[0] or 0
    early = F.unix_micros(F.col("analyzed_at").cast("timestamp")) <= mid
    return cache.golden_check(r.where(early), r.where(~early))


@query(f"""WITH {_BASES}, p AS (SELECT result_id, base_no, list_filter(v, lambda q: q IS NOT NULL) AS v FROM b), g AS (SELECT result_id, base_no, v, list_min(list_transform(v, lambda q: q.x)) AS x0, list_max(list_transform(v, lambda q: q.x)) AS x1, list_min(list_transform(v, lambda q: q.y)) AS y0, list_max(list_transform(v, lambda q: q.y)) AS y1 FROM p WHERE len(v) >= 3),
e AS (SELECT result_id, base_no, x0, x1, y0, y1, unnest(v) AS a, v[generate_subscripts(v, 1) % len(v) + 1] AS q FROM g), w AS (SELECT *, unnest(range(y0, y1 + 1)) + 0.5::DOUBLE AS py FROM e),
c AS (SELECT *, (q.x - a.x) * (py - a.y) / (q.y - a.y)::DOUBLE + a.x AS cx FROM w WHERE (a.y > py) <> (q.y > py)),
n AS (SELECT result_id, base_no, greatest(0, least(ceil(cx - 0.5) - x0, x1 - x0 + 1)) AS left_of, row_number() OVER (PARTITION BY result_id, base_no, py ORDER BY cx DESC) AS k FROM c),
f AS (SELECT result_id, base_no, sum(CASE WHEN k % 2 = 1 THEN left_of ELSE -left_of END) AS cells FROM n GROUP BY ALL)
SELECT g.result_id, g.base_no, round(CASE WHEN (x1 - x0) * (y1 - y0) = 0 THEN 0.0 ELSE coalesce(cells, 0) / ((x1 - x0) * (y1 - y0))::DOUBLE END, 6) AS iou FROM g LEFT JOIN f USING (result_id, base_no)""")
def mask_iou(spark, d):
    """Overlap of each base's polygon with the box of its own vertices: how much of its box a base fills."""
    from tilewright.operators import shapes

    v = F.filter("polygon_vertices", lambda p: p.isNotNull())
    lim = lambda f, k: f(F.transform(v, lambda p: p[k]))
    corner = lambda fx, fy: F.struct(lim(fx, "x").alias("x"), lim(fy, "y").alias("y"))
    lo, hi = F.array_min, F.array_max
    box = F.array(corner(lo, lo), corner(hi, lo), corner(hi, hi), corner(lo, hi))
    b = relational.bases_of(table(spark, d, "map_results")).where(F.size(v) >= 3)
    return b.select("result_id", "base_no", F.round(shapes.iou(F.col("polygon_vertices"), box), 6).alias("iou"))


@query(r"""WITH r AS (SELECT result_id, any_value(map_name) AS map_name, list_filter(coalesce(any_value(starting_locations), []), lambda b: b IS NOT NULL) AS s, list_filter(coalesce(any_value(expansions), []), lambda b: b IS NOT NULL) AS e FROM map_results GROUP BY result_id),
n AS (SELECT *, trim(regexp_replace(coalesce(map_name, ''), '\p{Cc}', '', 'g')) AS title, list_concat(list_transform(s, lambda b: coalesce(b.name, '')), list_transform(e, lambda b: coalesce(b.name, ''))) AS names FROM r),
u AS (SELECT *, coalesce(list_sort(list_distinct(list_filter(names, lambda x: len(list_filter(names, lambda y: y = x)) > 1))), []) AS dupes FROM n)
SELECT result_id, '## ' || CASE WHEN title = '' THEN result_id::VARCHAR ELSE title END || e'\n\n- **JSON key:** `' || result_id || e'`\n- **Duplicate base names:** ' || CASE WHEN len(dupes) = 0 THEN 'none' ELSE array_to_string(list_transform(dupes, lambda x: '`' || x || '`'), ', ') END
 || e'\n\n### Starts\n\n| Name | Natural expansion |\n|------|--------------------|\n' || coalesce(array_to_string(list_transform(s, lambda b: '| ' || replace(coalesce(b.name, ''), '|', '\|') || ' | ' || CASE WHEN coalesce(b.natural_expansion, '') = '' THEN '—' ELSE replace(b.natural_expansion, '|', '\|') END || e' |\n'), ''), '')
 || e'\n### Expansions and naturals\n\n| Name | Kind | Linked from starts (natural of) |\n|------|------|-----------------------------------|\n' || coalesce(array_to_string(list_transform(e, lambda b: '| ' || replace(coalesce(b.name, ''), '|', '\|') || ' | ' || replace(coalesce(b.kind, ''), '|', '\|') || ' | ' ||
  CASE WHEN len(list_filter(s, lambda t: coalesce(t.natural_expansion, '') <> '' AND t.natural_expansion = b.name)) = 0 THEN '—' ELSE coalesce(nullif(array_to_string(list_sort(list_transform(list_filter(s, lambda t: coalesce(t.natural_expansion, '') <> '' AND t.natural_expansion = b.name), lambda t: coalesce(t.name, ''))), ', '), ''), '—') END || e' |\n'), ''), '') || e'\n' AS section,
 len(dupes)::INT AS duplicates FROM u""")
def digest(spark, d):
    return relational.digest(table(spark, d, "map_results"))


# ---- enrichment -----------------------------------------------------------------------------------------------------


@query(f"""WITH {_BASES}, m AS (SELECT replay_id, any_value(start_locations) AS starts FROM map_metadata GROUP BY replay_id),
p AS (SELECT r.result_id, unnest(starts) AS p, generate_subscripts(starts, 1) - 1 AS point_no FROM r JOIN m USING (replay_id) WHERE len(starts) > 0),
t AS (SELECT result_id, point_no, p.x / 8.0 AS x, p.y / 8.0 AS y FROM p WHERE p.x IS NOT NULL AND p.y IS NOT NULL),
v AS (SELECT result_id, base_no, name, list_filter(v, lambda q: q IS NOT NULL) AS v FROM b WHERE v IS NOT NULL), e AS (SELECT result_id, base_no, name, unnest(v) AS a, v[generate_subscripts(v, 1) % len(v) + 1] AS q FROM v WHERE len(v) > 0),
h AS (SELECT t.result_id, point_no, base_no, any_value(name) AS base_name, count(*) FILTER ((a.y > t.y) <> (q.y > t.y) AND t.x < (q.x - a.x) * (t.y - a.y) / nullif((q.y - a.y)::DOUBLE, 0) + a.x) AS n FROM t JOIN e ON e.result_id = t.result_id GROUP BY 1, 2, 3)
SELECT result_id, point_no::INT AS point_no, base_no, base_name FROM h WHERE n % 2 = 1""")
def points_in_zones(spark, d):
    """Start locations of analysed uploads in the base regions of their results."""
    r = table(spark, d, "map_results")
    keys = r.select("result_id", "replay_id").dropDuplicates(["result_id"]).where("replay_id is not null")
    p = relational.uploads_once(table(spark, d, "map_metadata")).select("replay_id", F.posexplode("start_locations").alias("point_no", "s")).where("s.x is not null and s.y is not null")
    pts = keys.join(p, "replay_id").select("result_id", "point_no", (F.col("s.x") / 8.0).alias("x"), (F.col("s.y") / 8.0).alias("y"))
    return zones.place(pts, zones.zones(r)).select("result_id", "point_no", "base_no", F.col("name").alias("base_name"))
