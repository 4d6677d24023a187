"""Nested flattening, tree aggregation, cache, comparison, sinks, streams: small tables with every kind of dirt."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tilewright.functions import scalar as S
from tilewright.operators import cache, nested, relational, treeagg
from tilewright.session import table
from tilewright.sinks import files as sinks
from tilewright.sources import binary
from tilewright.streaming import zones

P = "struct<x:int,y:int>"
BASE = f"struct<name:string,kind:string,clock:int,center_tile:{P},polygon_vertices:array<{P}>,mineral_only:boolean,natural_expansion:string,chokes:array<struct<center:{P},ends:array<{P}>,width:int,connects_to:string>>>"
RESULT = f"result_id long, replay_id long, map_name string, tileset_key string, starting_locations array<{BASE}>, expansions array<{BASE}>, analyzed_at timestamp_ntz, base_pos string, x int"


def base(name="start 3", kind="start", clock=3, center=(1, 2), vertices=(), natural=None, chokes=None):
    return (name, kind, clock, center, None if vertices is None else list(vertices), False, natural, chokes)


def result(i, starts, rest, name="A", replay=None, at=1):
    return (i, replay, name, "00-badlands", starts, rest, dt.datetime(2024, 1, at), "clash", 7)


def brute_nodes(rows):
    out, seen = set(), set()
    for r in rows:
        if r[0] in seen:
            continue
        seen.add(r[0])
        for name, bases in (("starting_locations", r[4]), ("expansions", r[5])):
            for i, b in enumerate(bases or []):
                if b is None:
                    continue
                out.add((r[0], "base", name, i, -1, -1))
                out |= {(r[0], "vertex", name, i, k, -1) for k, v in enumerate(b[4] or []) if v is not None}
                for k, c in enumerate(b[7] or []):
                    if c is not None:
                        out.add((r[0], "choke", name, i, k, -1))
                        out |= {(r[0], "end", name, i, k, m) for m, e in enumerate(c[1] or []) if e is not None}
    return out


def test_flatten(spark):
    choke = ((5, 5), [(1, 1), None, (2, 2)], 4, None)
    rows = [
        result(1, [base(vertices=[(0, 0), None, (1, 1)], chokes=[None, choke, ((1, 1), None, 2, ""), ((1, 1), [], 2, "x")]), None], None),
        result(1, [base(vertices=[(0, 0), None, (1, 1)], chokes=[None, choke, ((1, 1), None, 2, ""), ((1, 1), [], 2, "x")]), None], None),
        result(2, [], [None, base(vertices=None)]), result(3, None, None), result(4, [base(vertices=[], chokes=[])], [base(vertices=[(9, 9)])]),
    ]
    df = spark.createDataFrame(rows, RESULT)
    got = [tuple(r) for r in nested.found(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_nodes(rows)
    ends = nested.tables(df)["ends"].collect()
    assert {(r["end_pos"], r["x"]) for r in ends if r["item_pos"] == 1} == {(0, 1), (2, 2)}
    # the other way, when more ids repeat than may be broadcast
    assert {tuple(r) for r in nested.once_by_ids(df, most=0).mapInArrow(lambda it: (x for b in it for x in nested.nodes(b, ("base",), False)), "result_id long, node_kind string, base_list string, base_pos int, item_pos int, end_pos int").collect()} == {n for n in brute_nodes(rows) if n[1] == "base"}
    assert nested.found(df.limit(0)).count() == 0
    null_ids = spark.createDataFrame([result(None, [base()], None), result(None, [base()], None), result(None, [base(), base()], None)], RESULT)
    assert nested.found(null_ids).count() == 3  # two different contents: one base and two


UPLOADS = "replay_id long, map_name string, map_data_name string, recorded_at timestamp_ntz, uploads string, chunk int"


def test_tree_aggregation(spark):
    rng = random.Random(3)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = [(rng.randrange(400), rng.choice(["hot"] * 6 + ["b", "c", None, ""]), rng.choice(["x", "y", None, "z" + str(rng.randrange(50))]), rng.choice([None, day(rng.randrange(90))]), "clash", 1) for _ in range(3000)]
    rows += [(None, "only null ids", None, None, "clash", 1)]
    df = spark.createDataFrame(rows, UPLOADS)
    want = {}
    for name in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == name]
        times = [r[3] for r in mine if r[3]]
        want[name] = (len({r[0] for r in mine if r[0] is not None}), min(times, default=None), max(times, default=None), len({r[2] for r in mine if r[2] is not None}))
    for chunk, fan in ((100, 3), (7, 2), (10**9, 8)):
        got = {r["map_name"]: (r["uploads"], r["first_recorded"], r["last_recorded"], r["data_names"]) for r in treeagg.name_usage(df, chunk=chunk, fan_in=fan).collect()}
        assert got == want
    assert treeagg.name_usage(df.limit(0)).count() == 0


def test_no_reducer_sees_all_rows_of_a_hot_key(spark):
    df = spark.range(5000).select(F.col("id").alias("replay_id"), F.lit("hot").alias("map_name"), F.lit("d").alias("map_data_name"), F.lit("2024-01-01").cast("timestamp_ntz").alias("recorded_at"))
    states = df.select("map_name", F.pmod(F.xxhash64("replay_id"), F.lit(50)).alias("chunk"), F.lit(1).cast("long").alias("uploads")).groupBy("map_name", "chunk").agg(F.sum("uploads").alias("uploads"))
    once = states.withColumn("chunk", F.expr("chunk div 8")).groupBy("chunk").count().agg(F.max("count")).first()[0]
    assert once <= 8
    assert treeagg.tree_aggregate(states, ["map_name"], [F.sum("uploads").alias("uploads")], 50).first()["uploads"] == 5000


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_lookup_loses_no_pair(spark):
    rng = random.Random(9)
    words = ["dominator", "polypoid", "sylphid", "retro", "eclipse", "투혼의바람", "a", "ab", "knockout-se"]
    keys = set(words)
    for w in words:
        for _ in range(25):
            s = list(w)
            for _ in range(rng.randrange(1, 4)):
                k = rng.randrange(len(s) + 1)
                op = rng.random()
                if op < 0.4:
                    s.insert(k, rng.choice("abcde투"))
                elif s and k < len(s):
                    s[k : k + 1] = [] if op < 0.7 and len(s) > 1 else [rng.choice("abcde투")]
            keys.add("".join(s))
    for least in (0.82, 0.6):
        got = {(r[0], r[1]) for r in cache.fuzzy_pairs(spark.createDataFrame([(k,) for k in keys], "req_key string"), spark.createDataFrame([(k,) for k in keys], "map_key string"), least).collect()}
        want = {(a, b) for a in keys for b in keys if a != b and 1.0 - edits(a, b) / max(len(a), len(b)) >= least}
        assert got == want


def test_cache_lookup(spark):
    req = spark.createDataFrame([("dominator-se",), ("dominator-sex",), ("nothing",), ("",), (None,), ("both",)], "req_key string")
    embedded = spark.createDataFrame([("dominator-se", 1), ("both", 2)], "map_key string, result_id long")
    dynamic = spark.createDataFrame([("both", 3)], "map_key string, result_id long")
    got = {r["req_key"]: (r["result_id"], r["how"]) for r in cache.lookup(req, embedded, dynamic).collect()}
    assert got == {"dominator-se": (1, "exact"), "dominator-sex": (1, "fuzzy"), "nothing": (None, "miss"), "both": (3, "exact")}
    asked = req.withColumn("replay_id", F.lit(5).cast("long"))
    answers, store = cache.analyse(asked, embedded, dynamic, lambda m: m.select(F.col("req_key").alias("map_key"), (F.col("replay_id") + 94).alias("result_id")))
    assert {tuple(r) for r in answers.collect()} == {("dominator-se", 1, "exact"), ("dominator-sex", 1, "fuzzy"), ("both", 3, "exact"), ("nothing", 99, "computed")}
    assert {tuple(r) for r in store.collect()} == {("both", 3), ("nothing", 99)}
    again, _ = cache.analyse(asked, embedded, store, lambda m: m.select(F.col("req_key").alias("map_key"), F.lit(-1).cast("long").alias("result_id")))
    assert {(r["req_key"], r["result_id"], r["how"]) for r in again.collect()} >= {("nothing", 99, "exact")}
    none, _ = cache.analyse(asked, embedded, None, lambda m: m.limit(0).select(F.col("req_key").alias("map_key"), F.lit(-1).cast("long").alias("result_id")))
    assert {(r["req_key"], r["how"]) for r in none.collect()} >= {("nothing", "miss")}


def test_cache_keeps_the_first_for_fuzzy_and_the_last_for_exact(spark):
    stored = [(4, "Dominator SE", 30), (2, "Dominator SE", 20), (9, "Dominator SF", 10), (7, "", 1), (8, None, 1)]
    r = spark.createDataFrame(stored, "result_id long, map_name string, at long").withColumn("analyzed_at", F.timestamp_seconds("at").cast("timestamp_ntz"))
    req = spark.createDataFrame([("dominator-se",), ("dominator-sx",)], "req_key string")
    got = {x["req_key"]: (x["result_id"], x["how"]) for x in cache.lookup(req, cache.entries(r)).collect()}
    assert got == {"dominator-se": (4, "exact"), "dominator-sx": (9, "fuzzy")}
    without = cache.entries(r.where("result_id <> 9"))
    assert {x["req_key"]: x["result_id"] for x in cache.lookup(req, without).collect()} == {"dominator-se": 4, "dominator-sx": 2}


def test_compare(spark):
    square = lambda k: [(0, 0), (k, 0), (k, k), (0, k)]
    old = [result(1, [base(vertices=square(10)), base("start 9", vertices=square(10))], [base("expa 6", "expa", 6, vertices=square(10)), base("gone", "expa", 1)])]
    new = [result(2, [base(vertices=square(10)), base("start 9", vertices=square(4))], [base("expa 6", "natural", 6, vertices=square(10)), base("new", "expa", 1)])]
    got = {r["name"]: r["verdict"] for r in cache.golden_check(spark.createDataFrame(old, RESULT), spark.createDataFrame(new, RESULT)).collect()}
    assert got == {"start 3": "equal", "start 9": "drifted", "expa 6": "changed", "gone": "missing", "new": "extra"}


def test_relational_dirt(spark):
    rows = [result(1, None, None), result(2, [None], [base(center=None), base(vertices=None, chokes=[None])], replay=5), result(3, [base(natural="n")], [base("n", "natural", 6)], replay=6)]
    meta = spark.createDataFrame(
        [(5, "p.rep", "A", None, 0, 0, None, None, None), (6, "q.REP", None, "B", 64, 64, None, [(1, 1), None], [(8, 8, 1), None]), (6, "q.REP", None, "B", 64, 64, None, [(1, 1), None], [(8, 8, 1), None])],
        f"replay_id long, replay_path string, map_name string, map_data_name string, width_tiles int, height_tiles int, mineral_fields array<{P}>, geysers array<{P}>, start_locations array<struct<x:int,y:int,slot_id:smallint>>",
    )
    r = spark.createDataFrame(rows, RESULT)
    assert relational.nearest_base(meta, r).count() == 1
    gas = {(x["result_id"], x["base_no"]): x["mineral_only"] for x in relational.mineral_only(meta, r).collect()}
    assert gas[(3, 0)] is False and gas[(3, 1)] is True  # both stand on one spot: the first owns the geyser
    for f in (relational.base_radii, relational.polygon_stats, relational.vertex_deviation, lambda x: relational.unique_names(meta, x), relational.natural_names, relational.duplicate_names, relational.distinct_chokes, relational.semantic_counters, relational.digest):
        f(r).collect()
        assert f(r.limit(0)).count() == 0
    assert relational.start_clocks(meta).count() == 1 and relational.center_bases(meta, r).count() == 1
    assert relational.replay_files(meta).count() == 2
    assert {x["map_key"] for x in relational.first_per_key(meta).collect()} == {"a", "b"}
    assert relational.select_maps(meta, "b").count() == 1 and relational.select_maps(meta, "").count() == 2


def test_selection_goes_by_ascii_slugs(spark):
    rows = [(1, "b.rep", "투혼 1.3", "x"), (2, "a.rep", "투혼 1.3", "x"), (3, "c.rep", "투혼", "Fighting Spirit"), (4, "0.rep", "투혼", None), (5, "d.rep", "Fighting Spirit", "other"), (6, "e.rep", None, "FIGHTING  spirit"), (7, "f.rep", "Ånd", "Fighting Spirit"), (6, "e.rep", None, "FIGHTING  spirit")]
    meta = spark.createDataFrame(rows, "replay_id long, replay_path string, map_name string, map_data_name string")
    got = {r["map_key"]: (r["replay_id"], r["uploads"]) for r in relational.first_per_key(meta).collect()}
    assert got == {"1-3": (2, 2), "fighting-spirit": (3, 3), "nd": (7, 1)}  # a name of Korean letters alone falls back; without either there is no key
    pick = lambda s: {r["map_key"]: r["replay_id"] for r in relational.select_maps(meta, s).collect()}
    assert pick("Fighting Spirit!") == {"fighting-spirit": 3, "nd": 7} and pick("1 3") == {"1-3": 2} and pick("zz") == {} and len(pick("투혼")) == 3


def test_sinks(spark, tmp_path):
    r = spark.createDataFrame([result(1, [base(natural="n|x")], [base("n|x", "natural", 6)], name="\x07Map|1"), result(2, [base()], [base()], name=None)], RESULT)
    sinks.write_digest(r, str(tmp_path / "digest"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "digest").glob("part-*")))
    assert text.startswith("# Replay map base digest") and "| start 3 | n\\|x |" in text and "`start 3`" in text
    sinks.write_json(r, str(tmp_path / "json"))
    docs = [json.loads(line) for p in (tmp_path / "json").rglob("part-*") for line in p.read_text().splitlines()]
    assert len(docs) == 2
    back = binary.cached_results(spark, str(write(tmp_path, docs)))
    assert back.count() == 2
    images = spark.createDataFrame([(1, bytearray(b"x")), (2, None)], "map_id long, png binary")
    assert sinks.write_images(images, str(tmp_path / "img")) == 1 and (tmp_path / "img" / "1.png").read_bytes() == b"x"


def write(tmp_path, docs):
    d = tmp_path / "cache"
    d.mkdir()
    for i, doc in enumerate(docs):
        (d / f"{i}.json").write_text(json.dumps(doc, indent=1))
    return d


def test_stream_enrichment(spark, tmp_path):
    square = [(0, 0), (200, 0), (200, 200), (0, 200)]
    r = spark.createDataFrame([result(1, [base(vertices=square), base("empty", vertices=[])], None)], RESULT)
    z = zones.zones(r)
    pts = spark.createDataFrame([(1, 10.5, 10.5, dt.datetime(2024, 1, 1)), (1, 150.0, 190.0, dt.datetime(2024, 1, 1)), (1, 300.0, 1.0, dt.datetime(2024, 1, 1)), (2, 1.0, 1.0, dt.datetime(2024, 1, 1))], "result_id long, x double, y double, ts timestamp")
    for how in (True, False, None):
        assert zones.place(pts, z, how).count() == 2
    pts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pts.schema).parquet(str(tmp_path / "in"))
    counted = zones.ownership(zones.place(stream, z, True))
    q = counted.writeStream.format("memory").queryName("owned").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("owned").agg(F.sum("points")).first()[0] == 2


def test_every_core_query_runs(spark, data):
    from tilewright.plans import core_pipeline, maps_queries, reference

    slow = {"base_overlay", "regions_chokes", "watershed", "tile_render", "analyze"}
    for m in (core_pipeline, reference, maps_queries):
        for name, f in m.QUERIES.items():
            if name not in slow:
                assert len(f(spark, data).columns) > 0, name
    assert S.map_key(F.lit("x")) is not None


def test_analysis_of_given_maps(spark, data):
    from tilewright.plans.maps_queries import QUERIES

    rows = QUERIES["analyze"](spark, data).collect()
    assert rows and all((r["error"] is None) != (r["starting_locations"] is None) for r in rows)
    assert any("tile grid mismatch" == r["error"] for r in rows)


def test_images_are_whole(spark, data, tmp_path):
    """PNGs have 32 pixels a tile, JPEGs are halved only above their default of 2,560 pixels."""
    import numpy as np

    from tilewright.operators import analysis, maps, raster
    from tilewright.plans.maps_queries import QUERIES
    from tilewright.session import table

    for name in ("map_grids", "map_catalog", "map_metadata", "tile_attr"):
        t = table(spark, data, name)
        if name == "map_grids":
            whole = t.where("size(tiles) = width_tiles * height_tiles")
            t = whole.where("width_tiles = 64 and height_tiles = 64").limit(1).unionByName(whole.where("width_tiles = 128 and height_tiles = 96").limit(1))
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    grids = {r["catalog_id"]: r for r in table(spark, str(tmp_path), "map_grids").collect()}
    pngs = {r["map_id"]: r for r in QUERIES["tile_render"](spark, str(tmp_path)).collect()}
    jpegs = {r["map_id"]: r for r in QUERIES["tile_jpeg"](spark, str(tmp_path)).collect()}
    assert len(grids) == 2 and {k: (r["width"], r["height"]) for k, r in pngs.items()} == {k: (g["width_tiles"] * 32, g["height_tiles"] * 32) for k, g in grids.items()}
    assert sorted((r["width"], r["height"]) for r in jpegs.values()) == [(2048, 1536), (2048, 2048)]
    tables = analysis.tile_tables(table(spark, data, "tile_attr"))
    for k, g in grids.items():
        folder = analysis.folder_of(g["tileset_key"])
        want = raster.render(maps.pack_from(tables, folder), g["width_tiles"], g["height_tiles"], np.array(g["tiles"]))
        assert (raster.read_png(pngs[k]["png"]) == want).all()


def test_batch_job(spark, data, tmp_path):
    from tilewright.operators import maps
    from tilewright.plans import batch

    m = maps.maps(table(spark, data, "map_grids"), table(spark, data, "map_catalog"), table(spark, data, "map_metadata")).where("start_locations is not null and size(tiles) = width_tiles * height_tiles")
    small = m.orderBy(F.size("tiles")).limit(2)
    u = small.select(F.col("map_id").alias("replay_id"), F.concat(F.lit("p"), "map_id").alias("replay_path"), F.lit(None).cast("string").alias("map_data_name"), *m.columns[1:])
    late = u.limit(1).withColumn("replay_path", F.lit("z")).withColumn("replay_id", F.lit(-5).cast("long"))
    broken = u.limit(1).withColumn("map_name", F.lit("Broken")).withColumn("replay_id", F.lit(-6).cast("long")).withColumn("tiles", F.array(F.lit(1)))
    every = u.unionByName(late).unionByName(broken).unionByName(broken)
    attributes = table(spark, data, "tile_attr")
    got = {r["map_key"]: r for r in batch.run(every, attributes, str(tmp_path / "out")).collect()}
    names = {r["map_key"] for r in relational.first_per_key(every).collect()}
    assert set(got) == names and got["broken"]["error"] and not any(r["map_id"] == -5 for r in got.values())
    good = {k for k, r in got.items() if r["error"] is None}
    assert good and {p.name for p in (tmp_path / "out" / "json").iterdir() if p.is_dir()} == {f"map_key={k}" for k in good}
    assert {p.name for p in (tmp_path / "out" / "overlay").iterdir()} == {f"{k}.png" for k in good}
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "out" / "digest").glob("part-*")))
    assert text.startswith("# Replay map base digest") and all(f"`{k}`" in text for k in good)
    one = sorted(good)[0]
    assert [r["map_key"] for r in batch.run(every, attributes, str(tmp_path / "one"), one).collect()] == [one]
    for selector in ("no such map", "broken"):
        with pytest.raises(ValueError):
            batch.run(every, attributes, str(tmp_path / "none"), selector)


def test_render_with_packs_and_rectangles(spark):
    import struct

    from tilewright.operators import maps, raster

    pack = b"TSP1" + struct.pack("<III", 33, 2, 2) + bytes(range(256)) * 3 + struct.pack("<33H", 0, 1, *[1] * 31) + struct.pack("<32H", *[0] * 16, *[2] * 16) + bytes(64) + bytes([7] * 64)
    packs = spark.createDataFrame([("jungle", bytearray(pack)), ("desert", bytearray(b"bad"))], "folder string, pack binary")
    row = (1, "A", "04-jungle", 2, 2, [0, 1, 1, 0], None, None, None)
    m = spark.createDataFrame([row, (2, "B", "05-desert", 2, 2, [0, 1, 1, 0], None, None, None)], f"map_id long, map_name string, tileset_key string, width_tiles int, height_tiles int, tiles array<int>, mineral_fields array<{P}>, geysers array<{P}>, start_locations array<{P}>")
    attributes = spark.createDataFrame([("jungle", 0, 0, 9, 0)], "folder string, tile_id int, mini int, feat smallint, elev smallint")
    good = packs.where("folder = 'jungle'")
    got = {r["map_id"]: r for r in maps.render(m, attributes, packs=good, rect=(1, 0, 1, 2)).collect()}
    image = raster.read_png(bytes(got[1]["png"]))
    assert image.shape == (64, 32, 4) and image[8, 8, 0] == 21 and image[40, 8, 0] == 0 and got[2]["error"]
    assert maps.render(m, attributes, packs=good, rect=(2, 0, 1, 1)).where("error is null").count() == 0
    ground = {r["folder"]: r for r in maps.creep(packs).collect()}
    assert raster.read_png(bytes(ground["jungle"]["png"])).shape == (128, 128, 4) and ground["desert"]["error"]


def test_worker_state_is_built_once_a_process(spark):
    from tilewright.session import Shared

    shared = Shared(spark, {"n": 3})
    made = []
    assert shared.state(lambda v: made.append(1) or v["n"]) == 3 == shared.state(lambda v: made.append(1) or 0) and made == [1]

    def run(batches):
        kept = shared.state(lambda v: {"used": 0})
        for b in batches:
            kept["used"] += 1
            yield b

    assert spark.range(0, 40, 1, 8).mapInArrow(run, "id long").count() == 40
