"""Name-keyed result cache: exact hits, fuzzy hits, and what must be computed.

Fuzzy lookup never compares every request with every name. Two keys that are alike enough differ by at most k edits,
k following from the longer length; cut into k + 1 pieces, the cached key must lend one piece unchanged to the request,
moved by at most k places. Requests and cached keys meet by equality on (length of the cached key, piece number, piece), and only
those pairs are measured. Exact: no pair above the threshold is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright import constants as K
from tilewright.functions import scalar as S
from tilewright.operators.nested import once
from tilewright.session import cut


def entries(results: DataFrame) -> DataFrame:
    """(map_key, result_id, first_id, first_at) of the cached results; empty keys are left out.

    Of several results of a key the last stored one answers exact requests (``result_id``), the first one fuzzy requests
    (``first_id``), since that list keeps all and the first of equal scores wins.
    """
    k = results.select(S.map_key(F.col("map_name")).alias("map_key"), "result_id", "analyzed_at").where("map_key <> ''")
    at = F.struct("analyzed_at", "result_id")
    return k.groupBy("map_key").agg(F.max(at).alias("m"), F.min(at).alias("f")).select("map_key", F.col("m.result_id").alias("result_id"), F.col("f.result_id").alias("first_id"), F.col("f.analyzed_at").alias("first_at"))


def _ordered(cache: DataFrame) -> DataFrame:
    """A store without first entries has one per key."""
    if "first_id" in cache.columns:
        return cache.select("map_key", "result_id", "first_id", "first_at")
    return cache.select("map_key", "result_id", F.col("result_id").alias("first_id"), F.lit(None).cast("timestamp_ntz").alias("first_at"))


def _most_edits(longest, least: float):
    """Edits allowed between keys of which the longer has this length."""
    return F.floor((1.0 - least) * longest + 1e-9).cast("int")


def _pieces(length, k):
    """(number, start from 1, size) of the k + 1 pieces of a key, sizes as even as can be."""
    n = k + 1
    small = F.floor(length / n).cast("int")
    long_ = (length - small * n).cast("int")  # so many pieces, the last ones, are longer by one
    return F.transform(
        F.sequence(F.lit(0), k),
        lambda i: F.named_struct(
            F.lit("no"), i,
            F.lit("at"), (i * small + F.greatest(F.lit(0), i - (n - long_)) + 1).cast("int"),
            F.lit("size"), (small + F.when(i >= n - long_, 1).otherwise(0)).cast("int"),
        ),
    )


def fuzzy_pairs(requests: DataFrame, cached: DataFrame, least: float = K.FUZZY) -> DataFrame:
    """(req_key, map_key, score) of all pairs of different keys at least so much alike.

    ``requests(req_key)`` and ``cached(map_key)`` hold distinct, non-empty keys.
    """
    # The allowance depends on the longer key. A cached key of length n meets requests of up to n / least letters, so pieces
    # are cut for the largest allowance its partners may have.
    most_len = lambda n: F.floor(n / least + 1e-9).cast("int")
    c = cached.select("map_key", F.length("map_key").alias("n")).withColumn("k", F.least(_most_edits(most_len(F.col("n")), least), F.col("n") - 1))
    c = c.select("map_key", "n", F.explode(_pieces(F.col("n"), F.col("k"))).alias("p")).select("map_key", "n", F.col("p.no").alias("no"), F.expr("substring(map_key, p.at, p.size)").alias("piece"))
    r = requests.select("req_key", F.length("req_key").alias("m"))
    lengths = F.sequence(F.greatest(F.lit(1), F.ceil(F.col("m") * least - 1e-9).cast("int")), most_len(F.col("m")))
    r = r.select("req_key", "m", F.explode(lengths).alias("n")).withColumn("k", F.least(_most_edits(most_len(F.col("n")), least), F.col("n") - 1))
    r = r.select("req_key", "m", "n", "k", F.explode(_pieces(F.col("n"), F.col("k"))).alias("p"))
    starts = F.sequence(F.greatest(F.lit(1), F.col("p.at") - F.col("k")), F.greatest(F.greatest(F.lit(1), F.col("p.at") - F.col("k")), F.least(F.col("m") - F.col("p.size") + 1, F.col("p.at") + F.col("k"))))
    r = r.select("req_key", "n", F.col("p.no").alias("no"), F.col("p.size").alias("size"), F.explode(starts).alias("at"))
    r = r.select("req_key", "n", "no", "size", F.expr("substring(req_key, at, size)").alias("piece")).where("length(piece) = size").drop("size").distinct()
    pairs = r.join(c, ["n", "no", "piece"]).select("req_key", "map_key").where("req_key <> map_key").distinct()
    return pairs.withColumn("score", S.similarity(F.col("req_key"), F.col("map_key"))).where(F.col("score") >= least)


def lookup(requests: DataFrame, cache: DataFrame, dynamic: DataFrame | None = None, least: float = K.FUZZY) -> DataFrame:
    """(req_key, result_id, how, score): dynamic entries before embedded ones, exact before fuzzy, the best score first.

    ``cache`` and ``dynamic``: (map_key, result_id), and the first entries as ``entries`` gives them. Equal scores go to the
    embedded entry, then to the one stored first.
    """
    every = _ordered(cache).withColumn("source", F.lit(1))
    if dynamic is not None:
        every = every.unionByName(_ordered(dynamic).withColumn("source", F.lit(0)))
    keys = requests.select("req_key").where("req_key <> ''").distinct()
    exact = keys.join(every, keys.req_key == every.map_key).groupBy("req_key").agg(F.min(F.struct("source", "result_id")).alias("m")).select("req_key", F.col("m.result_id").alias("result_id"), F.lit("exact").alias("how"), F.lit(1.0).alias("score"))
    open_ = keys.join(exact, "req_key", "left_anti")
    near = fuzzy_pairs(open_, every.select("map_key").distinct(), least).join(every, "map_key")
    w = Window.partitionBy("req_key").orderBy(F.desc("score"), F.desc("source"), "first_at", "first_id", "map_key")
    fuzzy = near.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("req_key", F.col("first_id").alias("result_id"), F.lit("fuzzy").alias("how"), "score")
    hits = exact.unionByName(fuzzy)
    return keys.join(hits, "req_key", "left").select("req_key", "result_id", F.coalesce("how", F.lit("miss")).alias("how"), F.round("score", 6).alias("score"))


def analyse(requests: DataFrame, cache: DataFrame, dynamic: DataFrame | None, compute) -> tuple[DataFrame, DataFrame]:
    """(answers, store): requests answered from the stores, what is missing computed, and the dynamic store with it.

    ``requests(req_key, replay_id)``: the name asked for and the upload to analyse if no store knows it. ``compute`` takes the
    missing (req_key, replay_id), one row a key (the smallest replay_id), and returns (map_key, result_id) of what could be
    analysed; the key stored is the result's own. Answers: req_key, result_id, how (exact, fuzzy, computed or miss).
    """
    known = lookup(requests, cache, dynamic)
    misses = requests.where("req_key <> ''").groupBy("req_key").agg(F.min("replay_id").alias("replay_id")).join(known.where("how = 'miss'").select("req_key"), "req_key", "left_semi")
    new = cut(compute(misses).select("map_key", "result_id"))
    fresh = new.groupBy("map_key").agg(F.max("result_id").alias("result_id"))
    store = fresh if dynamic is None else dynamic.select("map_key", "result_id").join(fresh, "map_key", "left_anti").unionByName(fresh)
    got = known.join(fresh.select(F.col("map_key").alias("req_key"), F.col("result_id").alias("new_id")), "req_key", "left")
    how = F.when((F.col("how") == "miss") & F.col("new_id").isNotNull(), "computed").otherwise(F.col("how"))
    return got.select("req_key", F.coalesce("result_id", "new_id").alias("result_id"), how.alias("how")), store


def golden_check(golden: DataFrame, current: DataFrame) -> DataFrame:
    """Bases of two sets of results compared by map key and name; see ``relational.compare``."""
    from tilewright.operators import relational as R

    def flat(results):
        latest = entries(results)
        b = R.bases_of(results)
        return latest.join(b, "result_id").select("map_key", "name", "kind", "clock", "mineral_only", "natural_expansion", F.col("center_tile.x").cast("double").alias("x"), F.col("center_tile.y").cast("double").alias("y"), F.col("polygon_vertices").alias("polygon"))

    one = lambda d: d.groupBy("map_key", "name").agg(F.min(F.struct("clock", "x", "y", "kind", "mineral_only", "natural_expansion", "polygon")).alias("b")).select("map_key", "name", "b.*")
    return R.compare(one(flat(golden)), one(flat(current)))


__all__ = ["analyse", "entries", "fuzzy_pairs", "golden_check", "lookup", "once"]
