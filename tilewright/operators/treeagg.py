"""Per-key results where a few keys hold most records (problem 4).

Multi-level tree aggregation. Uploads and (name, data name) pairs are made distinct under their full keys, which no hot
name can crowd; both are hashed into chunks of about ``CHUNK`` rows and combined chunk by chunk. The states that remain
(uploads, first, last, distinct data names; all additive, since equal values share a chunk) are merged through
rounds of fan-in ``FAN_IN``: chunk numbers are divided by it until one is left. A reducer of a round never
sees more than FAN_IN states of a key, however many rows the key has.

Defined results: null is a key of its own; null replay ids are no uploads and null data names no values, but the times
of their rows count; null times are ignored, a key without any has null; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 65_536
FAN_IN = 8


def tree_aggregate(states: DataFrame, keys: list[str], merge: list, chunks: int, fan_in: int = FAN_IN) -> DataFrame:
    """Merge ``states`` (keys, chunk, state columns) by ``merge`` until one chunk is left.

    ``merge``: aggregates whose names are those of their inputs, so that rounds can follow one another.
    """
    while chunks > 1:
        chunks = -(-chunks // fan_in)
        states = states.withColumn("chunk", F.expr(f"chunk div {fan_in}")).groupBy(*keys, "chunk").agg(*merge)
    return states.drop("chunk")


def name_usage(uploads: DataFrame, rows: int | None = None, chunk: int = CHUNK, fan_in: int = FAN_IN) -> DataFrame:
    """Per exact map_name: uploads, first_recorded, last_recorded, data_names.

    ``rows``: the table's number of rows if it is known; a Parquet table tells it from its footers.
    """
    rows = uploads.count() if rows is None else rows
    chunks = max(1, -(-rows // chunk))
    of = lambda *c: F.pmod(F.xxhash64(*c), F.lit(chunks)).alias("chunk")
    zero = F.lit(0).cast("long")
    by_upload = uploads.groupBy("map_name", "replay_id").agg(F.min("recorded_at").alias("lo"), F.max("recorded_at").alias("hi"))
    by_pair = uploads.where("map_data_name is not null").groupBy("map_name", "map_data_name").agg(F.lit(1).alias("one"))
    kind = dict(uploads.dtypes)["recorded_at"]
    none = F.lit(None).cast(kind)
    states = by_upload.select("map_name", of("replay_id"), F.col("replay_id").isNotNull().cast("long").alias("uploads"), F.col("lo").alias("first_recorded"), F.col("hi").alias("last_recorded"), zero.alias("data_names")).unionByName(
        by_pair.select("map_name", of("map_data_name"), zero.alias("uploads"), none.alias("first_recorded"), none.alias("last_recorded"), F.lit(1).cast("long").alias("data_names"))
    )
    merge = [F.sum("uploads").alias("uploads"), F.min("first_recorded").alias("first_recorded"), F.max("last_recorded").alias("last_recorded"), F.sum("data_names").alias("data_names")]
    local = states.groupBy("map_name", "chunk").agg(*merge)
    return tree_aggregate(local, ["map_name"], merge, chunks, fan_in)
