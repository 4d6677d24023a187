"""Sinks: JSON documents, images and the Markdown digest. All but the digest's single file are written by the executors."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import scalar as S
from tilewright.operators import relational


def write_json(results: DataFrame, path: str, pretty: bool = False) -> None:
    """One document per map in a folder of its key; null and empty optional fields are left out."""
    doc = F.to_json(F.struct("map_name", "tileset_key", "starting_locations", "expansions"), {"pretty": "true"} if pretty else {})
    key = F.coalesce(F.nullif(S.ascii_slug(F.col("map_name")), F.lit("")), F.lit("unnamed"))
    named = F.col("map_key") if "map_key" in results.columns else key
    results.select(named.alias("map_key"), doc.alias("value")).write.mode("overwrite").partitionBy("map_key").option("lineSep", "\n").text(path)


def write_images(images: DataFrame, folder: str, column: str = "png", suffix: str = "png", key: str = "map_id") -> int:
    """``map_id`` (or another key) and a binary column to files in a shared folder, written by the tasks; returns how many."""

    def run(batches):
        import pandas as pd

        for b in batches:
            os.makedirs(folder, exist_ok=True)
            n = 0
            for k, data in zip(b[key], b[column]):
                if data is not None:
                    part = os.path.join(folder, f".{k}.{os.getpid()}.part")
                    with open(part, "wb") as f:
                        f.write(data)
                    os.replace(part, os.path.join(folder, f"{k}.{suffix}"))  # a task that runs twice leaves one whole file
                    n += 1
            yield pd.DataFrame({"n": [n]})

    return images.select(key, column).mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


# The digest's text.
HEAD = "# Replay map base digest\n\nPer-map base polygon names from replaymap analysis JSON. The **Natural expansion** column is the `natural_expansion` field on each start (name of the linked expansion polygon).\n\n"
CLEAN = "**Duplicate names:** none detected across analyzed maps.\n\n"
DUPES = "**Note:** one or more maps still had duplicate base names; see per-map **Duplicate names** lines.\n\n"


def write_digest(results: DataFrame, path: str, key: str = "result_id") -> None:
    """Sections in order of their key as text part files, the head first; nothing is gathered on the driver."""
    sections = relational.digest(results, key)
    any_dup = sections.where("duplicates > 0").limit(1).count() > 0
    head = results.sparkSession.createDataFrame([(HEAD + (DUPES if any_dup else CLEAN),)], "section string").withColumn("at", F.lit(None).cast(dict(results.dtypes)[key]))
    order = sections if key == "result_id" else sections.join(results.select("result_id", key).dropDuplicates(["result_id"]), "result_id")
    every = head.unionByName(order.select("section", F.col(key).alias("at")))
    every.orderBy(F.col("at").asc_nulls_first()).select(F.rtrim("section", F.lit("\n")).alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)
