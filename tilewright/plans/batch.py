"""The batch job: uploads -> one per map key -> analysis -> JSON documents, overlay images and the digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators import analysis, maps, relational
from tilewright.session import cut
from tilewright.sinks import files


def picked(metadata: DataFrame, selector: str = "") -> DataFrame:
    """The map rows to analyse (``analysis.MAP_COLUMNS`` and map_key): the first upload of each key that the selector picks.

    ``metadata``: uploads with their ``tiles``. The narrow selection runs first; wide columns are read of the chosen uploads only.
    """
    chosen = relational.select_maps(metadata, selector).select("map_key", "replay_id")
    wide = metadata.select(F.col("replay_id").alias("map_id"), *analysis.MAP_COLUMNS[1:])
    return chosen.join(wide, chosen.replay_id == wide.map_id).drop("replay_id").dropDuplicates(["map_key"])


def results(picks: DataFrame, attributes: DataFrame) -> DataFrame:
    """(map_key, map_id, map_name, tileset_key, starting_locations, expansions, error), one row per map."""
    return analysis.analyze(picks, attributes).join(picks.select("map_id", "map_key"), "map_id")


def summary(done: DataFrame) -> DataFrame:
    """(map_key, map_id, starts, expansions, duplicates, error): what became of each map; an error skips the map, not the job."""
    names = F.transform(F.concat(F.coalesce("starting_locations", F.array()), F.coalesce("expansions", F.array())), lambda b: b["name"])
    return done.select(
        "map_key", "map_id", F.when(F.col("error").isNull(), F.size("starting_locations")).alias("starts"), F.when(F.col("error").isNull(), F.size("expansions")).alias("expansions"),
        F.when(F.col("error").isNull(), F.size(names) - F.size(F.array_distinct(names))).alias("duplicates"), "error",
    )


def run(metadata: DataFrame, attributes: DataFrame, folder: str, selector: str = "", packs: DataFrame | None = None) -> DataFrame:
    """Write ``json/map_key=<key>``, ``overlay/<key>.png`` and ``digest`` below a shared folder; returns the summary.

    Raises ValueError if no upload is picked or none can be analysed. With a selector the digest is of the picked maps.
    """
    picks = cut(picked(metadata, selector))
    if picks.isEmpty():
        raise ValueError(f"no upload of {selector!r}" if selector else "no uploads with a map key")
    done = cut(results(picks, attributes))
    good = done.where("error is null")
    if good.isEmpty():
        raise ValueError("no map could be analysed")
    files.write_json(good, f"{folder}/json")
    files.write_digest(good.withColumn("result_id", F.col("map_id")), f"{folder}/digest", "map_key")
    drawn = maps.overlay(picks.join(good.select("map_id"), "map_id", "left_semi"), attributes, packs=packs).join(picks.select("map_id", "map_key"), "map_id")
    files.write_images(drawn, f"{folder}/overlay", key="map_key")
    return summary(done)
