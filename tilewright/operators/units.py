"""Unit sprites as joins: names and ids to sprites, anchors, the chain of game tables, siblings that share a picture.

The dimensions (names, anchors, game tables) are inputs, broadcast while they keep within 16-bit ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import scalar as S
from tilewright.session import beside

IDS = 65_536  # rows of a dimension that is broadcast: 16-bit ids


def resolve(requests: DataFrame, names: DataFrame) -> DataFrame:
    """``requests(name)`` to unit ids of ``names(unit_id, unit_name)``: decimal ids, or names whatever case and blanks.

    A name of several units means the lowest id. The error is null where an id was found.
    """
    key = S.unit_key(F.col("unit_name"))
    by_name = names.where(key != "").groupBy(key.alias("key")).agg(F.min("unit_id").alias("by_name"))
    by_id = names.select(F.col("unit_id").alias("by_id")).distinct()
    raw = F.trim("name")
    digits = raw.rlike("^[0-9]+$")
    r = requests.select("name", raw.alias("raw"), S.unit_key(F.col("name")).alias("key"), F.when(digits & (F.length(raw) <= 9), raw.cast("int")).alias("number"), digits.alias("digits"))
    j = r.join(beside(by_name, IDS), "key", "left").join(beside(by_id, IDS), F.col("number") == F.col("by_id"), "left")
    unit = F.when(F.col("digits"), F.col("by_id")).otherwise(F.col("by_name"))
    error = F.when(F.coalesce("raw", F.lit("")) == "", "name is empty").when(unit.isNull() & F.col("digits"), "no sprite for this id").when(unit.isNull(), "unknown name")
    return j.select("name", unit.alias("unit_id"), error.alias("error"))


def sprite_keys(units: DataFrame) -> DataFrame:
    """``units(unit_id, variant, shadow)`` with the key of the sprite file: u<id>, _<variant>, .shadow."""
    variant = F.coalesce("variant", F.lit(""))
    key = F.concat(F.lit("u"), F.col("unit_id").cast("string"), F.when(variant != "", F.concat(F.lit("_"), variant)).otherwise(""))
    return units.withColumn("sprite", key).withColumn("anchor_key", F.concat(key, F.when(F.coalesce("shadow", F.lit(False)), ".shadow").otherwise("")))


def anchors(units: DataFrame, table: DataFrame) -> DataFrame:
    """Anchor of each sprite from ``table(anchor_key, anchor_x, anchor_y)``; null where there is none."""
    return sprite_keys(units).join(beside(table, IDS), "anchor_key", "left")


def unit_images(units: DataFrame, flingies: DataFrame, sprites: DataFrame) -> DataFrame:
    """Unit -> flingy -> sprite -> image: ``units(unit, flingy)``, ``flingies(flingy, sprite)``, ``sprites(sprite, image)``."""
    return units.join(beside(flingies, IDS), "flingy").join(beside(sprites, IDS), "sprite").select("unit", "image")


def with_siblings(wanted: DataFrame, images: DataFrame, available: DataFrame) -> DataFrame:
    """``wanted(image)`` with the image whose animation to use: its own, else that of the lowest sibling of the same picture.

    ``images(image, grp_name)``; ``available(image)`` have an animation. Picture names are compared whatever their case.
    """
    i = images.select("image", F.lower("grp_name").alias("grp")).distinct()
    have = available.select(F.col("image").alias("own")).distinct()
    lowest = i.join(have, F.col("image") == F.col("own"), "left_semi").groupBy("grp").agg(F.min("image").alias("sibling"))
    w = wanted.select("image").distinct().join(i, "image").join(have, F.col("image") == F.col("own"), "left").join(beside(lowest, IDS), "grp", "left")
    return w.groupBy("image").agg(F.coalesce(F.min("own"), F.min("sibling")).alias("source"))
