"""Stream enrichment: points that arrive are placed in the base regions of their map.

A stream-static join without state: points meet the bases' cells of a coarse grid by equality on (result, cell), then the
exact polygon test decides. The static side is broadcast only while it is small; otherwise Spark shuffles it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import scalar as S
from tilewright.operators.relational import bases_of
from tilewright.session import small_enough

CELL = 64  # minitiles; a base spans a few cells
BROADCAST_ROWS = 200_000


def zones(results: DataFrame) -> DataFrame:
    """(result_id, cell_x, cell_y, base_no, name, polygon_vertices): each polygon under each coarse cell its box touches."""
    v = F.filter("polygon_vertices", lambda p: p.isNotNull())
    box = lambda f, k: f(F.transform(v, lambda p: p[k]))
    b = bases_of(results).select("result_id", "base_no", "name", "polygon_vertices", *(F.floor(box(f, k) / CELL).alias(f"{n}_{k}") for n, f in (("lo", F.array_min), ("hi", F.array_max)) for k in "xy")).where("lo_x is not null")
    return b.select("result_id", "base_no", "name", "polygon_vertices", F.explode(F.sequence("lo_x", "hi_x")).alias("cell_x"), "lo_y", "hi_y").select(
        "result_id", "base_no", "name", "polygon_vertices", "cell_x", F.explode(F.sequence("lo_y", "hi_y")).alias("cell_y")
    )


def place(points: DataFrame, zones_: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """``points(result_id, x, y, ...)`` in minitiles, batch or stream, with the base they lie in: inner join, no state."""
    if broadcast is None:
        broadcast = small_enough(zones_, BROADCAST_ROWS)
    z = F.broadcast(zones_) if broadcast else zones_
    p = points.withColumn("cell_x", F.floor(F.col("x") / CELL)).withColumn("cell_y", F.floor(F.col("y") / CELL))
    j = p.join(z, ["result_id", "cell_x", "cell_y"])
    return j.where(S.point_in_polygon(F.col("x").cast("double"), F.col("y").cast("double"), F.col("polygon_vertices"))).drop("cell_x", "cell_y", "polygon_vertices")


def ownership(placed: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Points per base and event-time window, late data dropped behind the watermark; needs a timestamp column ``ts``."""
    return placed.withWatermark("ts", watermark).groupBy(F.window("ts", window), "result_id", "base_no").agg(F.count("*").alias("points"))
