"""Column functions over polygons that need a numpy kernel: Arrow batches in, Arrow batches out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.operators import outline


@F.pandas_udf(T.DoubleType())
def _iou(a: pd.Series, b: pd.Series) -> pd.Series:
    line = lambda v: [(p["x"], p["y"]) for p in v if p is not None] if v is not None else []
    return pd.Series([None if x is None or y is None else outline.iou(line(x), line(y)) for x, y in zip(a, b)], dtype="float64")


def iou(a: Column, b: Column) -> Column:
    """Overlap of two polygons by cell centres; null where either is null."""
    return _iou(a, b)
