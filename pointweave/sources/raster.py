"""Organised rasters as points: the validity filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_points(points: DataFrame) -> DataFrame:
    """All coordinates finite and z positive."""
    ok = F.col("z") > 0
    for a in "xyz":
        ok = ok & F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(F.col(a)) < float("inf"))
    return points.where(ok)
