"""Joins of a time range with points in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, keys: list[str], low: Column, high: Column, at: str, width: float) -> DataFrame:
    """Rows of left and right of equal keys with right's `at` in low..high; a row of left stands in every bucket of `width` that its range meets.

    Buckets are part of the equi-key, so a key of many rows is met range by range, not as a square. Ranges wider than
    `width` stand in more buckets. Rows of left are repeated for each row of right; those without one go.
    """
    width = max(width, 1e-6)
    ranged = left.withColumns({"_low": low, "_high": high}).where("_low <= _high")
    dealt = ranged.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_low") / width), F.floor(F.col("_high") / width))))
    points = right.withColumn("_bucket", F.floor(F.col(at) / width))
    # sizes of exploded rows are underestimated, so neither side may be broadcast
    return dealt.join(points.hint("merge"), [*keys, "_bucket"]).where(F.col(at).between(F.col("_low"), F.col("_high"))).drop("_bucket", "_low", "_high")
