"""Order statistics of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sketch's ranks are right to a ten-thousandth of a group.
ACCURACY = 10_000


def order_statistic(rows: DataFrame, keys: list[str], value: Column | str, *, share: float = 0.5, out: str = "statistic") -> DataFrame:
    """keys and out: the value at place floor(n * share), from 0, of each group's sorted values (the last at most); null for a group without one.

    A quantile sketch brackets the place; rows below the bracket are counted, and those in it by value; a running sum over these values finds the one at the place.
    So a group is never held as a list or a map of its values: what one task sums up is the distinct values in a bracket of four ten-thousandths of the group.
    Nulls and NaN don't count.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    given = rows.select(F.struct(*keys).alias("_k") if keys else F.struct(F.lit(0).alias("_")).alias("_k"), F.when(~F.isnan(v), v).alias("_v"))
    slack = 2 / ACCURACY
    ends = F.percentile_approx("_v", F.array(F.lit(max(0.0, share - slack)), F.lit(min(1.0, share + slack))), F.lit(ACCURACY))
    about = given.groupBy("_k").agg(F.count("_v").alias("_n"), ends.alias("_e"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    # the sketch keeps values, so its ends are among them; the outermost stand for shares beyond the ends
    bounds = about.select("_k", "_n", F.when(F.lit(share <= slack), F.col("_min")).otherwise(F.col("_e")[0]).alias("_low"), F.when(F.lit(share >= 1 - slack), F.col("_max")).otherwise(F.col("_e")[1]).alias("_high"))
    met = given.where("_v IS NOT NULL").join(bounds, "_k").where("_v <= _high")
    shown = F.when(F.col("_v") >= F.col("_low"), F.col("_v"))  # all rows below the bracket are one value, null
    counts = met.groupBy("_k", shown.alias("_v")).agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    upto = F.sum("_c").over(Window.partitionBy("_k").orderBy(F.col("_v").asc_nulls_first()))
    place = F.least(F.floor(F.col("_n") * share), F.col("_n") - 1)
    found = counts.withColumn("_upto", upto).where((F.col("_upto") > place) & F.col("_v").isNotNull()).groupBy("_k").agg(F.min("_v").alias(out))
    own = [F.col(f"_k.{k}").alias(k) for k in keys]
    return about.select("_k").join(found, "_k", "left").select(*own, out)
