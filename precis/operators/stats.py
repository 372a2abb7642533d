"""Distribution summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def equal_width_histogram(df: DataFrame, value: str, group: str, bins: int = 10) -> DataFrame:
    """``bins`` equal-width bins per group; the maximum goes to the last bin.

    Bounds come from a partial aggregate (one tiny row per group), joined
    back by group; the count is another partial aggregate, so a group that
    holds most rows never lands whole on one task.
    """
    bounds = df.groupBy(group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    x = df.join(bounds, group)
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(1)).otherwise(
        F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins) + 1, F.lit(bins)))
    return x.select(group, b.cast("long").alias("bin")).groupBy(group, "bin") \
        .agg(F.count(F.lit(1)).alias("n_docs"))
