"""Result-grid reporting (W1 to W6) over the long table
``(pipeline, model, metric, value)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ordinal(col: str, names: Sequence[str]):
    """Listing order of ``names`` (first listed wins ties); unknown names last."""
    expr = F.lit(len(names))
    for k, n in reversed(list(enumerate(names))):
        expr = F.when(F.col(col) == n, F.lit(k)).otherwise(expr)
    return expr


def sum_over_models(grid: DataFrame) -> DataFrame:
    """Per (metric, pipeline) the sum over models (reported as "avg")."""
    return grid.groupBy("metric", "pipeline").agg(F.sum("value").alias("avg"))


def best_per(df: DataFrame, part: str, choice: str, value: str, order: Sequence[str]) -> DataFrame:
    """Argmax of ``value`` per ``part``; ties go to the first
    ``choice`` in ``order``."""
    w = Window.partitionBy(part).orderBy(F.desc(value), _ordinal(choice, order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).select(part, choice, value)


def metric_by_model(grid: DataFrame, pipeline: str, models: Sequence[str]) -> DataFrame:
    """One pipeline as a metric x model matrix."""
    return grid.where(F.col("pipeline") == pipeline).groupBy("metric").pivot("model", list(models)).agg(F.max("value"))


def transpose(wide: DataFrame, key: str, cols: Sequence[str], new_key: str, names: Sequence[str]) -> DataFrame:
    """Rows ``key`` x columns ``cols`` -> rows ``new_key`` x columns ``names``
    (``unpivot`` then ``pivot``)."""
    long = wide.unpivot([key], list(cols), new_key, "value")
    return long.groupBy(new_key).pivot(key, list(names)).agg(F.first("value"))


def names(grid: DataFrame) -> DataFrame:
    """Available (kind, name) pairs."""
    each = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in ("metric", "pipeline", "model")]
    return grid.select(F.explode(F.array(*each)).alias("x")).select("x.kind", "x.name").distinct()
