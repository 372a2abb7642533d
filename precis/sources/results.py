"""Result files (S8 to S11): the nested benchmark JSON and per-run metric
dictionaries, kept as long tables inside Spark and nested only at the
file edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import METRIC_NAMES

GRID_SCHEMA = "map<string, map<string, map<string, double>>>"


def grid_to_json(grid: DataFrame) -> DataFrame:
    """Long grid -> one row holding ``{pipeline: {model: {metric: v}}}``
    as JSON.  The nesting happens after the (small, config-sized) grid is
    aggregated, never on data-sized input."""
    m = grid.groupBy("pipeline", "model").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    mm = m.groupBy("pipeline").agg(F.map_from_entries(F.collect_list(F.struct("model", "m"))).alias("mm"))
    return mm.agg(F.map_from_entries(F.collect_list(F.struct("pipeline", "mm"))).alias("g")) \
        .select(F.to_json("g").alias("value"))


def write_grid(grid: DataFrame, path: str) -> None:
    grid_to_json(grid).coalesce(1).write.mode("overwrite").text(path)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON back to ``(pipeline, model, metric, value)``; keys
    stored as ``CourpusPreprocessor(name)`` are reduced to ``name``."""
    raw = spark.read.text(path).select(F.from_json("value", GRID_SCHEMA).alias("g"))
    a = raw.select(F.explode("g").alias("pipeline", "mm"))
    b = a.select("pipeline", F.explode("mm").alias("model", "m"))
    c = b.select("pipeline", "model", F.explode("m").alias("metric", "value"))
    name = F.regexp_extract("pipeline", r"^\w+\((.*)\)$", 1)
    return c.select(F.when(name != "", name).otherwise(F.col("pipeline")).alias("pipeline"), "model", "metric", "value")


def write_run_metrics(metrics: DataFrame, path: str, decoder: dict | None = None) -> None:
    """One flat metric dictionary per run (``metric, value`` long rows
    pivoted into one JSON object), with an optional ``decoder_cnf`` struct."""
    wide = metrics.groupBy().pivot("metric", list(METRIC_NAMES)).agg(F.first("value"))
    if decoder is not None:
        wide = wide.withColumn("decoder_cnf", F.struct(*[F.lit(v).alias(k) for k, v in decoder.items()]))
    wide.coalesce(1).write.mode("overwrite").json(path)


def read_run_metrics(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Runs keyed by their directory name, ``decoder_cnf`` dropped,
    unpivoted to ``(model, metric, value)``."""
    df = spark.read.json(paths).withColumn("_file", F.input_file_name())
    if "decoder_cnf" in df.columns:
        df = df.drop("decoder_cnf")
    metric_cols = [c for c in df.columns if c != "_file"]
    model = F.regexp_extract("_file", r"/([^/]+)/[^/]*$", 1)
    long = df.withColumn("model", model).unpivot(["model"], metric_cols, "metric", "value")
    return long.where(F.col("value").isNotNull())
