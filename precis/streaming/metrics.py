"""Structured Streaming versions of the metrics and the cleaning pipeline
(ST1 to ST4).

The metric state is the additive statistics of :mod:`precis.operators.metrics`:
per-row work is a stateless projection, the running state is a global (or
per-key) ``sum``, and the score is a finishing expression over the sums.
"Reset" (ST4) is a new query with a new checkpoint location.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import rouge_tokens, whitespace_tokens
from ..operators.metrics import bleu_finish, bleu_stats, bleu_sums, rouge_scores
from ..session import ensure_checkpoint_dir


#: Files of one micro-batch: enough for the session's cores to work side by side.
FILES_PER_BATCH = 64


def _scratch(spark: SparkSession, tag: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/precis-stream-{tag}-{uuid.uuid4().hex}"


def stage_files(df: DataFrame, parts: int | None = None, rows_per_file: int = 100_000) -> str:
    """Write a batch DataFrame as Parquet files to replay as a stream: as many
    as its tasks and ``rows_per_file`` make, or ``parts`` if given (tests)."""
    path = _scratch(df.sparkSession, "src")
    (df.repartition(parts) if parts else df).write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return path


def bleu_state(stream: DataFrame, pred: str = "prediction", ref: str = "reference", max_order: int = 4,
               group_cols: Sequence[str] = ()) -> DataFrame:
    """ST1 state: running sums of the BLEU statistics."""
    toks = stream.select(*group_cols, whitespace_tokens(pred).alias("_p"), whitespace_tokens(ref).alias("_r"))
    return toks.select(*group_cols, *bleu_stats("_p", "_r", max_order)).groupBy(*group_cols).agg(*bleu_sums(max_order))


def rouge_state(stream: DataFrame, pred: str = "prediction", ref: str = "reference",
                types: Sequence[str] = ("rouge1", "rouge2"), group_cols: Sequence[str] = ()) -> DataFrame:
    """ST2 state: running sums and count of per-row ROUGE scores."""
    toks = stream.select(*group_cols, rouge_tokens(pred).alias("_p"), rouge_tokens(ref).alias("_r"))
    per = toks.select(*group_cols, *rouge_scores("_p", "_r", types))
    names = [c for c in per.columns if c not in group_cols]
    return per.groupBy(*group_cols).agg(*[F.sum(c).alias(c) for c in names], F.count(F.lit(1)).alias("n"))


def run_available(state: DataFrame) -> DataFrame:
    """Run a streaming aggregate over everything available now and return its
    final result table.  Each micro-batch writes the complete state (a row per
    group) to a folder of its own on shared storage; nothing goes through the
    driver, and the last folder is the answer."""
    spark = state.sparkSession
    base, last = _scratch(spark, "state"), []

    def write(batch: DataFrame, number: int) -> None:
        path = f"{base}/{number}"
        batch.write.mode("overwrite").parquet(path)
        last[:] = [path]

    q = (state.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", _scratch(spark, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    if not last:
        return spark.createDataFrame([], state.schema)
    return spark.read.schema(state.schema).parquet(last[0])


def streaming_bleu(spark: SparkSession, path: str, schema, max_order: int = 4) -> DataFrame:
    """ST1 end to end: file source -> running sums -> BLEU-1..n."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(path)
    sums = run_available(bleu_state(stream, max_order=max_order))
    return sums.select(*[bleu_finish(n).alias(f"bleu_{n}") for n in range(1, max_order + 1)])


def streaming_rouge(spark: SparkSession, path: str, schema, types=("rouge1", "rouge2")) -> DataFrame:
    """ST2 end to end: the running mean of per-row scores."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(path)
    sums = run_available(rouge_state(stream, types=types))
    names = [f"{t}_{m}" for t in types for m in ("precision", "recall", "fmeasure")]
    return sums.select(*[(F.col(c) / F.col("n")).alias(c) for c in names])


def streaming_clean(spark: SparkSession, path: str, schema, pipeline, text_col: str = "text",
                    key_cols: Sequence[str] = ("doc_id",)) -> DataFrame:
    """ST3: a narrow cleaning pipeline on a stream, appended to Parquet."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(path)
    out = stream.select(*key_cols, pipeline.column(text_col).alias(text_col))
    sink = _scratch(spark, "sink")
    q = (out.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", _scratch(spark, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink)
