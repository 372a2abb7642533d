"""Corpus sources and sinks (S1, S4 to S6) and the derived views.

A corpus is one DataFrame ``(split, doc_id, document, summary)``; the split
is a column (and a directory partition when written), never three lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_sentences

SPLITS = ("train", "val", "test")


def split_of(doc_id) -> Column:
    """Split rule used for the driver tables: ``doc_id % 10`` 0 test, 1 val."""
    k = F.pmod(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(10))
    return F.when(k == 0, "test").when(k == 1, "val").otherwise("train")


def load_corpus(spark: SparkSession, paths: str | dict[str, str], document_col: str = "document",
                summary_col: str = "summary", fmt: str = "parquet", id_col: str | None = "doc_id") -> DataFrame:
    """Read a corpus, rename its label columns to ``document/summary``.

    ``paths`` is one path whose rows (or ``split=`` folders) name their split,
    or a path for each split.  A row is identified by ``(split, doc_id)``; if
    the files have no id, one is made from the split, the file and the texts
    (so it does not depend on how the scan is cut; equal rows share it).
    """
    if isinstance(paths, dict):
        parts = [_labelled(spark.read.format(fmt).load(p), document_col, summary_col, id_col, s) for s, p in paths.items()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
    df = spark.read.format(fmt).load(paths)
    if "split" not in df.columns:
        raise ValueError(f"{paths} has no split column; give a path for each split")
    return _labelled(df, document_col, summary_col, id_col, None)


def _labelled(df: DataFrame, document_col: str, summary_col: str, id_col: str | None, split: str | None) -> DataFrame:
    df = df.withColumnsRenamed({document_col: "document", summary_col: "summary"})
    if split is not None:
        df = df.withColumn("split", F.lit(split))
    if id_col is not None and id_col in df.columns:
        return df.select("split", F.col(id_col).alias("doc_id"), "document", "summary")
    made = F.xxhash64("split", F.input_file_name(), "document", "summary")
    return df.select("split", made.alias("doc_id"), "document", "summary")


def corpus_from_documents(documents: DataFrame) -> DataFrame:
    """Stand-in corpus from the ``documents`` table.

    ``documents`` has no summaries, so the first sentence (T11) plays the
    reference summary.
    """
    return documents.select(
        split_of("doc_id").alias("split"),
        F.col("doc_id"),
        F.col("text").alias("document"),
        F.coalesce(F.try_element_at(split_sentences("text"), F.lit(1)), F.lit("")).alias("summary"),
    )


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """A user turn (reference) and the assistant turn right after it
    (prediction).  Equi-join on ``conv_id`` and ``turn + 1``."""
    u = conversations.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("reference"))
    a = conversations.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return u.join(a, ["conv_id", "turn"])


def sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Explode documents into ``(id, i, sentence)``; ``i`` is 0-based."""
    return df.select(F.col(id_col), F.posexplode(split_sentences(text_col)).alias("i", "sentence"))


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a dataset partitioned by split (JSON or Parquet)."""
    if fmt not in ("parquet", "json"):
        raise ValueError(f"unsupported format {fmt!r}; pickle is not supported")
    df.write.mode(mode).partitionBy("split").format(fmt).save(path)


def read_split(spark: SparkSession, path: str, mode: str, length: int | None = None,
               fmt: str = "parquet") -> DataFrame:
    """Read one split of an encoded dataset; optional head clip.

    Reading through the ``split`` partition column prunes the other
    directories.  An unknown split name raises.
    """
    if mode not in SPLITS:
        raise ValueError(f"unknown split {mode!r}; expected one of {SPLITS}")
    df = spark.read.format(fmt).load(path).where(F.col("split") == mode)
    if length is not None and length > 0:
        df = df.orderBy("doc_id").limit(length)
    return df
