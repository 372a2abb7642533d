"""Vocabulary jobs: dense ids (A1, A2), encoding and decoding.

A subword tokenizer is a per-row codec; here it is re-aimed as what a
Spark user builds: a vocabulary table (word, id) computed once from the
corpus, joined to the distinct words of blocks of texts, and put in their places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regroup import GOES, replace_words
from ..functions.text import whitespace_tokens
from ..session import cut_lineage

# --- fixed values: reserved ids ---
PAD_ID, SEP_ID, UNK_ID = 0, 1, 2
SPECIAL_TOKENS = (("<pad>", PAD_ID), ("<sep>", SEP_ID), ("<unk>", UNK_ID))
FIRST_WORD_ID = 3

_LOW_BITS = (1 << 33) - 1


def global_index(df: DataFrame, order: Sequence[Column], name: str = "idx",
                 partitions: int | None = None) -> DataFrame:
    """Dense 0-based position of every row in a total order, distributed.

    Range-partition and sort by ``order`` (which must be unique), number rows
    inside each partition with ``monotonically_increasing_id`` (partition id
    in the high bits), then add each partition's offset.  The numbered rows
    are written before they are read for the counts and for the result, so
    both see one sampling of the ranges.  The offset table has one row per
    partition, so broadcasting it is bounded by the partition count.
    """
    n = partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = df.repartitionByRange(int(n), *order).sortWithinPartitions(*order) \
        .withColumn("_mid", F.monotonically_increasing_id())
    ranged = ranged.withColumn("_pid", F.shiftright("_mid", 33)) \
        .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))).drop("_mid")
    ranged = cut_lineage(ranged, "ranged")
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    return ranged.join(F.broadcast(offsets), "_pid") \
        .withColumn(name, F.col("_off") + F.col("_pos")).drop("_pid", "_pos", "_off")


def tokens_of(c, lower: bool = False) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return whitespace_tokens(F.lower(c) if lower else c)


def build_vocabulary(df: DataFrame, cols: Sequence[str] | str, lower: bool = False) -> DataFrame:
    """A1 + A2: ``(word, id, freq)``; reserved tokens first, then words by
    descending frequency, ties by word.  Counting is a partial (map-side)
    aggregate, so only one row per word and partition is shuffled.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    words = df.select(F.explode(F.concat(*[tokens_of(c, lower) for c in cols])).alias("word"))
    freq = words.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    ranked = global_index(freq, [F.desc("freq"), F.asc("word")], "id")
    ranked = ranked.select("word", (F.col("id") + FIRST_WORD_ID).alias("id"), "freq")
    special = df.sparkSession.createDataFrame(
        [(w, i, 0) for w, i in SPECIAL_TOKENS], "word string, id long, freq long")
    return special.unionByName(ranked)


def encode(df: DataFrame, cols: Sequence[str] | str, vocab: DataFrame, key_cols: Sequence[str] = ("doc_id",),
           lower: bool = False) -> DataFrame:
    """A1: replace text columns by ``array<int>`` id sequences (order kept;
    unknown words map to the reserved unknown id).  Rows with equal
    ``key_cols`` stay rows of their own; a null text gives a null sequence."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    ids = vocab.select("word", F.coalesce(F.col("id").cast("int"), F.lit(UNK_ID)).alias("value"))
    return replace_words(df, {c: tokens_of(c, lower) for c in cols}, ids, UNK_ID, joined=False)


def decode(df: DataFrame, col: str, vocab: DataFrame, key_cols: Sequence[str] = ("doc_id",),
           out: str = "text") -> DataFrame:
    """Ids back to text; reserved tokens are dropped.  Rows with equal
    keys stay apart; a null sequence gives a null text."""
    src = df.select(*key_cols, F.col(col).alias(out))
    words = vocab.where(F.col("id") >= FIRST_WORD_ID).select(F.col("id").cast("string").alias("word"), F.col("word").alias("value"))
    return replace_words(src, {out: F.transform(out, lambda x: x.cast("string"))}, words, GOES)
