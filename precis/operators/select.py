"""Filters, per-group limits, ordering and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_split(df: DataFrame, mode: str) -> DataFrame:
    """F1 (a partition filter when the data is written by split)."""
    return df.where(F.col("split") == mode)


def drop_empty(df: DataFrame, cols: Sequence[str] = ("document", "summary")) -> DataFrame:
    """a row filter, so pairs can never misalign."""
    cond = None
    for c in cols:
        k = F.length(c) > 0
        cond = k if cond is None else cond & k
    return df.where(cond)


def optional_lower(df: DataFrame, cols: Sequence[str], lower: bool) -> DataFrame:
    """lower-case ``cols`` when the flag is set."""
    return df.withColumns({c: F.lower(c) for c in cols}) if lower else df


def length_budget(df: DataFrame, doc_ids: str, sum_ids: str, n: int, sep_len: int = 1,
                  strict: bool = False) -> DataFrame:
    """F3 / F3b (``<=`` with a separator) and F3c (``strict``: ``<``, no separator)."""
    total = F.size(doc_ids) + F.size(sum_ids) + F.lit(sep_len)
    return df.where(total < n if strict else total <= n)


def all_keywords(df: DataFrame, col: str, words: Sequence[str]) -> DataFrame:
    """every keyword occurs as a substring (case-sensitive)."""
    cond = None
    for w in words:
        k = F.col(col).contains(w)
        cond = k if cond is None else cond & k
    return df.where(cond)


def _limit_per(df: DataFrame, k: int, part: str, order: list[Column]) -> DataFrame:
    if k is None or k <= 0:
        return df
    # row_number <= k over a partition is planned as a window group limit:
    # each map task keeps only its own first k rows per split before the shuffle.
    w = Window.partitionBy(part).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def head_per_split(df: DataFrame, k: int, key: str = "doc_id", part: str = "split") -> DataFrame:
    """first ``k`` rows of each split by key."""
    return _limit_per(df, k, part, [F.asc(key)])


def tail_per_split(df: DataFrame, k: int, key: str = "doc_id", part: str = "split") -> DataFrame:
    """F8: last ``k`` rows of each split by key."""
    return _limit_per(df, k, part, [F.desc(key)])


def first_k_accepted(df: DataFrame, predicate: Column, k: int, key: str = "doc_id",
                     part: str = "split") -> DataFrame:
    """limit after filter; ``k <= 0`` means no limit."""
    return _limit_per(df.where(predicate), k, part, [F.asc(key)])


def seeded_order(df: DataFrame, seed: int, key: str = "doc_id") -> DataFrame:
    """repeatable shuffle - a distributed sort on a hash of (key, seed)."""
    k = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return df.withColumn("shuffle_key", k).orderBy("shuffle_key")


def top_n_per_group(df: DataFrame, group: str, score: str, tie: str, n: int) -> DataFrame:
    """best ``n`` rows per group by score; ties go to the lower ``tie``."""
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def concat_all(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
