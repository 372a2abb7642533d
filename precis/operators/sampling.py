"""Per-step candidate filters and draws (W7 to W10) and the masked loss (M9).

The single-step tensor helpers are re-aimed as operators over a table
``(step_id, token_id, logit)``: every step is a window partition, so a
step's candidates are ranked and normalised where they live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _desc_order(step: str, logit: str, token: str):
    return Window.partitionBy(step).orderBy(F.desc(logit), F.asc(token))


def top_k(df: DataFrame, k: int, step: str = "step_id", logit: str = "logit", token: str = "token_id") -> DataFrame:
    """Keep the ``k`` best logits per step; ties with the k-th stay.
    ``k <= 0`` disables the filter."""
    if k <= 0:
        return df
    w = Window.partitionBy(step).orderBy(F.desc(logit))
    return df.withColumn("_r", F.rank().over(w)).where(F.col("_r") <= k).drop("_r")


def softmax(df: DataFrame, temperature: float = 1.0, step: str = "step_id", logit: str = "logit",
            out: str = "prob") -> DataFrame:
    """``exp(l/T - max) / sum`` within each step."""
    w = Window.partitionBy(step)
    z = F.col(logit) / F.lit(temperature)
    e = F.exp(z - F.max(z).over(w))
    return df.withColumn(out, e / F.sum(e).over(w))


def top_p(df: DataFrame, p: float, step: str = "step_id", logit: str = "logit", token: str = "token_id") -> DataFrame:
    """Nucleus filter on the (already filtered) candidates: softmax,
    then keep a candidate while the running sum *before* it is <= p (the
    best one always stays).  ``p <= 0`` disables the filter."""
    if p <= 0:
        return df
    s = softmax(df, 1.0, step, logit, "_p")
    prev = F.sum("_p").over(_desc_order(step, logit, token).rowsBetween(Window.unboundedPreceding, -1))
    return s.withColumn("_prev", F.coalesce(prev, F.lit(0.0))).where(F.col("_prev") <= p).drop("_p", "_prev")


def uniform(step: Column, token: Column, seed: int) -> Column:
    """A repeatable uniform in (0, 1) per (step, token, seed)."""
    key = F.concat_ws(":", step.cast("string"), token.cast("string"), F.lit(str(seed)))
    h = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double")
    return (h + 0.5) / F.lit(4294967296.0)


def draw(df: DataFrame, seed: int = 42, step: str = "step_id", token: str = "token_id", prob: str = "prob") -> DataFrame:
    """One weighted draw per step by the Gumbel-max trick
    (``argmax ln p - ln(-ln u)``), repeatable from the seed; a per-step
    aggregate, so no step's candidates leave their partition."""
    g = F.log(prob) - F.log(-F.log(uniform(F.col(step), F.col(token), seed)))
    return df.groupBy(step).agg(F.max_by(token, g).alias(token))


def masked_mean_loss(df: DataFrame, doc: str = "doc_id", pos: str = "pos", nll: str = "nll", tok: str = "token",
                     sum_idx=2, pad: int = 0) -> DataFrame:
    """M9: mean loss over summary positions (after ``sum_idx``, pad
    excluded) per document, then over documents; perplexity = exp(mean)."""
    b = F.col("sum_idx") if isinstance(sum_idx, str) else F.lit(sum_idx)
    per = df.where((F.col(pos) > b) & (F.col(tok) != pad)).groupBy(doc).agg(F.avg(nll).alias("_l"))
    return per.agg(F.avg("_l").alias("mean_loss")).select("mean_loss", F.exp("mean_loss").alias("perplexity"))
