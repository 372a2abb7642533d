"""Registered sampling and loss queries (W7 to W10, M9) on ``lineitem``:
step = l_orderkey, token = l_linenumber, logit = l_extendedprice / 10000."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as S
from ..session import table
from .registry import register

K, P, T, SEED = 5, 0.9, 0.8, 42

_STEPS = "steps AS (SELECT l_orderkey AS step_id, l_linenumber AS token_id, l_extendedprice / 10000 AS logit FROM lineitem)"
_TOPK = f"tk AS (SELECT * FROM steps QUALIFY rank() OVER (PARTITION BY step_id ORDER BY logit DESC) <= {K})"
_TOPP = ("sm AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY step_id)) AS e FROM tk), "
         "pr AS (SELECT step_id, token_id, logit, e / sum(e) OVER (PARTITION BY step_id) AS p FROM sm), "
         "tp AS (SELECT step_id, token_id, logit FROM pr QUALIFY coalesce(sum(p) OVER (PARTITION BY step_id "
         f"ORDER BY logit DESC, token_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) <= {P!r})")
_TEMP = (f"st AS (SELECT *, exp(logit / {T!r} - max(logit / {T!r}) OVER (PARTITION BY step_id)) AS e FROM tp), "
         "pt AS (SELECT step_id, token_id, e / sum(e) OVER (PARTITION BY step_id) AS prob FROM st)")


def _steps(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("step_id"), F.col("l_linenumber").alias("token_id"),
                     (F.col("l_extendedprice") / 10000).alias("logit"))


@register("w7_top_k", f"WITH {_STEPS}, {_TOPK} SELECT step_id, token_id FROM tk")
def w7_top_k(spark, sf):
    return S.top_k(_steps(spark, sf), K).select("step_id", "token_id")


@register("w8_nucleus_filter", f"WITH {_STEPS}, {_TOPK}, {_TOPP} SELECT step_id, token_id FROM tp")
def w8_nucleus_filter(spark, sf):
    """W8 after W7, as in the decoder."""
    return S.top_p(S.top_k(_steps(spark, sf), K), P).select("step_id", "token_id")


@register("w9_temperature_softmax",
          f"WITH {_STEPS}, {_TOPK}, {_TOPP}, {_TEMP} SELECT step_id, token_id, round(prob, 6) AS prob FROM pt")
def w9_temperature_softmax(spark, sf):
    s = S.softmax(S.top_p(S.top_k(_steps(spark, sf), K), P), T)
    return s.select("step_id", "token_id", F.round("prob", 6).alias("prob"))


@register("w10_weighted_draw",
          f"WITH {_STEPS}, {_TOPK}, {_TOPP}, {_TEMP}, "
          "u AS (SELECT *, (('0x' || substr(md5(step_id::VARCHAR || ':' || token_id::VARCHAR || ':" + str(SEED)
          + "'), 1, 8))::BIGINT + 0.5) / 4294967296.0 AS u FROM pt) "
          "SELECT step_id, arg_max(token_id, ln(prob) - ln(-ln(u))) AS token_id FROM u GROUP BY step_id")
def w10_weighted_draw(spark, sf):
    s = S.softmax(S.top_p(S.top_k(_steps(spark, sf), K), P), T)
    return S.draw(s, SEED)


@register("m9_masked_loss",
          "WITH t AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, l_quantity / 10 AS nll, l_suppkey % 5 AS token "
          "FROM lineitem), per AS (SELECT doc_id, avg(nll) AS l FROM t WHERE pos > 2 AND token <> 0 GROUP BY doc_id) "
          "SELECT round(avg(l), 6) AS mean_loss, round(exp(avg(l)), 6) AS perplexity FROM per")
def m9_masked_loss(spark, sf):
    """M9 on a lineitem stand-in: doc = order, position = line number,
    loss = quantity / 10, token = supplier mod 5 (0 plays the pad id)."""
    li = table(spark, sf, "lineitem")
    t = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"),
                  (F.col("l_quantity") / 10).alias("nll"), F.pmod("l_suppkey", F.lit(5)).alias("token"))
    r = S.masked_mean_loss(t, sum_idx=2)
    return r.select(F.round("mean_loss", 6).alias("mean_loss"), F.round("perplexity", 6).alias("perplexity"))
