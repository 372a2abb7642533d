"""Registered metric queries (M1 to M7, J3, J7) on conversation pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cleaning import scoring_columns
from ..functions.text import rouge_tokens, whitespace_tokens
from ..operators.metrics import corpus_bleu, evaluate_metrics, poisson_steps, rouge, rouge_bootstrap, rouge_scores
from ..session import table
from ..sources.corpus import conversation_pairs
from . import duck
from .registry import r6, register, round_all


def _pairs(spark, sf):
    return conversation_pairs(table(spark, sf, "conversations"))


# ------------------------------------------------------------------ SQL parts

def _bleu_sql(pred: str, ref: str, src: str, keys: list[str], group: list[str], max_order: int = 4,
              names=lambda n: f"bleu_{n}") -> str:
    """Corpus BLEU in DuckDB: grams exploded and clipped relationally."""
    k = keys + group
    ctes = [f"tok AS (SELECT {', '.join(k)}, {duck.ws_tokens(pred)} AS p, {duck.ws_tokens(ref)} AS r FROM {src})"]
    for n in range(1, max_order + 1):
        ctes.append(f"gr{n} AS (SELECT {', '.join(k)}, {duck.ngrams('p', n)} AS pg, {duck.ngrams('r', n)} AS rg FROM tok)")
        ctes.append(duck.overlap_ctes(f"b{n}", f"gr{n}", k, "pg", "rg"))
    g = ", ".join(group)
    gsel = (g + ", ") if group else ""
    gby = f" GROUP BY {g}" if group else ""
    sums = ", ".join([f"sum(len(p))::BIGINT AS pl", f"sum(len(r))::BIGINT AS rl"]
                     + [f"sum(greatest(len(p) - {n - 1}, 0))::BIGINT AS pos{n}" for n in range(1, max_order + 1)])
    ctes.append(f"s AS (SELECT {gsel}{sums} FROM tok{gby})")
    for n in range(1, max_order + 1):
        ctes.append(f"m{n} AS (SELECT {gsel}sum(o)::BIGINT AS m FROM b{n}_ov{gby})")
    joins = " ".join(f"LEFT JOIN m{n} ON " + (" AND ".join(f"m{n}.{c} = s.{c}" for c in group) if group else "TRUE")
                     for n in range(1, max_order + 1))
    prec = {n: f"(CASE WHEN s.pos{n} > 0 THEN coalesce(m{n}.m, 0) / s.pos{n} ELSE 0 END)" for n in range(1, max_order + 1)}
    outs = []
    for order in range(1, max_order + 1):
        ps = [prec[n] for n in range(1, order + 1)]
        logs = " + ".join(f"ln(greatest({p}, 1e-300))" for p in ps)
        outs.append(
            f"round(CASE WHEN least({', '.join(ps)}) <= 0 OR s.pl = 0 OR s.rl = 0 THEN 0.0 "
            f"ELSE exp(({logs}) / {order}) * (CASE WHEN s.pl > s.rl THEN 1.0 ELSE exp(1 - s.rl / s.pl) END) END, 6) "
            f"AS \"{names(order)}\"")
    gout = ", ".join(f"s.{c}" for c in group)
    return "WITH " + ", ".join(ctes) + f" SELECT {(gout + ', ') if group else ''}{', '.join(outs)} FROM s {joins}"


def _rouge_sql(pred: str, ref: str, src: str, keys: list[str], types=("rouge1", "rouge2"),
               group: list[str] = (), per_row: bool = False) -> str:
    """Per-row ROUGE-N in DuckDB, then averaged (or returned per row)."""
    k = list(keys) + list(group)
    kk = ", ".join(k)
    ctes = [f"tok AS (SELECT {kk}, {duck.rouge_tokens(pred)} AS p, {duck.rouge_tokens(ref)} AS r FROM {src})"]
    sel = []
    joins = []
    for t in types:
        n = int(t[5:])
        ctes.append(f"g{n} AS (SELECT {kk}, {duck.ngrams('p', n)} AS pg, {duck.ngrams('r', n)} AS rg FROM tok)")
        ctes.append(duck.overlap_ctes(f"r{n}", f"g{n}", k, "pg", "rg"))
        joins.append(f"LEFT JOIN r{n}_ov ON " + " AND ".join(f"r{n}_ov.{c} = tok.{c}" for c in k))
        o = f"coalesce(r{n}_ov.o, 0)"
        pp = f"({o} / greatest(len(p) - {n - 1}, 1))"
        rr = f"({o} / greatest(len(r) - {n - 1}, 1))"
        sel += [f"{pp} AS {t}_precision", f"{rr} AS {t}_recall",
                f"CASE WHEN {pp} + {rr} > 0 THEN 2 * {pp} * {rr} / ({pp} + {rr}) ELSE 0.0 END AS {t}_fmeasure"]
    ctes.append(f"per AS (SELECT {', '.join('tok.' + c for c in k)}, {', '.join(sel)} FROM tok {' '.join(joins)})")
    names = [f"{t}_{m}" for t in types for m in ("precision", "recall", "fmeasure")]
    if per_row:
        return "WITH " + ", ".join(ctes) + f" SELECT {kk}, " + ", ".join(f"round({c}, 6) AS {c}" for c in names) + " FROM per"
    g = ", ".join(group)
    return ("WITH " + ", ".join(ctes) + f" SELECT {(g + ', ') if group else ''}"
            + ", ".join(f"round(avg({c}), 6) AS {c}" for c in names) + " FROM per"
            + (f" GROUP BY {g}" if group else ""))


PAIRS_CTE = f"pairs AS ({duck.PAIRS})"


# --------------------------------------------------------------- M1 BLEU

@register("m1_bleu", "WITH " + PAIRS_CTE + ", q AS (" + _bleu_sql("prediction", "reference", "pairs", ["conv_id", "turn"], []) + ") SELECT * FROM q")
def m1_bleu(spark, sf):
    """Corpus BLEU-1..4 of assistant turns against the user turn before them."""
    return round_all(corpus_bleu(_pairs(spark, sf)))


# --------------------------------------------------------------- M2 ROUGE-1/2

@register("m2_rouge", "WITH " + PAIRS_CTE + ", q AS (" + _rouge_sql("prediction", "reference", "pairs", ["conv_id", "turn"]) + ") SELECT * FROM q")
def m2_rouge(spark, sf):
    return round_all(rouge(_pairs(spark, sf), types=("rouge1", "rouge2")))


@register("j7_rouge_per_pair", "WITH " + PAIRS_CTE + ", q AS (" + _rouge_sql("prediction", "reference", "pairs", ["conv_id", "turn"], per_row=True) + ") SELECT * FROM q")
def j7_rouge_per_pair(spark, sf):
    """J3 + J7: prediction aligned to reference by key, clipped n-gram matches per pair."""
    p = _pairs(spark, sf).select("conv_id", "turn", rouge_tokens("prediction").alias("p"),
                                 rouge_tokens("reference").alias("r"))
    return round_all(p.select("conv_id", "turn", *rouge_scores("p", "r", ("rouge1", "rouge2"))))


# --------------------------------------------------------------- M3 ROUGE-L
# The oracle computes the LCS with the classic dynamic programme, written
# as a recursive CTE over (pair, i, j) - a different algorithm from the
# Spark fold, so agreement is a real check.

_LCS_SQL = (
    "WITH RECURSIVE " + PAIRS_CTE + ", "
    f"tok AS (SELECT conv_id, turn, {duck.rouge_tokens('prediction')} AS p, {duck.rouge_tokens('reference')} AS r FROM pairs), "
    # row i of the DP table as a list over j = 0..len(r)
    "dp(conv_id, turn, i, row_) AS ("
    "  SELECT conv_id, turn, 0, list_transform(range(0, len(r) + 1), lambda j: 0) FROM tok"
    "  UNION ALL"
    "  SELECT dp.conv_id, dp.turn, dp.i + 1,"
    "    list_reduce(list_transform(range(1, len(t.r) + 1), lambda j: [j]),"
    "      lambda acc, x: list_append(acc, CASE WHEN t.p[dp.i + 1] = t.r[x[1]] THEN dp.row_[x[1]] + 1"
    "                                          ELSE greatest(acc[len(acc)], dp.row_[x[1] + 1]) END),"
    "      [0])"
    "  FROM dp JOIN tok t USING (conv_id, turn) WHERE dp.i < len(t.p)"
    "), "
    "lcs AS (SELECT t.conv_id, t.turn, len(t.p) AS lp, len(t.r) AS lr,"
    "  CASE WHEN len(t.p) = 0 OR len(t.r) = 0 THEN 0 ELSE d.row_[len(t.r) + 1] END AS l"
    "  FROM tok t JOIN dp d ON d.conv_id = t.conv_id AND d.turn = t.turn AND d.i = len(t.p)), "
    "per AS (SELECT l / greatest(lp, 1) AS pp, l / greatest(lr, 1) AS rr FROM lcs) "
    "SELECT round(avg(pp), 6) AS rougeL_precision, round(avg(rr), 6) AS rougeL_recall, "
    "round(avg(CASE WHEN pp + rr > 0 THEN 2 * pp * rr / (pp + rr) ELSE 0.0 END), 6) AS rougeL_fmeasure FROM per"
)


@register("m3_rouge_l", _LCS_SQL)
def m3_rouge_l(spark, sf):
    return round_all(rouge(_pairs(spark, sf), types=("rougeL",)))


# --------------------------------------------------------------- M4 mean

@register("m4_rouge_mean_by_role_len",
          "WITH " + PAIRS_CTE + ", src AS (SELECT *, CASE WHEN length(reference) < 200 THEN 'short' ELSE 'long' END AS bucket FROM pairs), q AS ("
          + _rouge_sql("prediction", "reference", "src", ["conv_id", "turn"], group=["bucket"]) + ") SELECT * FROM q")
def m4_rouge_mean(spark, sf):
    """M4 point value (mean over rows) per group: reference length bucket."""
    p = _pairs(spark, sf).withColumn("bucket", F.when(F.length("reference") < 200, "short").otherwise("long"))
    return round_all(rouge(p, types=("rouge1", "rouge2"), group_cols=["bucket"]))


def _interval_sql(n_resamples: int = 1000, seed: int = 42) -> str:
    """The bootstrap with one row a pair and replicate; products of 64 bits in 128, cut again."""
    def times(x: str, factor: int) -> str:
        return f"(({x})::UHUGEINT * {factor}::UHUGEINT % {1 << 64}::UHUGEINT)::UBIGINT"

    steps = "[" + ", ".join(f"{c!r}::DOUBLE" for c in map(float, poisson_steps())) + "]"
    names = [f"rouge{t}_{m}" for t in (1, 2) for m in ("precision", "recall", "fmeasure")]
    per = _rouge_sql("prediction", "reference", "pairs", ["conv_id", "turn"], per_row=True).replace("round(", "(").replace(", 6) AS", ") AS")
    return (
        "WITH " + PAIRS_CTE + f", per AS ({per}), "
        f"h AS (SELECT per.*, rep, ('0x' || substr(md5(conv_id || ':' || turn || ':{seed}'), 1, 15))::UBIGINT AS h "
        f"FROM per, range(1, {n_resamples + 1}) AS r(rep)), "
        f"g0 AS (SELECT *, ((h::UHUGEINT + {0x9E3779B97F4A7C15}::UHUGEINT * rep::UHUGEINT) % {1 << 64}::UHUGEINT)::UBIGINT AS g FROM h), "
        f"g1 AS (SELECT * REPLACE ({times('xor(g, g >> 30)', 0xBF58476D1CE4E5B9)} AS g) FROM g0), "
        f"g2 AS (SELECT * REPLACE ({times('xor(g, g >> 27)', 0x94D049BB133111EB)} AS g) FROM g1), "
        f"u AS (SELECT *, (xor(g, g >> 31) >> 11)::DOUBLE * {2.0 ** -53!r} AS u FROM g2), "
        f"w AS (SELECT *, len(list_filter({steps}, lambda c: c <= u)) AS w FROM u), "
        "m AS (SELECT rep, " + ", ".join(f"sum(w * {c}) / sum(w) AS {c}" for c in names) + " FROM w GROUP BY rep) "
        + " UNION ALL ".join(f"SELECT '{c}' AS metric, " + ", ".join(
            f"round(quantile_cont({c}, {q}), 6) AS {n}" for q, n in ((0.025, "low"), (0.5, "median"), (0.975, "high"))) + " FROM m" for c in names))


@register("m4_rouge_interval", _interval_sql())
def m4_rouge_interval(spark, sf):
    """M4 with intervals: 95 % bootstrap bounds and median of the mean (seeded
    replicates, drawn alike in SQL)."""
    b = rouge_bootstrap(_pairs(spark, sf), key_cols=["conv_id", "turn"], types=("rouge1", "rouge2"))
    long = b.unpivot([], b.columns, "metric", "bounds")
    return long.select("metric", *(F.round(F.col("bounds")[k], 6).alias(n) for k, n in enumerate(("low", "median", "high"))))


# --------------------------------------------------------------- M7 all ten

def _m7_sql(clean: bool = True) -> str:
    src = (f"SELECT conv_id, turn, {duck.scoring('prediction')} AS prediction, "
           f"{duck.scoring('reference')} AS reference FROM pairs") if clean else \
        "SELECT conv_id, turn, prediction, reference FROM pairs"
    bleu = _bleu_sql("prediction", "reference", "src", ["conv_id", "turn"], [])
    r12 = _rouge_sql("prediction", "reference", "src", ["conv_id", "turn"])
    lcs = _LCS_SQL.replace("WITH RECURSIVE " + PAIRS_CTE + ", ", "WITH RECURSIVE ").replace("FROM pairs)", "FROM src)")
    sel = [f"SELECT 'BLEU-{n}' AS metric, bleu_{n} AS value FROM b" for n in range(1, 5)]
    sel += [f"SELECT 'ROUGE-{t}-{m}' AS metric, {src_}.rouge{t}_{m} AS value FROM {src_}"
            for m in ("fmeasure", "recall") for t, src_ in (("1", "r"), ("2", "r"), ("L", "l"))]
    return ("WITH " + PAIRS_CTE + f", src AS ({src}), b AS ({bleu}), r AS ({r12}), l AS ({lcs}) "
            + " UNION ALL ".join(sel))


@register("m7_evaluate_metrics", _m7_sql())
def m7_evaluate_metrics(spark, sf):
    """All ten metrics after the scoring pipeline, long form (metric, value)."""
    out = evaluate_metrics(_pairs(spark, sf))
    return out.select("metric", r6("value").alias("value"))
