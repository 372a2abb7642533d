"""Summary-quality metrics (M1 to M7) as additive aggregates.

Every metric is split into per-row sufficient statistics (computed inside
the row, so the text never moves) and a finishing expression over their
sums.  The sums are plain ``sum``/``count`` aggregates: partial aggregation
runs map-side, only one small row per group crosses the network, and the
same statistics work as streaming state (ST1, ST2).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams, rouge_tokens, whitespace_tokens

#: Increment and finishing steps of splitmix64.
_REPLICATE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = ((np.uint64(30), np.uint64(0xBF58476D1CE4E5B9)), (np.uint64(27), np.uint64(0x94D049BB133111EB)))


def _zero():
    return F.lit(0).cast("long")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clipped_overlap(pred_grams, ref_grams) -> Column:
    """``sum over g of min(count_pred(g), count_ref(g))`` inside one row.

    Both lists are tagged, merged and sorted, then folded once in sorted
    order (O(n log n)); no explode and no shuffle.
    """
    tagged = F.array_sort(F.concat(
        F.transform(_c(pred_grams), lambda g: F.struct(g.alias("g"), F.lit(0).alias("s"))),
        F.transform(_c(ref_grams), lambda g: F.struct(g.alias("g"), F.lit(1).alias("s"))),
    ))
    init = F.struct(F.lit(None).cast("string").alias("g"), _zero().alias("cp"),
                    _zero().alias("cr"), _zero().alias("m"))

    def step(acc, x):
        same = acc["g"].eqNullSafe(x["g"])
        is_p = F.when(x["s"] == 0, 1).otherwise(0).cast("long")
        return F.struct(
            x["g"].alias("g"),
            (F.when(same, acc["cp"]).otherwise(_zero()) + is_p).alias("cp"),
            (F.when(same, acc["cr"]).otherwise(_zero()) + (1 - is_p)).alias("cr"),
            F.when(same, acc["m"]).otherwise(acc["m"] + F.least(acc["cp"], acc["cr"])).alias("m"),
        )

    return F.aggregate(tagged, init, step, lambda acc: acc["m"] + F.least(acc["cp"], acc["cr"]))


def _lcs_one(p, r) -> int:
    """Bit-parallel LCS: bit j stands for reference token j; each prediction
    token is one addition on a whole-number of len(r) bits, so the cost is
    len(p) * len(r) / word size whatever the number of matches."""
    if p is None or r is None or len(p) == 0 or len(r) == 0:
        return 0
    where: dict = {}
    for j, t in enumerate(r):
        where[t] = where.get(t, 0) | 1 << j
    full = (1 << len(r)) - 1
    v = full
    for t in p:
        m = where.get(t)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(r) - v.bit_count()


def _lcs_batch(p: pd.Series, r: pd.Series) -> pd.Series:
    return pd.Series([_lcs_one(a, b) for a, b in zip(p, r)], dtype="int64")


_LCS_UDF = []


def _lcs_udf(p, r):
    if not _LCS_UDF:  # created lazily: a UDF needs an active session
        _LCS_UDF.append(F.pandas_udf(_lcs_batch, "long"))
    return _LCS_UDF[0](p, r)


def lcs_length(pred_tokens, ref_tokens) -> Column:
    """Longest common subsequence length of two token arrays.

    A per-row helper in an Arrow-batched pandas UDF: one long addition per
    token, so frequent words cost no more than rare ones.
    """
    return _lcs_udf(_c(pred_tokens), _c(ref_tokens))


#: Bytes of the texts whose n-grams are counted at once.
HELD_BYTES = 4 << 20


class _Tokens:
    """The tokens of rows of predictions and references (joined by spaces) as numbers, those of the predictions first."""

    def __init__(self, pred: pa.Array, ref: pa.Array):
        self.rows, words, self.sizes = len(pred), [], []
        for joined in (pred, ref):
            full = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(joined), 0), False).to_numpy(zero_copy_only=False))
            lists, n = pc.split_pattern(joined.take(pa.array(full)), " "), np.zeros(self.rows, np.int64)
            n[full] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            words.append(lists.flatten())
            self.sizes.append(n)
        self.code = _numbered(pa.concat_arrays(words))
        self.text = np.repeat(np.arange(2 * self.rows), np.concatenate(self.sizes))

    def overlaps(self, most: int) -> list[np.ndarray]:
        """:func:`clipped_overlap` of each row's n-grams, for n up to ``most``."""
        row, own = self.text % max(self.rows, 1), None
        gram, out = row * (len(self.code) + 1) + self.code, []
        for n in range(1, most + 1):
            at = np.flatnonzero(self.text[:max(len(self.text) - n + 1, 0)] == self.text[n - 1:])
            if n > 1:
                gram = gram[at] * (len(own) + 1) + own[at + n - 1]
            found = _numbered(pa.array(gram))
            kinds, of_pred = int(found.max(initial=-1)) + 1, self.text[at] < self.rows
            both = np.minimum(*(np.bincount(found[side], minlength=kinds) for side in (of_pred, ~of_pred)))
            home = np.zeros(kinds, np.int64)
            home[found] = row[at]
            out.append(np.bincount(home, both, self.rows).astype(np.int64))
            gram = np.zeros(len(self.text), np.int64)
            gram[at] = found
            own = gram if own is None else own
        return out

    def lcs(self) -> np.ndarray:
        ends = np.cumsum(np.concatenate(self.sizes))
        texts = [self.code[z - n:z].tolist() for z, n in zip(ends, np.concatenate(self.sizes))]
        return np.array([_lcs_one(p, r) for p, r in zip(texts[:self.rows], texts[self.rows:])], np.int64)


def _numbered(values: pa.Array) -> np.ndarray:
    return values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


#: What :func:`overlaps` counts.
OVERLAPS = ("match_1", "match_2", "match_3", "match_4", "rouge1", "rouge2", "rougeL")


def _count_overlaps(pw: pa.Array, rw: pa.Array, pr: pa.Array, rr: pa.Array) -> pa.Array:
    size = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (pw, rw, pr, rr))
    cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // HELD_BYTES)) + 1
    parts = []
    for lo, hi in zip([0, *cuts], [*cuts, len(pw)]):
        words, terms = _Tokens(pw[lo:hi], rw[lo:hi]), _Tokens(pr[lo:hi], rr[lo:hi])
        parts.append([*words.overlaps(4), *terms.overlaps(2), terms.lcs()])
    return pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], names=OVERLAPS)


def overlaps(pred_words, ref_words, pred_terms, ref_terms) -> dict[str, Column]:
    """What the two texts of a row share, by ``OVERLAPS``: clipped n-grams of their words up to order 4 (BLEU) and of their
    terms up to order 2 (ROUGE), and the longest common subsequence of the terms.

    Equal to :func:`clipped_overlap` and :func:`lcs_length` of the token arrays, null where those are; the rows of a batch
    are counted together."""
    if not _OVERLAPS_UDF:  # created lazily: a UDF needs an active session
        _OVERLAPS_UDF.append(F.arrow_udf(_count_overlaps, ", ".join(f"{c} bigint" for c in OVERLAPS)))
    tokens = [_c(c) for c in (pred_words, ref_words, pred_terms, ref_terms)]
    made = _OVERLAPS_UDF[0](*(F.array_join(c, " ") for c in tokens))
    # n-grams of a null array are none, but for n = 1
    both = {"match_1": tokens[:2], "rouge1": tokens[2:]}
    return {c: F.when(both[c][0].isNotNull() & both[c][1].isNotNull(), made[c]) if c in both else made[c] for c in OVERLAPS}


_OVERLAPS_UDF = []


# ---------------------------------------------------------------- BLEU (M1)

def bleu_stats(pred_tokens, ref_tokens, max_order: int = 4, counted: Mapping[str, Column] | None = None) -> list[Column]:
    """Per-row BLEU statistics: matches and possible n-grams per order,
    prediction and reference lengths.  ``counted`` has the matches, if they are known."""
    p, r = _c(pred_tokens), _c(ref_tokens)
    cols = []
    for n in range(1, max_order + 1):
        match = clipped_overlap(ngrams(p, n), ngrams(r, n)) if counted is None else counted[f"match_{n}"]
        cols.append(match.alias(f"match_{n}"))
        cols.append(F.greatest(F.size(p) - n + 1, F.lit(0)).cast("long").alias(f"possible_{n}"))
    cols.append(F.size(p).cast("long").alias("pred_len"))
    cols.append(F.size(r).cast("long").alias("ref_len"))
    return cols


def bleu_sums(max_order: int = 4) -> list[Column]:
    names = [f"{k}_{n}" for n in range(1, max_order + 1) for k in ("match", "possible")]
    return [F.sum(c).alias(c) for c in names + ["pred_len", "ref_len"]]


def bleu_finish(order: int) -> Column:
    """Corpus BLEU of max order ``order`` from summed statistics.

    Unsmoothed: any zero precision gives 0.  Brevity penalty
    ``exp(1 - ref/pred)`` unless the prediction corpus is longer.
    """
    precisions = [F.try_divide(F.col(f"match_{n}"), F.col(f"possible_{n}")) for n in range(1, order + 1)]
    any_zero = None
    for p in precisions:
        z = F.coalesce(p, F.lit(0.0)) <= 0
        any_zero = z if any_zero is None else (any_zero | z)
    log_mean = sum(F.log(F.when(p > 0, p)) for p in precisions) / order
    ratio = F.try_divide(F.col("pred_len"), F.col("ref_len"))
    bp = F.when(ratio > 1.0, F.lit(1.0)).otherwise(F.exp(1 - F.try_divide(F.lit(1.0), ratio)))
    return F.when(any_zero | ratio.isNull() | (ratio <= 0), F.lit(0.0)).otherwise(F.exp(log_mean) * bp)


def corpus_bleu(df: DataFrame, pred: str = "prediction", ref: str = "reference",
                max_order: int = 4, group_cols: Sequence[str] = (),
                tokenizer=whitespace_tokens) -> DataFrame:
    """M1: BLEU-1..max_order over the whole corpus (or per group)."""
    toks = df.select(*group_cols, tokenizer(pred).alias("_p"), tokenizer(ref).alias("_r"))
    stats = toks.select(*group_cols, *bleu_stats("_p", "_r", max_order))
    sums = stats.groupBy(*group_cols).agg(*bleu_sums(max_order))
    return sums.select(*group_cols, *[bleu_finish(n).alias(f"bleu_{n}") for n in range(1, max_order + 1)])


# --------------------------------------------------------------- ROUGE (M2, M3)

def _prf(overlap: Column, pred_n: Column, ref_n: Column, name: str) -> list[Column]:
    p = overlap / F.greatest(pred_n, F.lit(1))
    r = overlap / F.greatest(ref_n, F.lit(1))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return [p.alias(f"{name}_precision"), r.alias(f"{name}_recall"), f.alias(f"{name}_fmeasure")]


def rouge_scores(pred_tokens, ref_tokens, types: Sequence[str] = ("rouge1", "rouge2", "rougeL"),
                 counted: Mapping[str, Column] | None = None) -> list[Column]:
    """Per-row ROUGE precision / recall / F for the given types; ``counted`` has what the texts share, if it is known."""
    p, r = _c(pred_tokens), _c(ref_tokens)
    cols: list[Column] = []
    for t in types:
        if t == "rougeL":
            lcs = lcs_length(p, r) if counted is None else counted[t]
            empty = (F.size(p) == 0) | (F.size(r) == 0)
            lcs = F.when(empty, _zero()).otherwise(lcs)
            cols += _prf(lcs, F.size(p), F.size(r), t)
        else:
            n = int(t.replace("rouge", ""))
            pn = F.greatest(F.size(p) - n + 1, F.lit(0))
            rn = F.greatest(F.size(r) - n + 1, F.lit(0))
            cols += _prf(clipped_overlap(ngrams(p, n), ngrams(r, n)) if counted is None else counted[t], pn, rn, t)
    return cols


def rouge(df: DataFrame, pred: str = "prediction", ref: str = "reference",
          types: Sequence[str] = ("rouge1", "rouge2", "rougeL"),
          group_cols: Sequence[str] = ()) -> DataFrame:
    """M2 / M3 / M4: per-row scores averaged over rows (the point value)."""
    toks = df.select(*group_cols, rouge_tokens(pred).alias("_p"), rouge_tokens(ref).alias("_r"))
    per = toks.select(*group_cols, *rouge_scores("_p", "_r", types))
    names = [c for c in per.columns if c not in group_cols]
    return per.groupBy(*group_cols).agg(*[F.avg(c).alias(c) for c in names])


def poisson_steps() -> np.ndarray:
    """The cumulative distribution of Poisson(1), up to where doubles end."""
    return np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(18)])


def rouge_bootstrap(df: DataFrame, pred: str = "prediction", ref: str = "reference",
                    key_cols: Sequence[str] = ("doc_id",), types: Sequence[str] = ("rouge1", "rouge2", "rougeL"),
                    n_resamples: int = 1000, seed: int = 42,
                    quantiles: Sequence[float] = (0.025, 0.5, 0.975)) -> DataFrame:
    """M4 with intervals: seeded Poisson(1) bootstrap of the row mean.

    Each row takes a repeatable Poisson(1) weight per replicate (splitmix64 over
    60 bits of the MD5 of key and seed, and the replicate's number), so
    replicates are weighted means.  Each task
    sums its rows' weighted scores for all replicates (a matrix product per
    batch) and sends one row per replicate; rows are not copied.
    """
    toks = df.select(*key_cols, rouge_tokens(pred).alias("_p"), rouge_tokens(ref).alias("_r"))
    per = toks.select(*key_cols, *rouge_scores("_p", "_r", types))
    names = [c for c in per.columns if c not in key_cols]
    start_of = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key_cols], F.lit(str(seed))))
    per = per.select(F.conv(F.substring(start_of, 1, 15), 16, 10).cast("long").alias("_h"),
                     *[F.col(c).cast("double").alias(c) for c in names])
    # Poisson(1) by inverse CDF: the weight is the number of steps that the
    # uniform value reaches; the last step is where doubles end.
    cdf = poisson_steps()

    def partial(batches):
        total = np.zeros((n_resamples, len(names) + 1))
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in names] + [np.ones(len(h))])
            for start in range(0, len(h), 512):
                g = h[start:start + 512, None] + _REPLICATE * np.arange(1, n_resamples + 1, dtype=np.uint64)[None, :]
                for shift, factor in _SPREAD:
                    g = (g ^ (g >> shift)) * factor
                g ^= g >> np.uint64(31)
                w = np.searchsorted(cdf, (g >> np.uint64(11)) * 2.0 ** -53, "right")
                total += w.T @ x[start:start + 512]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n_resamples)), *(pa.array(c) for c in total.T)], names=["rep", *names, "_w"])

    sql = ", ".join(["rep bigint", *(f"{c} double" for c in names), "_w double"])
    sums = per.mapInArrow(partial, sql).groupBy("rep").agg(*[F.sum(c).alias(c) for c in [*names, "_w"]])
    means = sums.select("rep", *[F.try_divide(F.col(c), F.col("_w")).alias(c) for c in names])
    return means.agg(*[F.percentile(F.col(c), list(quantiles)).alias(c) for c in names])


# ------------------------------------------------------------- M5: vectors

def cosine(a, b) -> Column:
    """Cosine of two equal-length numeric arrays; a zero vector gives 0."""
    a, b = _c(a), _c(b)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, v: s + v * v))
    return F.when((na > 0) & (nb > 0), dot / (na * nb)).otherwise(F.lit(0.0))


# ------------------------------------------------------------- U6: metrics of the user

@dataclass(frozen=True)
class Metric:
    """A metric as partial statistics and a finish.

    ``stats(prediction, reference)`` names numeric Columns of one row;
    ``finish(sums, rows)`` makes the value from their sums (by name) and the
    number of rows.  Both run in the pass and the aggregate of the others.
    """

    stats: Callable[[Column, Column], Mapping[str, Column]]
    finish: Callable[[Mapping[str, Column], Column], Column]


#: Metrics of the user by name; :func:`evaluate_metrics` adds them to its ten.
METRICS: dict[str, Metric] = {}


def register_metric(name: str, metric: Metric) -> Callable[[], None]:
    """Add a metric under ``name``; returns a function that takes it out again."""
    before = METRICS.get(name)
    METRICS[name] = metric

    def undo() -> None:
        if before is None:
            METRICS.pop(name, None)
        else:
            METRICS[name] = before

    return undo


# ------------------------------------------------------------- M7: all ten

def evaluate_metrics(df: DataFrame, pred: str = "prediction", ref: str = "reference",
                     group_cols: Sequence[str] = (), clean: bool = True,
                     metrics: Mapping[str, Metric] | None = None) -> DataFrame:
    """M7: the ten reported metrics in long form ``(group..., metric, value)``,
    and those of ``metrics`` (by default the registered ones).

    With ``clean`` both texts first go through the ``scoring`` pipeline (P6:
    lower-case, all punctuation removed).  BLEU, ROUGE and the others share one
    pass over the rows and one aggregate.
    """
    from ..functions.cleaning import scoring_columns

    own = {m: {f"_u{k}_{j}": (n, c) for j, (n, c) in enumerate(x.stats(F.col(pred), F.col(ref)).items())}
           for k, (m, x) in enumerate((METRICS if metrics is None else metrics).items())}
    own_cols = {a: c for cols in own.values() for a, (_, c) in cols.items()}

    src = df
    if clean:
        src = df.select(*group_cols, scoring_columns(pred).alias(pred), scoring_columns(ref).alias(ref))
    toks = src.select(*group_cols, whitespace_tokens(pred).alias("_pw"), whitespace_tokens(ref).alias("_rw"),
                      rouge_tokens(pred).alias("_pr"), rouge_tokens(ref).alias("_rr"),
                      *(c.cast("double").alias(a) for a, c in own_cols.items()))
    shared = overlaps("_pw", "_rw", "_pr", "_rr")
    per = toks.select(*group_cols, *bleu_stats("_pw", "_rw", 4, shared), *rouge_scores("_pr", "_rr", counted=shared), *own_cols)
    rouge_names = [f"{t}_{m}" for t in ("rouge1", "rouge2", "rougeL") for m in ("fmeasure", "recall")]
    agg = per.groupBy(*group_cols).agg(*bleu_sums(4), *[F.avg(c).alias(c) for c in rouge_names],
                                       *[F.sum(a).alias(a) for a in own_cols], F.count(F.lit(1)).alias("_rows"))
    finish = (METRICS if metrics is None else metrics)
    wide = agg.select(
        *group_cols,
        *[bleu_finish(n).alias(f"BLEU-{n}") for n in range(1, 5)],
        *[F.col(f"{t}_fmeasure").alias(f"ROUGE-{t[5:]}-fmeasure") for t in ("rouge1", "rouge2", "rougeL")],
        *[F.col(f"{t}_recall").alias(f"ROUGE-{t[5:]}-recall") for t in ("rouge1", "rouge2", "rougeL")],
        *[finish[m].finish({n: F.col(a) for a, (n, _) in cols.items()}, F.col("_rows")).cast("double").alias(m)
          for m, cols in own.items()],
    )
    metric_cols = [c for c in wide.columns if c not in group_cols]
    return wide.unpivot(list(group_cols), metric_cols, "metric", "value")
