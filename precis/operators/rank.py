"""Extractive sentence rankers (R1 to R10) as Spark plans.

Input is a sentence table ``(doc_id, i, sentence)`` (T11).  Every ranker
returns ``(doc_id, i, score)`` for every sentence; :func:`assemble` turns
scores into summaries (F11 + R8).

Design notes (scale):

* Words are the unit of work: ``(doc_id, i, w, c)`` rows, keyed so that a
  long document spreads over many tasks.
* TextRank's edge weight ``sum_w c_i(w) c_j(w) / (ln L_i + ln L_j)`` factors
  through per-(document, word, sentence length) sums, so the power
  iteration never materialises sentence pairs: each round is two
  aggregates over word rows.
* Embedding TextRank's cosine weights are dot products of unit vectors, so
  a round needs the document's weighted vector sum only: two products with
  the matrix of its sentence vectors (``applyInArrow``, one shuffle).
* LexRank thresholds each pair similarity, which needs the exact pair
  value; candidates come from exact prefix filtering (rare words only).
* Iterations stop per document (each document converges on its own).
* A document of bounded size (``SMALL``) runs all its rounds where its rows
  are: one shuffle by document, then a numpy kernel (``rank_kernels``).  A
  larger one goes through rounds of joins and aggregates, whose state is
  written under ``spark.checkpoint.dir``; no task holds it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import (LEXRANK_EPSILON, LEXRANK_THRESHOLD, LSA_SMOOTH, LUHN_MAX_GAP,
                               PAGERANK_ALPHA, PAGERANK_MAX_ITER, PAGERANK_TOL, ROW_NORM_EPS, TEXTRANK_DAMPING,
                               TEXTRANK_EPSILON, VECTOR_DIVISOR_EPS)
from ..functions.text import rank_words, split_sentences, whitespace_tokens
from ..session import cut_lineage
from . import rank_kernels
from .long_documents import embedding_rounds
from .metrics import cosine
from .text_vectors import VectorTable, over_vectors, per_document, same_as_before

K = ["doc_id", "i"]
#: Sentences, and characters in them, of a document that one task may hold.
SMALL = (2_000, 1_000_000)
#: The same where a task makes LexRank's edges, some rows of a document's matrix at a time.
SMALL_EDGES = (20_000, 1_000_000)
#: Edges and nodes of a document's graph that one task may hold.
SMALL_GRAPH = 1_000_000
#: Sentences of a document whose vectors one task may hold.
SMALL_VECTORS = 20_000
# A row of the cosine graph whose weights sum to (numerically) zero is
# dangling: exactly zero for a zero vector or a one-sentence document.
DANGLING_EPS = 1e-12


# ------------------------------------------------------------------ inputs

def sentence_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """T11 exploded: ``(doc_id, i, sentence)``."""
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.posexplode(split_sentences(text_col)).alias("i", "sentence"))


def sentence_words(sents: DataFrame) -> DataFrame:
    """``(doc_id, i, L, pos, w)``: ranker words with positions and the
    sentence length ``L``."""
    s = sents.select("doc_id", "i", rank_words("sentence").alias("_w"))
    return s.select("doc_id", "i", F.size("_w").alias("L"), F.posexplode("_w").alias("pos", "w"))


def sentence_lengths(sents: DataFrame) -> DataFrame:
    return sents.select("doc_id", "i", F.size(rank_words("sentence")).alias("L"))


def word_counts(words: DataFrame) -> DataFrame:
    """``(doc_id, i, L, w, c)``."""
    return words.groupBy("doc_id", "i", "L", "w").agg(F.count(F.lit(1)).alias("c"))


def _shared_word_counts(sents: DataFrame) -> DataFrame:
    """Word counts read by several branches of one plan: tokenised (regex)
    once and materialised, instead of once per branch."""
    return _checkpoint(word_counts(sentence_words(sents)))


def _doc_sizes(sents: DataFrame) -> DataFrame:
    return sents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("N"))


def _checkpoint(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    return cut_lineage(df, "rank", replaces)


def split_by_size(rows: DataFrame, *too_large: Column) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` of documents that a task may hold, and those of larger ones (or None)."""
    large = rows.groupBy("doc_id").agg(*(c.alias(f"_x{k}") for k, c in enumerate(too_large)))
    large = _checkpoint(large.where(" or ".join(f"_x{k}" for k in range(len(too_large)))).select("doc_id"))
    if large.isEmpty():
        return rows, None
    same = rows["doc_id"].eqNullSafe(large["doc_id"])
    return rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi")


#: Characters of the words that a task scores at once.
HELD_CHARS = 4 << 20


def _small_and_large(sents: DataFrame, small: tuple[int, int] | None) -> tuple[DataFrame, DataFrame | None]:
    """Sentences of documents that a task may hold, and those of larger ones (written, as many steps read them; or None).
    They are counted once for all rankers of one table."""
    n, chars = SMALL if small is None else small
    found = sents.__dict__.setdefault("_by_size", {})
    if (n, chars) not in found:
        rows, large = split_by_size(sents, F.count(F.lit(1)) > n, F.coalesce(F.sum(F.length("sentence")), F.lit(0)) > chars)
        found[n, chars] = rows, None if large is None else _checkpoint(large)
    return found[n, chars]


def _in_tasks(sents: DataFrame, kernel, converged: bool = True) -> DataFrame:
    """``(doc_id, i, score[, converged])`` by a kernel over the words of some documents at once.  Words are dealt out by
    document, in one and the same exchange for all rankers of one table."""
    def scored(t: pa.Table, new: np.ndarray, same: np.ndarray) -> list[pa.RecordBatch]:
        score, settled = kernel(rank_kernels.texts(t, new, same))
        null = np.zeros(len(t), bool) if settled is None else ~settled
        return pa.table({"doc_id": t.column("doc_id"), "i": t.column("i"), "score": pa.array(score, mask=null),
                         "converged": pa.array(~null)}).to_batches()

    types = {f.name: f.dataType.simpleString() for f in sents.schema.fields}
    out = _dealt_words(sents).applyInArrow(
        _whole_documents(scored), f"doc_id {types['doc_id']}, i {types['i']}, score double, converged boolean")
    return out if converged else out.drop("converged")


def _dealt_words(sents: DataFrame):
    """The words ``(b, doc_id, i, joined)`` grouped by ``b``, in order of document and ``i``."""
    spark = sents.sparkSession
    deals = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = sents.select(F.pmod(F.xxhash64("doc_id"), F.lit(deals)).cast("int").alias("b"), *K,
                        F.coalesce(F.array_join(rank_words("sentence"), " "), F.lit("")).alias("joined"))
    return rows.repartition("b").sortWithinPartitions("b", *K).groupBy("b")


def _whole_documents(made):
    """``made`` from rows in order of document and ``i`` (whether a row begins a document, and whether it has the key of the
    one before), some whole documents at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done(last: bool) -> Iterable[pa.RecordBatch]:
            nonlocal held, size
            t = pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
            new = ~same_as_before(t.column("doc_id").combine_chunks())
            same = ~new & same_as_before(t.column("i").combine_chunks())
            end = len(t)
            if not last:  # the last document may go on
                end = int(np.flatnonzero(new)[-1])
                held = t.slice(end).to_batches()
            return made(t.slice(0, end), new[:end], same[:end]) if end else []

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column("joined").nbytes
                if size > HELD_CHARS:
                    yield from done(False)
        if held:
            yield from done(True)

    return run


@contextmanager
def _by_document(spark):
    """Within this, rows dealt out by ``doc_id`` need no further exchange for
    joins and aggregates on ``doc_id`` and more columns, so a round runs in
    one stage.  A document's rows then stream through one task (sorted and
    spilled, never gathered); a document is one row of the input."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: A change this large, from scores that sum to 1, is growth without end.
_DIVERGED = 1e6


def _iterate(x0: DataFrame, step, tol: float, norm: str = "l2", scale_tol_by_n: bool = False,
             max_rounds: int | None = None) -> DataFrame:
    """Run ``step`` (``x(doc_id, i, x) -> new x``) per document until the
    change is within ``tol``; then that document is frozen.  ``x0`` carries
    ``N`` (sentences in the document).

    Returns ``(doc_id, i, score, converged)``.  A document whose change grows
    beyond all bounds, or that has not settled after ``max_rounds`` (only
    where the method itself sets a limit), has null scores.

    The change is summed per document with partial aggregation.  The state is
    written every round, as a round reads it several times: the plan stays one
    round deep, a lost executor recomputes at most one round, and the round
    before is deleted.
    """
    x = _checkpoint(x0.select("doc_id", "i", "N", "x", F.lit("live").alias("state")))
    with _by_document(x.sparkSession):
        x = _rounds(x, step, tol, norm, scale_tol_by_n, max_rounds)
    settled = F.col("state") == "done"
    return x.select("doc_id", "i", F.when(settled, F.col("x")).alias("score"), settled.alias("converged"))


def _rounds(x: DataFrame, step, tol: float, norm: str, scale_tol_by_n: bool, max_rounds: int | None) -> DataFrame:
    rounds = 0
    while (max_rounds is None or rounds < max_rounds) and not x.where("state = 'live'").isEmpty():
        rounds += 1
        live = x.where("state = 'live'").repartition("doc_id")
        nx = step(live.select("doc_id", "i", "N", "x")).select("doc_id", "i", F.col("x").alias("nx"))
        upd = live.join(nx, K, "left").withColumn("nx", F.coalesce("nx", F.lit(0.0)))
        d = F.col("nx") - F.col("x")
        size = F.sqrt(F.sum(d * d)) if norm == "l2" else F.sum(F.abs(d))
        err = upd.groupBy("doc_id").agg(size.alias("err"))
        small = (F.col("err") < F.lit(tol) * F.col("N")) if scale_tol_by_n else (F.col("err") <= F.lit(tol))
        lost = F.isnan("err") | (F.col("err") > _DIVERGED)
        upd = upd.join(err, "doc_id").select(
            "doc_id", "i", "N", F.col("nx").alias("x"),
            F.when(lost, "lost").when(small, "done").otherwise("live").alias("state"))
        x = _checkpoint(x.where("state <> 'live'").unionByName(upd), x)
    return x


def _iterate_edges(nodes: DataFrame, edges: DataFrame, alpha: float, tol: float, norm: str = "l2",
                   scale_tol_by_n: bool = False, max_rounds: int | None = None, rounds_per_write: int = 8) -> DataFrame:
    """As :func:`_iterate` for ``x'_j = alpha (sum_i x_i w_ij + D / N) + (1 - alpha) / N``
    over explicit edges ``(doc_id, i, j, w)`` and ``nodes (doc_id, i, N)``; ``D``
    is the sum over the nodes that ``nodes`` marks ``loose``, if it does.

    A round is one join and one aggregate: a node's own loop carries its
    scores so far along.  So a write holds several rounds, and the first round
    whose change is within ``tol`` is picked from each document's history.
    """
    loose = F.col("loose") if "loose" in nodes.columns else F.lit(False)
    hops = _checkpoint(edges.select("doc_id", "i", "j", "w", F.lit(False).alias("own"), F.lit(False).alias("loose")).unionByName(
        nodes.select("doc_id", "i", F.col("i").alias("j"), F.lit(0.0).alias("w"), F.lit(True).alias("own"), loose.alias("loose"))))
    x = _checkpoint(nodes.select("doc_id", "i", "N", (1.0 / F.col("N")).alias("x"), F.lit("live").alias("state")))
    with _by_document(x.sparkSession):
        x = _edge_rounds(x, hops, alpha, tol, norm, scale_tol_by_n, max_rounds, rounds_per_write)
    settled = F.col("state") == "done"
    return x.select("doc_id", "i", F.when(settled, F.col("x")).alias("score"), settled.alias("converged"))


def _edge_rounds(x: DataFrame, hops: DataFrame, alpha: float, tol: float, norm: str, scale_tol_by_n: bool,
                 max_rounds: int | None, rounds_per_write: int) -> DataFrame:
    hops, rounds = hops.repartition("doc_id"), 0
    while (max_rounds is None or rounds < max_rounds) and not x.where("state = 'live'").isEmpty():
        k = rounds_per_write if max_rounds is None else min(rounds_per_write, max_rounds - rounds)
        rounds += k
        h = x.where("state = 'live'").select("doc_id", "i", "N", F.array("x").alias("h")).repartition("doc_id")
        for r in range(k):
            flow = h.join(hops, K).groupBy("doc_id", F.col("j").alias("i"), "N").agg(
                F.sum(F.col("h")[r] * F.col("w")).alias("s"), F.first(F.when(F.col("own"), F.col("h")), True).alias("h"),
                F.max(F.col("own") & F.col("loose")).alias("loose"))
            mass = F.sum(F.when(F.col("loose"), F.col("h")[r]).otherwise(0.0)).over(Window.partitionBy("doc_id"))
            h = flow.select("doc_id", "i", "N", F.concat("h", F.array(
                alpha * (F.col("s") + mass / F.col("N")) + (1 - alpha) / F.col("N"))).alias("h"))
        h = _checkpoint(h)
        change = [F.col("h")[r] - F.col("h")[r - 1] for r in range(1, k + 1)]
        errs = h.groupBy("doc_id").agg(*[(F.sqrt(F.sum(d * d)) if norm == "l2" else F.sum(F.abs(d))).alias(f"e{r}")
                                         for r, d in enumerate(change, 1)])
        at = h.join(errs, "doc_id")
        small = [(F.col(f"e{r}") < F.lit(tol) * F.col("N")) if scale_tol_by_n else (F.col(f"e{r}") <= F.lit(tol))
                 for r in range(1, k + 1)]
        first = F.coalesce(*[F.when(c, F.lit(r)) for r, c in enumerate(small, 1)])
        lost = F.isnan(f"e{k}") | (F.col(f"e{k}") > _DIVERGED)
        upd = at.select("doc_id", "i", "N", F.col("h")[F.coalesce(first, F.lit(k))].alias("x"),
                        F.when(first.isNotNull(), "done").when(lost, "lost").otherwise("live").alias("state"))
        x = _checkpoint(x.where("state <> 'live'").unionByName(upd), x)
    return x


# ------------------------------------------------------------------ R5 Luhn

def luhn_scores(sents: DataFrame, max_gap: int = LUHN_MAX_GAP, small: tuple[int, int] | None = None) -> DataFrame:
    """Significant words (document frequency > 1), chunks of
    significant words at most ``max_gap`` positions apart (gaps and
    islands), score = max over chunks of sig^2 / span, 0 for a single
    significant word or none."""
    rows, large = _small_and_large(sents, small)
    out = _in_tasks(rows, rank_kernels.luhn(max_gap), converged=False)
    return out if large is None else out.unionByName(_luhn_of_words(large, max_gap))


def _luhn_of_words(sents: DataFrame, max_gap: int) -> DataFrame:
    words = sentence_words(sents)
    sig = words.groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("tf")).where(F.col("tf") > 1)
    sp = words.join(sig.select("doc_id", "w"), ["doc_id", "w"], "left_semi")
    w = Window.partitionBy("doc_id", "i").orderBy("pos")
    isl = sp.withColumn("gap", F.col("pos") - F.lag("pos").over(w)) \
        .withColumn("chunk", F.sum(F.when(F.col("gap") > max_gap, 1).otherwise(0)).over(w))
    ch = isl.groupBy("doc_id", "i", "chunk").agg(
        F.count(F.lit(1)).alias("n"), (F.max("pos") - F.min("pos") + 1).alias("span"))
    rating = F.when(F.col("n") > 1, F.col("n") * F.col("n") / F.col("span")).otherwise(F.lit(0.0))
    best = ch.groupBy("doc_id", "i").agg(F.max(rating).alias("score"))
    return sents.select(*K).join(best, K, "left").select(*K, F.coalesce("score", F.lit(0.0)).alias("score"))


# ------------------------------------------------------------------ R4 LSA

def lsa_scores(sents: DataFrame, smooth: float = LSA_SMOOTH, small: tuple[int, int] | None = None) -> DataFrame:
    """R4 without an SVD: keeping every singular value, the LSA rank of a
    sentence is the norm of its column in the smoothed term x sentence
    matrix, ``sqrt(s^2 (V - v_j) + sum_t (s + (1-s) c_tj / max_j)^2)``."""
    rows, large = _small_and_large(sents, small)
    out = _in_tasks(rows, rank_kernels.lsa(smooth), converged=False)
    return out if large is None else out.unionByName(_lsa_of_words(large, smooth))


def _lsa_of_words(sents: DataFrame, smooth: float) -> DataFrame:
    wc = word_counts(sentence_words(sents))
    vdoc = wc.groupBy("doc_id").agg(F.countDistinct("w").alias("n_doc_words"))
    per = wc.withColumn("mx", F.max("c").over(Window.partitionBy("doc_id", "i"))) \
        .groupBy("doc_id", "i").agg(
            F.count(F.lit(1)).alias("n_words"),
            F.sum(F.pow(F.lit(smooth) + (1 - smooth) * F.col("c") / F.col("mx"), 2)).alias("sq"))
    s = per.join(vdoc, "doc_id").select(
        *K, F.sqrt(F.lit(smooth * smooth) * (F.col("n_doc_words") - F.col("n_words")) + F.col("sq")).alias("score"))
    return sents.select(*K).join(s, K, "left").select(*K, F.coalesce("score", F.lit(0.0)).alias("score"))


# ------------------------------------------------------------------ R6 KL-Sum

def kl_scores(sents: DataFrame, n: int, small: tuple[int, int] | None = None) -> DataFrame:
    """Greedy KL-Sum, ``n`` rounds.

    A round scores every remaining sentence ``s`` by
    ``sum_{w in words(s) u words(summary)} p_doc(w) ln(p_doc(w) / p_joint(w))``
    and adds the lowest (earliest on ties).  The sum is split into the
    summary's own running totals plus a correction over the candidate's
    words only, so a round is one join of candidate words with the summary
    counts and one aggregate - never sentence pairs.  Chosen sentences score
    ``-round``; the rest ``-n``.
    """
    rows, large = _small_and_large(sents, small)
    out = _in_tasks(rows, rank_kernels.kl_sum(n), converged=False)
    return out if large is None else out.unionByName(_kl_rounds(large, n))


def _kl_rounds(sents: DataFrame, n: int) -> DataFrame:
    wc = _shared_word_counts(sents)
    tot = wc.groupBy("doc_id").agg(F.sum("c").alias("T"))
    pw = wc.groupBy("doc_id", "w").agg(F.sum("c").alias("tf")).join(tot, "doc_id") \
        .select("doc_id", "w", (F.col("tf") / F.col("T")).alias("p"))
    # Every round reads the candidate words and sentence lengths: materialise once.
    cw = _checkpoint(wc.join(pw, ["doc_id", "w"]).select(*K, "w", "c", "p"))
    lens = _checkpoint(sentence_lengths(sents))
    chosen = None
    for r in range(n):
        if chosen is None:
            remaining = lens
            summ = None
        else:
            summ = cw.join(chosen.select(*K), K, "left_semi").groupBy("doc_id", "w") \
                .agg(F.sum("c").alias("s"), F.first("p").alias("p"))
            remaining = lens.join(chosen.select(*K), K, "left_anti")
        cands = cw if chosen is None else cw.join(remaining.select(*K), K, "left_semi")
        if summ is None:
            j = cands.withColumn("s", F.lit(None).cast("long"))
            sagg = remaining.select("doc_id").distinct().select(
                "doc_id", *[F.lit(0.0).alias(c) for c in ("A", "B", "P")], F.lit(0).cast("long").alias("SL"))
        else:
            sagg = summ.groupBy("doc_id").agg(
                F.sum(F.col("p") * F.log("p")).alias("A"), F.sum(F.col("p") * F.log("s")).alias("B"),
                F.sum("p").alias("P"), F.sum("s").alias("SL"))
            j = cands.join(summ.select("doc_id", "w", "s"), ["doc_id", "w"], "left")
        ins = F.col("s").isNotNull()
        cand = j.groupBy(*K).agg(
            F.sum(F.when(~ins, F.col("p") * F.log("p")).otherwise(0.0)).alias("x1"),
            F.sum(F.when(ins, F.col("p") * (F.log(F.col("c") + F.col("s")) - F.log("s"))).otherwise(0.0)).alias("x2"),
            F.sum(F.when(~ins, F.col("p") * F.log("c")).otherwise(0.0)).alias("x3"),
            F.sum(F.when(~ins, F.col("p")).otherwise(0.0)).alias("x4"))
        sc = remaining.join(cand, K, "left").join(sagg, "doc_id", "left").fillna(
            0.0, ["x1", "x2", "x3", "x4", "A", "B", "P"]).fillna(0, ["SL"])
        mass = F.col("P") + F.col("x4")
        kl = (F.col("A") + F.col("x1")) - (F.col("B") + F.col("x2") + F.col("x3")) + \
            F.when(mass > 0, F.log(F.col("L") + F.col("SL")) * mass).otherwise(F.lit(0.0))
        pick = sc.groupBy("doc_id").agg(F.min_by("i", F.struct(F.round(kl, 9), F.col("i"))).alias("i")) \
            .withColumn("r", F.lit(r))
        chosen = pick if chosen is None else chosen.unionByName(pick)
        if r < n - 1:
            chosen = _checkpoint(chosen)
    out = sents.select(*K).join(chosen, K, "left")
    return out.select(*K, F.coalesce(-F.col("r"), F.lit(-n)).cast("double").alias("score"))


# ------------------------------------------------------------------ R2 TextRank

def _g(la: Column, lb: Column) -> Column:
    """1 / (ln La + ln Lb); when both sentences have one word, 1."""
    return F.when((la == 1) & (lb == 1), F.lit(1.0)).otherwise(1.0 / (F.log(la) + F.log(lb)))


def textrank_scores(sents: DataFrame, damping: float = TEXTRANK_DAMPING, tol: float = TEXTRANK_EPSILON,
                    small: tuple[int, int] | None = None) -> DataFrame:
    """R2: overlap TextRank with the pair weights factored by sentence length.

    With ``C(w, L) = sum over sentences j of length L of c_j(w)``:
    ``rowsum_i = sum_w c_i(w) sum_L g(L_i, L) C(w, L)`` and one round is
    ``x'_j = ((1-d) sum_i x_i + d D) / N + d sum_w c_j(w) sum_L g(L_j, L) Y(w, L)``
    with ``Y(w, L) = sum over sentences i of length L of c_i(w) x_i / (rowsum_i + eps)``.
    A sentence without words has no edges; its mass ``D`` is spread evenly, so
    that none is lost and the iteration settles.
    """
    rows, large = _small_and_large(sents, small)
    out = _in_tasks(rows, rank_kernels.textrank(damping, tol, ROW_NORM_EPS))
    return out if large is None else out.unionByName(_textrank_rounds(large, damping, tol))


def _textrank_rounds(sents: DataFrame, damping: float, tol: float) -> DataFrame:
    wc = _shared_word_counts(sents)
    cwl = wc.groupBy("doc_id", "w", F.col("L").alias("Lb")).agg(F.sum("c").alias("csum"))
    rs = wc.join(cwl, ["doc_id", "w"]).groupBy(*K).agg(
        F.sum(F.col("c") * _g(F.col("L"), F.col("Lb")) * F.col("csum")).alias("rs"))
    nodes = sents.select(*K).join(_doc_sizes(sents), "doc_id").join(rs, K, "left") \
        .withColumn("rs", F.coalesce("rs", F.lit(0.0)))
    nodes = _checkpoint(nodes)
    x0 = nodes.select(*K, "N", (1.0 / F.col("N")).alias("x"))
    wc, nodes = wc.repartition("doc_id"), nodes.repartition("doc_id")

    def step(x: DataFrame) -> DataFrame:
        xr = x.join(nodes.select(*K, "rs"), K)
        sums = xr.groupBy("doc_id").agg(F.sum("x").alias("mass"), F.sum(F.when(F.col("rs") == 0, F.col("x")).otherwise(0.0)).alias("loose"))
        y = xr.where("rs <> 0").select(*K, (F.col("x") / (F.col("rs") + ROW_NORM_EPS)).alias("y"))
        yw = wc.join(y, K).groupBy("doc_id", "w", F.col("L").alias("Lb")).agg(F.sum(F.col("c") * F.col("y")).alias("ysum"))
        u = wc.join(yw, ["doc_id", "w"]).groupBy(*K).agg(
            F.sum(F.col("c") * _g(F.col("L"), F.col("Lb")) * F.col("ysum")).alias("u"))
        return x.join(sums, "doc_id").join(u, K, "left").select(
            *K, (((1 - damping) * F.col("mass") + damping * F.col("loose")) / F.col("N")
                 + damping * F.coalesce("u", F.lit(0.0))).alias("x"))

    return _iterate(x0, step, tol)


# ------------------------------------------------------------------ R3 LexRank

def lexrank_edges(sents: DataFrame, threshold: float = LEXRANK_THRESHOLD, small: tuple[int, int] | None = None) -> DataFrame:
    """Binary LexRank edges ``(doc_id, i, j)`` (both directions, self loops).

    A document of bounded size makes its edges where its words are: one exchange of
    texts, no row for each word or pair; larger ones go through joins."""
    rows, large = _small_and_large(sents, SMALL_EDGES if small is None else small)
    kernel = rank_kernels.lexrank_edges(threshold)

    def made(t: pa.Table, new: np.ndarray, same: np.ndarray) -> Iterator[pa.RecordBatch]:
        doc, i = (t.column(c).combine_chunks() for c in K)
        for a, b in kernel(rank_kernels.texts(t, new, same)):
            yield from pa.table({"doc_id": doc.take(pa.array(a)), "i": i.take(pa.array(a)), "j": i.take(pa.array(b))}).to_batches()

    types = {f.name: f.dataType.simpleString() for f in sents.schema.fields}
    out = _dealt_words(rows).applyInArrow(_whole_documents(made), f"doc_id {types['doc_id']}, i {types['i']}, j {types['i']}")
    return out if large is None else out.unionByName(_edges_of_words(large, threshold))


def _edges_of_words(sents: DataFrame, threshold: float) -> DataFrame:
    """:func:`lexrank_edges` by joins of words.

    tf = count / max count in the sentence, idf = ln(N / (1 + n_w)); pair
    similarity is the idf-weighted cosine, and an edge needs it above
    ``threshold``.  Candidates come from exact prefix filtering: with the
    sentence vector normalised and its words ordered rarest first, the
    prefix is the shortest run whose remaining (suffix) norm is below the
    threshold.  The rarest word that a pair above the threshold shares lies in
    both prefixes (else all shared words lie in one suffix, which adds less
    than the threshold), so prefixes are joined with prefixes, each pair once.
    What the other words add is summed for these candidates only, and edges
    are mirrored at the end.
    """
    wc = _shared_word_counts(sents)
    n = _doc_sizes(sents)
    df_ = wc.groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("nw")).join(n, "doc_id") \
        .select("doc_id", "w", "nw", F.log(F.col("N") / (1 + F.col("nw"))).alias("idf"))
    tf = wc.withColumn("mx", F.max("c").over(Window.partitionBy(*K))) \
        .join(df_, ["doc_id", "w"]).select(*K, "w", "nw", (F.col("c") / F.col("mx") * F.col("idf")).alias("a"))
    # Five branches read the word weights: materialise them once.
    tf = _checkpoint(tf)
    norm = tf.groupBy(*K).agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("nrm"))
    nz = tf.where(F.col("a") != 0)
    unit = nz.join(norm, K).select(*K, "w", "nw", "a", (F.col("a") / F.col("nrm")).alias("u"))
    # Suffix mass from each word to the end, rarest words first; a small
    # margin keeps the prefix a superset under rounding.
    order = Window.partitionBy(*K).orderBy(F.desc("nw"), F.desc("w")).rowsBetween(Window.unboundedPreceding, 0)
    marked = unit.withColumn("pre", F.sum(F.col("u") * F.col("u")).over(order) >= threshold * threshold * (1 - 1e-9))
    marked = _checkpoint(marked.select("doc_id", "i", "w", "a", "pre"))
    at_j = [F.col("doc_id"), F.col("i").alias("j"), F.col("w"), F.col("a").alias("aj")]
    pre, suf = marked.where("pre"), marked.where("not pre")
    weight = (F.col("a") * F.col("aj")).alias("dot")
    part = _checkpoint(pre.select("doc_id", "i", "w", "a").join(pre.select(*at_j), ["doc_id", "w"]).where("i < j")
                       .groupBy("doc_id", "i", "j").agg(F.sum(weight).alias("dot")))
    pairs = part.select("doc_id", "i", "j")
    rest_i = pairs.join(suf.select("doc_id", "i", "w", "a"), ["doc_id", "i"]) \
        .join(marked.select(*at_j), ["doc_id", "j", "w"]).select("doc_id", "i", "j", weight)
    rest_j = pairs.join(suf.select(*at_j), ["doc_id", "j"]) \
        .join(pre.select("doc_id", "i", "w", "a"), ["doc_id", "i", "w"]).select("doc_id", "i", "j", weight)
    dots = part.unionByName(rest_i).unionByName(rest_j).groupBy("doc_id", "i", "j").agg(F.sum("dot").alias("dot"))
    ni = norm.select("doc_id", "i", F.col("nrm").alias("ni"))
    nj = norm.select("doc_id", F.col("i").alias("j"), F.col("nrm").alias("nj"))
    sim = dots.join(ni, ["doc_id", "i"]).join(nj, ["doc_id", "j"]) \
        .where((F.col("ni") > 0) & (F.col("nj") > 0)) \
        .where(F.col("dot") / (F.col("ni") * F.col("nj")) > threshold).select("doc_id", "i", "j")
    selfs = norm.where(F.col("nrm") > 0).select("doc_id", "i", F.col("i").alias("j"))
    return sim.unionByName(sim.select("doc_id", F.col("j").alias("i"), F.col("i").alias("j"))).unionByName(selfs)


def lexrank_scores(sents: DataFrame, threshold: float = LEXRANK_THRESHOLD, tol: float = LEXRANK_EPSILON,
                   small: tuple[int, int] | None = None) -> DataFrame:
    """Power iteration (no damping) over the degree-normalised edges."""
    rows, large = _small_and_large(sents, small)
    out = _in_tasks(rows, rank_kernels.lexrank(threshold, tol))
    return out if large is None else out.unionByName(_lexrank_rounds(large, threshold, tol))


def _lexrank_rounds(sents: DataFrame, threshold: float, tol: float) -> DataFrame:
    edges = _checkpoint(_edges_of_words(sents, threshold))
    deg = edges.groupBy("doc_id", "i").agg(F.count(F.lit(1)).alias("deg"))
    weighted = edges.join(deg, K).select("doc_id", "i", "j", (1.0 / F.col("deg")).alias("w"))
    nodes = sents.select(*K).join(_doc_sizes(sents), "doc_id")
    return _iterate_edges(nodes, weighted, 1.0, tol, rounds_per_write=2)


# ------------------------------------------------------------------ E1 + R1

def sentence_vectors(sents: DataFrame, vectors: DataFrame | VectorTable, dim: int, chars: int | None = None) -> DataFrame:
    """E1 per sentence: ``sum(vec(w)) / (n_words + 0.001)`` over whitespace
    words, unknown words count in the divisor with a zero vector; no words
    gives the zero vector.  ``vectors`` is ``(word, vector array<float>)`` or
    a :class:`VectorTable`; sentences stay where their block's vectors are
    (``text_vectors``).
    """
    types = {f.name: f.dataType.simpleString() for f in sents.schema.fields}
    return over_vectors(sents, vectors, dim, lambda t: t.select([*K, "vec"]), f"doc_id {types['doc_id']}, i {types['i']}, vec array<double>",
                        whole=False, chars=chars)


def _by_text_size(sents: DataFrame, limit: int | None) -> tuple[DataFrame, DataFrame | None]:
    return split_by_size(sents, F.count(F.lit(1)) > (SMALL_VECTORS if limit is None else limit))


def embedding_textrank(sents: DataFrame, vectors: DataFrame | VectorTable, dim: int, alpha: float = PAGERANK_ALPHA,
                       tol: float = PAGERANK_TOL, max_rounds: int = PAGERANK_MAX_ITER, chars: int | None = None,
                       small: int | None = None) -> DataFrame:
    """R1 of sentences ``(doc_id, i, sentence)``: :func:`embedding_textrank_scores`
    of their E1 vectors.  A document's rounds run where its vectors are made,
    which no shuffle carries; those of larger documents go through its rounds."""
    types = {f.name: f.dataType.simpleString() for f in sents.schema.fields}
    rows, large = _by_text_size(sents, small)
    out = over_vectors(rows, vectors, dim, per_document(_cosine_rank(alpha, tol, max_rounds, DANGLING_EPS)),
                       f"doc_id {types['doc_id']}, i {types['i']}, score double, converged boolean", chars=chars)
    if large is None:
        return out
    return out.unionByName(embedding_textrank_scores(sentence_vectors(large, vectors, dim), alpha, tol, max_rounds, large, small))


def _next_cosine(t: pa.Table) -> pa.Table:
    """The cosine of each sentence and the next (rows with one key meet all rows of the next)."""
    doc, i = t.column("doc_id").combine_chunks(), t.column("i").to_numpy()
    at = np.cumsum(t.column("new").to_numpy())
    key = np.stack([at, i], axis=1).astype(np.int64)
    run = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
    size = np.diff(np.append(run, len(key)))
    k = np.flatnonzero((key[run[1:], 0] == key[run[:-1], 0]) & (key[run[1:], 1] == key[run[:-1], 1] + 1))
    k = k[doc.is_valid().to_numpy(zero_copy_only=False)[run[k]]]  # a null key meets none
    times = size[k] * size[k + 1]
    pair = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    a = np.repeat(run[k], times) + pair // np.repeat(size[k + 1], times)
    b = np.repeat(run[k + 1], times) + pair % np.repeat(size[k + 1], times)
    v = t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(key), -1)
    norm = np.linalg.norm(v, axis=1)
    scale = norm[a] * norm[b]
    dot = (v[a] * v[b]).sum(axis=1)
    cos = np.where(scale > 0, dot / np.where(scale > 0, scale, 1.0), 0.0)
    return pa.table({"doc_id": doc.take(pa.array(a)), "i": t.column("i").combine_chunks().take(pa.array(a)), "cosine": pa.array(cos)})


def adjacent_cosine(sents: DataFrame, vectors: DataFrame | VectorTable, dim: int, chars: int | None = None,
                    small: int | None = None) -> DataFrame:
    """E2 for each sentence and the next: ``(doc_id, i, cosine)``, 0 for a zero
    vector; made where the vectors are, those of larger documents by a join."""
    types = {f.name: f.dataType.simpleString() for f in sents.schema.fields}
    rows, large = _by_text_size(sents, small)
    out = over_vectors(rows, vectors, dim, _next_cosine, f"doc_id {types['doc_id']}, i {types['i']}, cosine double", chars=chars)
    if large is None:
        return out
    v = _checkpoint(sentence_vectors(large, vectors, dim))
    nxt = v.select("doc_id", (F.col("i") - 1).alias("i"), F.col("vec").alias("nv"))
    return out.unionByName(v.join(nxt, K).select("doc_id", "i", cosine("vec", "nv").alias("cosine")))


def _cosine_rank(alpha: float, tol: float, max_rounds: int, dangling: float):
    """One document's rounds of :func:`embedding_textrank_scores`."""
    def run(table: pa.Table) -> pa.Table:
        v = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        n, size = len(v), np.linalg.norm(v, axis=1)
        u = np.divide(v, size[:, None], out=np.zeros_like(v), where=size[:, None] > 0)
        uu = (u * u).sum(axis=1)
        s = u @ u.sum(axis=0) - uu
        loose = np.abs(s) <= dangling
        inv = np.where(loose, 0.0, 1.0 / np.where(loose, 1.0, s))
        x, settled = np.full(n, 1.0 / n), False
        for _ in range(max_rounds):
            y = x * inv
            nxt = alpha * (u @ (y @ u) - y * uu + x[loose].sum() / n) + (1 - alpha) / n
            change, x = np.abs(nxt - x).sum(), nxt
            if not change < _DIVERGED:
                break
            if change < n * tol:
                settled = True
                break
        return pa.table({"doc_id": table.column("doc_id"), "i": table.column("i"),
                         "score": pa.array(x if settled else [None] * n, pa.float64()), "converged": pa.array([settled] * n)})

    return run


def embedding_textrank_scores(vecs: DataFrame, alpha: float = PAGERANK_ALPHA, tol: float = PAGERANK_TOL,
                              max_rounds: int = PAGERANK_MAX_ITER, sents: DataFrame | None = None,
                              small: int | None = None) -> DataFrame:
    """R1 + R7: PageRank over the complete cosine graph (zero diagonal).

    With unit vectors ``u_i`` (zero for a zero vector) the weight is
    ``u_i . u_j``, the row sum ``s_i = u_i . T - |u_i|^2`` with ``T`` the
    document's vector sum, and one round is
    ``x'_j = a (u_j . Y - y_j |u_j|^2 + D / N) + (1 - a) / N`` with
    ``y_i = x_i / s_i`` (0 for dangling rows), ``Y = sum y_i u_i`` and ``D``
    the dangling mass.  A round is two products of a matrix of sentences x
    dimensions with a vector, so a document's rounds run where its vectors
    are (``applyInArrow``: one shuffle by document, whatever the number of
    rounds); the N x N matrix is never formed.  A task holds the vectors of
    one document at a time.

    Iteration stops once the L1 change is below ``N * tol``.  With negative
    cosines row sums can be near zero and the iteration grow without end;
    as in the library, a document that has not settled after ``max_rounds``
    has no scores (``converged`` false, null).
    """
    large = (vecs if sents is None else sents).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_x")) \
        .where(F.col("_x") > (SMALL_VECTORS if small is None else small)).select("doc_id")
    large = _checkpoint(large)
    if large.isEmpty():
        return _cosine_in_tasks(vecs, alpha, tol, max_rounds)
    same = vecs["doc_id"].eqNullSafe(large["doc_id"])
    rounds = embedding_rounds(_checkpoint(vecs.join(large, same, "left_semi")), alpha, tol, max_rounds, DANGLING_EPS, _DIVERGED)
    return _cosine_in_tasks(vecs.join(large, same, "left_anti"), alpha, tol, max_rounds).unionByName(rounds)


def _cosine_in_tasks(vecs: DataFrame, alpha: float, tol: float, max_rounds: int) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in vecs.schema.fields}
    return vecs.select("doc_id", "i", F.col("vec").cast("array<double>").alias("vec")).groupBy("doc_id").applyInArrow(
        _cosine_rank(alpha, tol, max_rounds, DANGLING_EPS),
        f"doc_id {types['doc_id']}, i {types['i']}, score double, converged boolean")


def embedding_textrank_order(scores: DataFrame, sents: DataFrame, n: int) -> DataFrame:
    """R1 output: chosen sentences joined by ``". "`` in score order."""
    top = _top(scores, n).join(sents, K)
    return top.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct(F.col("rn"), F.col("sentence")))), lambda x: x["sentence"]), ". ").alias("summary"))


# ------------------------------------------------------------------ R7 generic

def pagerank(edges: DataFrame, nodes: DataFrame, alpha: float = PAGERANK_ALPHA, tol: float = PAGERANK_TOL,
             max_rounds: int = PAGERANK_MAX_ITER, small: int | None = None) -> DataFrame:
    """R7 over an explicit weighted edge table ``(doc_id, i, j, w)`` (directed;
    give both directions for an undirected graph) and ``nodes (doc_id, i)``:
    rows normalised by their weight sum, dangling mass spread evenly,
    stop when the L1 change is below ``N * tol``.  ``max_rounds`` is the
    library's own limit; beyond it a document has no scores.  Edges join nodes
    that ``nodes`` names."""
    rows = edges.select("doc_id", "i", "j", F.col("w").cast("double").alias("w")).unionByName(
        nodes.select(*K, F.lit(None).cast(edges.schema["j"].dataType).alias("j"), F.lit(None).cast("double").alias("w")))
    rows, large = split_by_size(rows, F.count(F.lit(1)) > (SMALL_GRAPH if small is None else small))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = rows.groupBy("doc_id").applyInArrow(rank_kernels.pagerank(alpha, tol, max_rounds),
                                              f"doc_id {types['doc_id']}, i {types['i']}, score double, converged boolean")
    if large is None:
        return out
    return out.unionByName(_pagerank_rounds(large.where("j is not null"), large.where("j is null"), alpha, tol, max_rounds))


def _pagerank_rounds(edges: DataFrame, nodes: DataFrame, alpha: float, tol: float, max_rounds: int) -> DataFrame:
    ws = edges.groupBy(*K).agg(F.sum("w").alias("ws"))
    nd = nodes.select(*K).join(_doc_sizes(nodes), "doc_id").join(ws, K, "left")
    nd = _checkpoint(nd.withColumn("ws", F.coalesce("ws", F.lit(0.0))))
    share = edges.join(ws, K).where("ws <> 0").select("doc_id", "i", "j", (F.col("w") / F.col("ws")).alias("w"))
    nodes = nd.select(*K, "N", (F.col("ws") == 0).alias("loose"))
    return _iterate_edges(nodes, share, alpha, tol, "l1", True, max_rounds)


# ------------------------------------------------------------------ F11, R8, R10

def _top(scores: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.round("score", 9)), F.asc("i"))
    return scores.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def assemble(scores: DataFrame, sents: DataFrame, n: int, sep: str = " ") -> DataFrame:
    """F11 + R8: best ``n`` sentences (ties to the earlier one) in document
    order, joined by ``sep``."""
    top = _top(scores, n).join(sents, K)
    return top.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct(F.col("i"), F.col("sentence")))), lambda x: x["sentence"]), sep).alias("summary"))


def summary_size(col) -> Column:
    """``ceil(avg(sentences per reference summary))`` as an aggregate
    expression (use in ``agg``)."""
    return F.ceil(F.avg(F.size(split_sentences(col))))


#: Rankers by name: ``(sentences, n, vectors) -> (doc_id, i, score)``.
RANKERS = {
    "TextRank": lambda s, n, vectors: textrank_scores(s),
    "LexRank": lambda s, n, vectors: lexrank_scores(s),
    "Lsa": lambda s, n, vectors: lsa_scores(s),
    "Luhn": lambda s, n, vectors: luhn_scores(s),
    "KL": lambda s, n, vectors: kl_scores(s, n),
    "MyTextRank": lambda s, n, vectors: embedding_textrank(s, *vectors),
}
#: Separator of rankers whose summaries are in score order, not in that of the document.
SCORE_ORDER = {"MyTextRank": ". "}


def register_ranker(name: str, scores):
    """Add a ranker, ``(sentences, n, vectors) -> (doc_id, i, score)``
    with ``vectors`` as ``(word-vector table, dimension)`` or None.  Returns a
    function that takes it out again (what it replaced comes back)."""
    before = RANKERS.get(name)
    RANKERS[name] = scores

    def undo() -> None:
        if before is None:
            RANKERS.pop(name, None)
        else:
            RANKERS[name] = before

    return undo


def summarise_models(sents: DataFrame, models, n, most: int | None = None,
                     vectors: tuple[DataFrame, int] | None = None) -> DataFrame:
    """``(model, doc_id, summary)`` by all named rankers in one plan: their
    scores are one table, with one top-n per model and document and one join
    back to the sentences.

    ``n`` is a number, or a Column over ``doc_id`` with ``most`` its largest
    value.  Sentences are in document order, joined by a space, except for the
    rankers in ``SCORE_ORDER``.
    """
    most = n if most is None else most
    scored = None
    for m in models:
        part = RANKERS[m](sents, most, vectors).select(F.lit(m).alias("model"), *K, "score")
        scored = part if scored is None else scored.unionByName(part)
    best = Window.partitionBy("model", "doc_id").orderBy(F.desc(F.round("score", 9)), F.asc("i"))
    top = scored.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= most)
    top = top.where(F.col("rn") <= (n if isinstance(n, Column) else F.lit(n))).join(sents, K)
    own = F.col("model").isin(*SCORE_ORDER)
    sep = F.lit(" ")
    for m, mark in SCORE_ORDER.items():
        sep = F.when(F.col("model") == m, F.lit(mark)).otherwise(sep)
    lines = F.array_sort(F.collect_list(F.struct(F.when(own, F.col("rn")).otherwise(F.col("i")).alias("at"), "sentence")))
    return top.groupBy("model", "doc_id").agg(lines.alias("lines")).select(
        "model", "doc_id", F.array_join(F.transform("lines", lambda x: x["sentence"]), "\u0001").alias("summary"), sep.alias("sep")) \
        .select("model", "doc_id", F.replace("summary", F.lit("\u0001"), F.col("sep")).alias("summary"))


def summarise(sents: DataFrame, model: str, n: int, vectors: tuple[DataFrame, int] | None = None) -> DataFrame:
    """``(doc_id, summary)`` by a named ranker: sentences in document order
    joined by a space; the embedding ranker keeps score order and joins by
    ``". "``."""
    return summarise_models(sents, [model], n, vectors=vectors).select("doc_id", "summary")
