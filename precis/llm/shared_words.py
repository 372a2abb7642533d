"""Words of passages that several documents share, for passages of a number of
words and not of bytes.

Every window of ``WORDS`` words is named by the least hash of its runs of 26 words
(its anchor), which depends on the window alone.  The windows of one anchor
make a run; runs of one anchor hash with equal words are a class.  A class of
two documents is shared as a whole.  Where an anchor has several classes, the
windows of one run of each are compared, aligned at the anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.llm.common import bit_filter, discard, in_filter, materialise, mix64, powers, text_rows, window_min
from precis.llm.words import grams, words_of

#: Words of a window: passages of over 50 words.
WORDS = 51
_GRAM = 26
_SPAN = WORDS - _GRAM  # an anchor lies 0 to _SPAN words behind its window's start
_BATCH = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_KEPT = 1 << 18  # powers made once; a longer text makes its own
_LOW = np.uint64((1 << 21) - 1)  # low bits that hold a place in a batch of ordinary texts


_POWERS = tuple((powers(base, _KEPT), powers(pow(base, -1, 1 << 64), _KEPT)) for base in _BASES)


def _sums(hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each base running sums of a polynomial over the words, and what takes a place out of it."""
    out = []
    n = len(hashes)
    for base, (there, back) in zip(_BASES, _POWERS):
        if n > _KEPT:
            there, back = powers(base, n), powers(pow(base, -1, 1 << 64), n)
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * there[:n], out=s[1:])
        out.append((s, back))
    return out


def _runs(hashes: np.ndarray, first: np.ndarray, whole: bool = True) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor - start, anchor hash) of runs in texts' words, and
    if asked for two hashes of the run's words."""
    if len(hashes) < WORDS:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    g = grams(hashes, _GRAM)
    place = np.arange(len(g), dtype=np.uint64)
    # equal hashes: the last place counts, whatever the window's place is
    mask = _LOW if len(g) <= int(_LOW) else np.uint64((1 << 40) - 1)
    anchor = (mask - (window_min((g & ~mask) | (mask - place), _SPAN + 1) & mask)).astype(np.int64)
    owner = np.searchsorted(first, np.arange(len(hashes)), "right")
    starts = np.flatnonzero(owner[:len(anchor)] == owner[WORDS - 1:WORDS - 1 + len(anchor)])
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    anchor, owner = anchor[starts], owner[starts]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    at = np.flatnonzero(new)
    count = np.diff(np.concatenate([at, [len(starts)]]))
    s, a = starts[at], anchor[at]
    if not whole:
        return (s, count, a - s, g[a])
    e = s + count - 1 + WORDS
    shape = ((e - s) << 12 | (a - s)).astype(np.uint64)
    hashed = [mix64((p[e] - p[s]) * inv[s] + shape) for p, inv in _sums(hashes)]
    return (s, count, a - s, g[a], *hashed)


def _anchors(keyed: DataFrame) -> DataFrame:
    """(fp): the anchor hash of each run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_rows(batches, "text", _BATCH):
            w = words_of(texts)
            fp = _runs(w.hashes, w.first, whole=False)[3]
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64))], names=["fp"])

    return keyed.select("text").mapInArrow(run, "fp bigint")


def _listed(keyed: DataFrame, bits: np.ndarray) -> DataFrame:
    """(kd, kt, fp, g1, g2, pos, w, rel) of the runs whose anchor the filter may hold."""
    shared = keyed.sparkSession.sparkContext.broadcast(bits)  # 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_rows(batches, "text", _BATCH):
            w = words_of(texts)
            runs = _runs(w.hashes, w.first)
            ok = np.flatnonzero(in_filter(shared.value, runs[3].view(np.uint64))) if len(runs[0]) else runs[0]
            if not len(ok):
                continue
            s, count, rel, fp, g1, g2 = (x[ok] for x in runs)
            owner = np.searchsorted(w.first, s, "right") - 1
            kd, kt = (batch.column(c).to_numpy()[owner] for c in ("kd", "kt"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(kd), pa.array(kt), *(pa.array(x.view(np.int64)) for x in (fp, g1, g2)),
                 *(pa.array(x.astype(np.int32)) for x in (s - w.first[owner], count, rel))],
                names=["kd", "kt", "fp", "g1", "g2", "pos", "w", "rel"])

    return keyed.select("kd", "kt", "text").mapInArrow(
        run, "kd bigint, kt bigint, fp bigint, g1 bigint, g2 bigint, pos int, w int, rel int")


def _windows(keyed: DataFrame, docs: np.ndarray, bits: np.ndarray) -> DataFrame:
    """(g1, g2, off, h1, h2, doc) of the windows of the runs that the filter
    may hold, by document and class; ``off``: from the anchor to the window's start.
    Texts that the filter ``docs`` does not hold are not read."""
    shared = keyed.sparkSession.sparkContext.broadcast(bits)  # 2 MB
    held = keyed.sparkSession.sparkContext.broadcast(docs)  # 2 MB

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kd, kt = (batch.column(c).to_numpy().view(np.uint64) for c in ("kd", "kt"))
            yield batch.filter(pa.array(in_filter(held.value, kd ^ kt)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_rows(having(batches), "text", _BATCH):
            w = words_of(texts)
            runs = _runs(w.hashes, w.first)
            if not len(runs[0]):
                continue
            owner = np.searchsorted(w.first, runs[0], "right") - 1
            kd, kt = (batch.column(c).to_numpy()[owner].view(np.uint64) for c in ("kd", "kt"))
            ok = np.flatnonzero(in_filter(shared.value, kd ^ kt ^ runs[4].view(np.uint64)))
            if not len(ok):
                continue
            s, count, rel, _, g1, g2 = (x[ok] for x in runs)
            doc = (kd ^ kt)[ok]
            k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(s, count) + k
            wh = [mix64((p[at + WORDS] - p[at]) * inv[at]) for p, inv in _sums(w.hashes)]
            rep = lambda x: pa.array(np.repeat(x, count).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [rep(g1), rep(g2), pa.array((k - np.repeat(rel, count)).astype(np.int32)),
                 *(pa.array(x.view(np.int64)) for x in wh), rep(doc)], names=["g1", "g2", "off", "h1", "h2", "doc"])

    return keyed.select("kd", "kt", "text").mapInArrow(run, "g1 bigint, g2 bigint, off int, h1 bigint, h2 bigint, doc bigint")


def shared_words(keyed: DataFrame) -> DataFrame:
    """(kd, kt, n_shared_words): of documents that have some, the words inside
    windows of 51 words that another document holds too.

    ``keyed`` has (kd, kt, text): a key of two hashes, by which documents are
    told apart (rows with equal keys are one document), and the bytes.  Words
    are runs of digits, letters and characters beyond ASCII, A-Z lower-cased;
    they are compared by hashes.
    """
    again = materialise(_anchors(keyed).groupBy("fp").agg(F.count("*").alias("m")).where("m > 1").select("fp"), "words-again")
    # written first, so that the joins' sides are plain exchanges and a common passage can be split
    met = materialise(_listed(keyed, bit_filter(again, "fp")).join(again, "fp"), "words-met")
    discard(again)
    doc = F.col("kd").bitwiseXOR(F.col("kt"))
    classes = materialise(met.groupBy("fp", "g1", "g2").agg(F.min(doc).alias("lo"), F.max(doc).alias("hi")), "word-classes")
    several = classes.groupBy("fp").agg(F.count("*").alias("m"), F.min("lo").alias("a"), F.max("hi").alias("b")).where("m > 1 and a <> b")
    mixed = classes.join(several.select("fp"), "fp")
    # the windows of each class from two of its documents, if it has two: equal windows have equal hashes, whatever their class
    wanted = materialise(mixed.select(F.explode(F.array("lo", "hi")).alias("doc"), "g1")
                         .select("doc", F.col("doc").bitwiseXOR(F.col("g1")).alias("run")), "word-runs")
    windows = materialise(_windows(keyed, bit_filter(wanted, "doc"), bit_filter(wanted, "run")), "word-windows")
    both = windows.groupBy("h1", "h2").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("h1", "h2")
    both = materialise(both, "windows-met")
    parts = windows.join(both, ["h1", "h2"]).groupBy("g1", "g2").agg(F.collect_set("off").alias("offs"))
    # what is shared of a class, all (no list) or windows by their place: one join with the runs does for both
    whole = classes.where("lo <> hi").select("g1", "g2", F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("offs"))
    marks = materialise(whole.unionByName(parts.withColumn("whole", F.lit(False))).groupBy("g1", "g2").agg(
        F.max("whole").alias("whole"), F.first("offs", ignorenulls=True).alias("offs")), "word-marks")
    discard(classes, wanted, windows, both)
    at = F.col("pos") + F.col("rel") + F.col("off")
    spans = met.join(marks, ["g1", "g2"]).select(
        "kd", "kt", "pos", "w", "rel", "whole", F.explode(F.when(F.col("whole"), F.array(F.lit(0))).otherwise(F.col("offs"))).alias("off")).select(
        "kd", "kt", F.when(F.col("whole"), F.col("pos")).otherwise(at).alias("s"),
        F.when(F.col("whole"), F.col("pos") + F.col("w") - 1).otherwise(at).alias("last")).select("kd", "kt", "s", (F.col("last") + WORDS).alias("e"))
    found = spans.groupBy("kd", "kt").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("spans", zero, lambda a, x: F.struct(
        F.greatest(a["end"], x["e"]).alias("end"), (a["n"] + x["e"] - F.least(x["e"], F.greatest(a["end"], x["s"]))).alias("n")), lambda a: a["n"])
    out = materialise(found.select("kd", "kt", covered.alias("n_shared_words")), "shared-words")
    discard(met, marks)
    return out
