"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.llm.common import bit_filter, broadcast_if_small, in_filter, materialise, positional, text_rows, window_min
from precis.llm.words import Words, grams, within, words_of

#: Words in a window, and in a fingerprinted k-gram.  The least fingerprint of
#: the WINDOW - GRAM + 1 k-grams of a window stands for it, so that every shared
#: span of WINDOW words is found.
WINDOW, GRAM = 10, 5
_BATCH = 1 << 20
_CAND = pa.struct([("start", pa.int32()), ("len", pa.int32()), ("fp", pa.int64()), ("words", pa.string())])


def _fingerprints(w: Words, n: int) -> np.ndarray:
    """Of the window of n words that begins at each word: the least hash of its
    k-grams; a window shorter than WINDOW is one k-gram."""
    if n < WINDOW:
        return grams(w.hashes, n)
    return window_min(grams(w.hashes, GRAM), WINDOW - GRAM + 1)


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, len, fp, words) of every window of the items."""
    src = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_rows(batches, "text", _BATCH):
            w = words_of(texts)
            out = []
            for j, n in enumerate(np.diff(w.first).tolist()):
                if n:
                    m = min(n, WINDOW)
                    out += [(j, m, s) for s in range(w.first[j], w.first[j + 1] - m + 1)]
            if out:
                fps = {m: _fingerprints(w, m).view(np.int64) for m in {x[1] for x in out}}
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item").take(pa.array([x[0] for x in out])), pa.array([x[1] for x in out], pa.int32()),
                     pa.array([fps[m][s] for _, m, s in out], pa.int64()),
                     pa.array([w.joined(s, m) for _, m, s in out])], names=["item", "len", "fp", "words"])

    kind = src.schema["item"].dataType.simpleString()
    return src.mapInArrow(run, f"item {kind}, len int, fp bigint, words string")


def _scan(docs: DataFrame, id_col: str, text_col: str, bits: np.ndarray, short: list[int]) -> DataFrame:
    """Of every document its number of words and the windows whose fingerprint
    may be one of an item's."""
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"),
                      F.col(text_col).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_rows(batches, "text", _BATCH):
            w = words_of(texts)
            at, size, fp = [], [], []
            for n in [*short, WINDOW]:
                f = _fingerprints(w, n)
                hit = np.flatnonzero(within(w, n) & in_filter(shared.value, f)) if len(f) else np.zeros(0, np.int64)
                at.append(hit)
                size.append(np.full(len(hit), n))
                fp.append(f[hit])
            at, size, fp = (np.concatenate(x) for x in (at, size, fp))
            order = np.argsort(at, kind="stable")
            at, size, fp = at[order], size[order], fp[order]
            cands = pa.StructArray.from_arrays(
                [pa.array(at - w.first[np.searchsorted(w.first, at, "right") - 1], pa.int32()),
                 pa.array(size, pa.int32()), pa.array(fp.view(np.int64), pa.int64()),
                 pa.array([w.joined(s, n) for s, n in zip(at.tolist(), size.tolist())], pa.string())],
                fields=list(_CAND))
            offsets = np.searchsorted(at, w.first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("th"), pa.array(np.diff(w.first), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cands)], names=["id", "th", "n_words", "cands"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, th bigint, n_words bigint, "
                               "cands array<struct<start:int,len:int,fp:bigint,words:string>>")


def _covered(spans: str):
    """Number of places in the union of an array of sorted (s, e) spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, zero, lambda a, x: F.struct(
        F.greatest(a["end"], x["e"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).alias("n")), lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", with_hash: bool = False) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every document.

    Both sides keep the least k-gram hash of each window.  Documents send on
    only windows whose fingerprint may be an item's; these are joined on the
    fingerprint and the window's words, and overlapping hits extend to spans.
    An item of fewer words than a window is one window.

    Null texts have no words; an item without words has no windows; a null
    item id makes hits but is not listed; null document ids stay null; equal
    item ids count once; repeated documents give repeated rows; empty tables
    give no rows, or rows without hits.  Other columns are not read.
    """
    windows = materialise(item_windows(items, item_id_col, item_text_col), "item-windows")
    short = sorted(r.len for r in windows.where(F.col("len") < WINDOW).select("len").distinct().collect())
    bits = bit_filter(windows, "fp")
    scan = materialise(_scan(docs, id_col, text_col, bits, short).withColumn("rid", F.monotonically_increasing_id()),
                       "windows")
    known = windows.groupBy("len", "fp", "words").agg(F.collect_set("item").alias("items"))
    hits = (scan.select("rid", F.inline("cands"))
            .join(broadcast_if_small(known, 100_000), ["len", "fp", "words"])
            .groupBy("rid").agg(F.sort_array(F.collect_set(F.struct(
                F.col("start").alias("s"), (F.col("start") + F.col("len")).alias("e")))).alias("spans"),
                F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")))
    listed = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    rows = scan.select("rid", "id", "th", "n_words").join(hits, "rid", "left")
    n_hit = F.coalesce(_covered("spans"), F.lit(0).cast("long"))
    return rows.select(
        F.col("id").alias(id_col), *(["th"] if with_hash else []), "n_words", n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(listed, F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit, all columns kept, whatever their names.

    Null texts and texts without words have no hits and stay; of rows with
    equal ids each is judged by its own text; empty tables give an empty one,
    or all rows."""
    bad = materialise(contamination(docs, items, id_col, text_col, with_hash=True).where("contaminated")
                      .select(F.col(id_col).alias("_contaminated_id"), F.col("th").alias("_contaminated_th")).distinct(), "contaminated")
    rows, (own_id, own_text) = positional(docs, id_col, text_col)
    return rows.join(broadcast_if_small(bad, 200_000), F.col(own_id).eqNullSafe(F.col("_contaminated_id"))
                     & (F.xxhash64(own_text) == F.col("_contaminated_th")), "left_anti").toDF(*docs.columns)
