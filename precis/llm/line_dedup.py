"""Line deduplication that can be undone: exact reference counts of line keys,
and sharded cuckoo filters over the keys that have reached the limit.

An index is a set of written tables.  ``postings`` holds each pair of a line
key and a document once; ``refs`` counts the documents of a key and names the
last one; ``filters`` holds a cuckoo filter for each shard of the key space,
with the keys that ``min_docs`` documents or more refer to.  Inserting or
deleting documents gives a new version: counts change exactly, and keys that
cross the limit enter their shard's filter or leave it, which a Bloom filter
could not do.  Deciding about documents sends on only lines whose key a filter
may hold; the exact counts have the last word, so a filter's false positive,
or a filter that is full, changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.llm.common import ASCII_SPACE, broadcast_if_small, materialise, mix64, stage

MIN_CHARS = 20
MIN_DOCS = 3

#: Keys that a shard holds on average at most when shards are dealt out.
SHARD_KEYS = 1 << 14
#: Filters of this size together go to every task; beyond it lines are joined
#: with the exact counts straight away.
FILTER_BYTES = 32 << 20
#: Dropped line numbers that may be broadcast; beyond it texts are shuffled.
DROPS_BROADCAST = 1_000_000

_SLOTS = 4
_KICKS = 500
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Cuckoo:
    """A cuckoo filter: buckets of four 16-bit fingerprints (0: free).

    A key's second bucket follows from its first one and its fingerprint, so
    fingerprints can move, and a key that was inserted once can be deleted.
    """

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def empty(cls, buckets: int) -> Cuckoo:
        return cls(np.zeros((buckets, _SLOTS), np.uint16))

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, _SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = keys.view(np.uint64)
        mask = np.uint64(len(self.table) - 1)
        prints = (mix64(k) >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)
        first = k & mask
        return prints.astype(np.uint16), first.astype(np.int64), (first ^ (mix64(prints) & mask)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> bool:
        """Whether all keys found a place; if not, the filter is of no use any more."""
        t, mask = self.table, len(self.table) - 1
        for p, a, b in zip(*(x.tolist() for x in self._places(keys))):
            at = a if (t[a] == 0).any() else b
            for kick in range(_KICKS):
                free = np.flatnonzero(t[at] == 0)
                if len(free):
                    t[at, free[0]] = p
                    break
                slot = (kick + p) % _SLOTS
                p, t[at, slot] = int(t[at, slot]), p
                at ^= int(mix64(np.array([p], np.uint64))[0]) & mask
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Keys must have been inserted."""
        for p, a, b in zip(*(x.tolist() for x in self._places(keys))):
            for at in (a, b):
                held = np.flatnonzero(self.table[at] == p)
                if len(held):
                    self.table[at, held[0]] = 0
                    break

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        prints, a, b = self._places(keys)
        return (self.table[a] == prints[:, None]).any(axis=1) | (self.table[b] == prints[:, None]).any(axis=1)


def _lines(text: str | Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(ASCII_SPACE)), _UPPER, _LOWER)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), key).alias(f"k{seed}") for seed in (1, 2)]


def _shard(bits: int) -> Column:
    """The top ``bits`` bits of a key's second hash."""
    return F.shiftrightunsigned(F.col("k2"), 64 - bits).cast("int") if bits else F.lit(0)


def _buckets(keys: int) -> int:
    """A power of two of buckets that is at most half full."""
    return 1 << max(4, int(np.ceil(np.log2(max(keys, 1) * 2 / _SLOTS))))


def _built(table: pa.Table) -> pa.Table:
    keys = table.column("k1").to_numpy()
    cuckoo = Cuckoo.empty(_buckets(max(len(keys), SHARD_KEYS)))
    data = cuckoo.dump() if cuckoo.insert(keys) else None
    return pa.table({"shard": table.column("shard")[:1], "data": pa.array([data], pa.binary())})


def _changed(old: pa.Table, changes: pa.Table) -> pa.Table:
    """One shard's filter after ``changes``; a shard without one gets one, a full one stays full."""
    shard = (old if old.num_rows else changes).column("shard")[:1]
    data = old.column("data")[0].as_py() if old.num_rows else Cuckoo.empty(_buckets(SHARD_KEYS)).dump()
    if data is not None and changes.num_rows:
        cuckoo, keys = Cuckoo.load(data), changes.column("k1").to_numpy()
        enters = changes.column("enters").to_numpy(zero_copy_only=False).astype(bool)
        cuckoo.delete(keys[~enters])
        data = cuckoo.dump() if cuckoo.insert(keys[enters]) else None
    return pa.table({"shard": shard, "data": pa.array([data], pa.binary())})


_FILTER_SQL = "shard int, data binary"


@dataclass(frozen=True)
class LineIndex:
    """One version of an index; every change gives another one."""

    postings: DataFrame  #: (id, k1, k2), each once
    refs: DataFrame  #: (k1, k2, docs, last)
    filters: DataFrame  #: (shard, data); null data: full, lets every key pass
    bits: int  #: shards: 2 ** bits
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
              min_chars: int = MIN_CHARS) -> LineIndex:
        """The index of ``docs``."""
        postings = materialise(_postings(docs, id_col, text_col, min_chars), "postings")
        return cls._of(postings, materialise(_counted(postings), "refs"), min_docs, min_chars)

    @classmethod
    def _of(cls, postings: DataFrame, refs: DataFrame, min_docs: int, min_chars: int) -> LineIndex:
        """Shards dealt out by the number of keys at the limit."""
        limit = refs.where(F.col("docs") >= min_docs)
        bits = max(0, int(np.ceil(np.log2(max(limit.count(), 1) / SHARD_KEYS))))
        filters = limit.select(_shard(bits).alias("shard"), "k1").groupBy("shard").applyInArrow(_built, _FILTER_SQL)
        return cls(postings, refs, materialise(filters, "line-filters"), bits, min_docs, min_chars)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index with ``docs`` as well; what it has of them already counts once."""
        new = _postings(docs, id_col, text_col, self.min_chars)
        same = [new[c].eqNullSafe(self.postings[c]) for c in ("id", "k1", "k2")]
        new = materialise(new.join(self.postings, same[0] & same[1] & same[2], "left_anti"), "new-postings")
        both = self.refs.withColumn("before", F.col("docs")).unionByName(
            _counted(new).withColumn("before", F.lit(0).cast("long")))
        refs = materialise(both.groupBy("k1", "k2").agg(F.sum("docs").alias("docs"),
                                                        F.max("last").alias("last"), F.sum("before").alias("before")), "refs")
        crossed = refs.where((F.col("docs") >= self.min_docs) & (F.col("before") < self.min_docs))
        return self._next(self.postings.unionByName(new), refs.drop("before"), crossed.select("k1", "k2", F.lit(True).alias("enters")))

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """The index without the documents of these ids, as if they had never been inserted."""
        ids = ids.select(F.col(id_col).alias("gone")).distinct()
        match = self.postings["id"].eqNullSafe(ids["gone"])
        rest = materialise(self.postings.join(ids, match, "left_anti"), "postings")
        touched = materialise(self.postings.join(ids, match, "left_semi").select("k1", "k2").distinct(), "touched")
        anew = materialise(_counted(rest.join(touched, ["k1", "k2"], "left_semi")), "counted-anew")
        refs = materialise(self.refs.join(touched, ["k1", "k2"], "left_anti").unionByName(anew), "refs")
        crossed = (self.refs.where(F.col("docs") >= self.min_docs).join(touched, ["k1", "k2"], "left_semi").select("k1", "k2")
                   .join(anew.where(F.col("docs") >= self.min_docs), ["k1", "k2"], "left_anti"))
        return self._next(rest, refs, crossed.withColumn("enters", F.lit(False)))

    def _next(self, postings: DataFrame, refs: DataFrame, crossed: DataFrame) -> LineIndex:
        held = refs.where(F.col("docs") >= self.min_docs).count()
        if held > SHARD_KEYS << self.bits:  # shards have outgrown their filters
            return self._of(postings, refs, self.min_docs, self.min_chars)
        changes = crossed.select(_shard(self.bits).alias("shard"), "k1", "enters")
        filters = self.filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(_changed, _FILTER_SQL)
        return LineIndex(postings, refs, materialise(filters, "line-filters"), self.bits, self.min_docs, self.min_chars)

    def _may_be_held(self, lines: DataFrame) -> DataFrame:
        """The rows of ``lines`` (k1, k2, ...) whose shard's filter may hold the key."""
        size = self.filters.agg(F.sum(F.length("data"))).first()[0] or 0
        if size > FILTER_BYTES:
            return lines
        shared = lines.sparkSession.sparkContext.broadcast({r.shard: r.data for r in self.filters.collect()})  # FILTER_BYTES at most
        bits = self.bits

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cuckoos = {s: d and Cuckoo.load(d) for s, d in shared.value.items()}
            for b in batches:
                k1, k2 = (b.column(c).to_numpy() for c in ("k1", "k2"))
                shard = k2.view(np.uint64) >> np.uint64(64 - bits) if bits else np.zeros(len(k2), np.uint64)
                ok = np.zeros(len(k1), bool)
                for s in np.unique(shard).tolist():
                    here = np.flatnonzero(shard == s)
                    if s in cuckoos:
                        ok[here] = cuckoos[s].may_hold(k1[here]) if cuckoos[s] else True
                yield b.filter(pa.array(ok))

        return lines.mapInArrow(probe, lines.schema)

    def dropped(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(kd, kt, lines): by hashes of id and text, the numbers (from 0) of the lines to drop."""
        lines = _line_keys(docs, id_col, text_col, self.min_chars, numbered=True)
        held = self.refs.where(F.col("docs") >= self.min_docs).select("k1", "k2", "last")
        # written first, so that the join's sides are plain exchanges and a common line can be split
        maybe = materialise(self._may_be_held(lines), "maybe-held")
        hits = maybe.join(broadcast_if_small(held, 200_000), ["k1", "k2"]).where(~F.col("id").eqNullSafe(F.col("last")))
        return hits.groupBy("kd", "kt").agg(F.collect_set("line").alias("lines"))

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, n_lines, n_dropped, kept): every document without the lines that
        ``min_docs`` documents of the index hold, but for the last of them."""
        drops = materialise(self.dropped(docs, id_col, text_col), "dropped-lines")
        if (drops.agg(F.sum(F.size("lines") + 4)).first()[0] or 0) <= DROPS_BROADCAST:
            drops = F.broadcast(drops)
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *_row_key(id_col, text_col))
        rows = stage(rows.join(drops, ["kd", "kt"], "left").withColumnRenamed("lines", "gone"), own=_lines("text"))
        rows = stage(rows, gone=F.coalesce("gone", F.array().cast("array<int>")))
        stay = F.array_except(F.sequence(F.lit(0), F.size("own") - 1), "gone")
        kept = F.when(F.size("gone") == 0, F.coalesce("text", F.lit(""))).otherwise(
            F.array_join(F.transform(stay, lambda i: F.get("own", i)), "\n"))
        return rows.select(F.col("id").alias(id_col), F.size("own").cast("long").alias("n_lines"),
                           F.size("gone").cast("long").alias("n_dropped"), kept.alias("kept"))


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """Two hashes; rows with equal ones have equal ids and texts, so they may share what is found."""
    return [F.xxhash64(F.lit(3), F.col(id_col)).alias("kd"), F.xxhash64(F.lit(4), F.col(text_col)).alias("kt")]


def _line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int, numbered: bool = False) -> DataFrame:
    """The key hashes of every line that is long enough, with the id, or with id, row key and line number."""
    own = [*_row_key(id_col, text_col)] if numbered else []
    rows = docs.select(F.col(id_col).alias("id"), *own, F.posexplode(_lines(F.col(text_col))).alias("line", "value"))
    keyed = stage(rows, value=_key(F.col("value"))).where(F.length("value") >= min_chars)
    return keyed.select("id", *(["kd", "kt", "line"] if numbered else []), *_hashes(F.col("value")))


def _postings(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    return _line_keys(docs, id_col, text_col, min_chars).distinct()


def _counted(postings: DataFrame) -> DataFrame:
    """(k1, k2, docs, last); a common key is counted inside tasks before it moves."""
    return postings.groupBy("k1", "k2").agg(F.count("*").alias("docs"), F.max("id").alias("last"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256) of every document, its lines judged
    by the index of the whole table.

    A line's key is the line without space characters at its ends, A-Z
    lower-cased.  Keys of 20 code points or more found in three documents or
    more lose all their lines, except in the document with the largest id.

    Null and empty texts are one empty line.  Rows with equal ids count as one
    document, and so do rows with a null id, which is less than any other; the
    rows themselves stay apart.  An empty table gives an empty one; other
    columns are not read.  Keys are compared by 128-bit hashes.
    """
    kept = LineIndex.build(docs, id_col, text_col).apply(docs, id_col, text_col)
    return kept.select(id_col, "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
