"""Word-vector sums of texts (E1) by blocks: the vectors come to the texts.

Texts are dealt into blocks by the hash of their key.  A block gets each
distinct word of its texts once, as a reference to a row of the vector table,
and each row of the table that it refers to once; then its texts stream by in
order.  So what moves is the texts and the blocks' vocabularies, never a vector
for each word of each text, and what is made of the vectors (a norm, a cosine,
a document's scores) is made where they are.  A task holds the vectors of one
block, and those of the texts in hand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import VECTOR_DIVISOR_EPS
from ..functions.text import whitespace_tokens

K = ["doc_id", "i"]
#: Characters of a block's texts, those whose words are looked up at once, and words whose vectors are gathered at once.
BLOCK_CHARS, HELD_CHARS, HELD_WORDS = 64 << 20, 4 << 20, 1 << 16


class VectorTable(NamedTuple):
    """Words as references to a table of vectors: ``(word, vec_id)`` and ``(vec_id, vector)``."""
    words: DataFrame
    table: DataFrame


def vector_table(vectors: DataFrame | VectorTable) -> VectorTable:
    """``(word, vector)`` as such a pair: each word has a vector of its own."""
    if isinstance(vectors, VectorTable):
        return vectors
    own = F.col("word").alias("vec_id")
    return VectorTable(vectors.select("word", own).distinct(), vectors.select(own, "vector"))


def same_as_before(column: pa.Array) -> np.ndarray:
    """Which values equal the one before (nulls are equal)."""
    if len(column) < 2:
        return np.zeros(len(column), bool)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    same = valid[1:] == valid[:-1]
    if pa.types.is_struct(column.type):
        for child in column.flatten():
            same &= same_as_before(child)[1:]
    else:
        equal = pc.fill_null(pc.equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
        same &= equal
    return np.concatenate([[False], same])


def _plain(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _lists(v: np.ndarray, null: np.ndarray) -> pa.Array:
    values = pa.array(v.ravel(), mask=np.repeat(null, v.shape[1])) if null.any() else pa.array(v.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), values)


def _spread(values: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Rows where there are any, zero rows elsewhere."""
    if has.all():
        return values
    out = np.zeros((len(has), values.shape[1]), values.dtype)
    out[has] = values
    return out


def _added_up(names: pa.Array, rows: np.ndarray, has: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct names with the sum of their rows, and whether they have any."""
    each = names.unique()
    if len(each) == len(names):
        return names, rows, has
    at = pc.index_in(names, value_set=each).to_numpy(zero_copy_only=False)
    out, some = np.zeros((len(each), rows.shape[1])), np.zeros(len(each), bool)
    np.add.at(out, at, rows)
    np.logical_or.at(some, at, has)
    return each, out, some


class _Block:
    """The vectors of the block in hand and what its words refer to."""

    def __init__(self, dim: int):
        self.dim, self.rows, self.words, self.matrix, self.known = dim, [], [], None, None

    def close(self) -> None:
        """All words are here: what a word refers to more than once is added up; a null vector counts as none."""
        ids = pa.concat_arrays([r[0] for r in self.rows]) if self.rows else pa.array([], pa.int64())
        lists = pa.concat_arrays([r[1] for r in self.rows]) if self.rows else pa.array([], pa.list_(pa.float64()))
        has = lists.is_valid().to_numpy(zero_copy_only=False)
        values = pc.fill_null(lists.drop_null().flatten(), 0).to_numpy(zero_copy_only=False).reshape(-1, self.dim)
        ids, self.matrix, self.has = _added_up(ids, _spread(values, has), has)
        self.known = None
        if self.words and len(ids):
            at = pc.index_in(pa.concat_arrays([w[1] for w in self.words]), value_set=ids)
            self.known = pa.concat_arrays([w[0] for w in self.words]).filter(at.is_valid())  # others refer to no row
            self.at, matrix, has = at.drop_null().to_numpy(zero_copy_only=False), self.matrix, self.has
            if len(self.known.unique()) < len(self.known):
                self.known, self.matrix, self.has = _added_up(self.known, matrix[self.at], has[self.at])
                self.at = np.arange(len(self.known))
        self.rows, self.words = [], []

    def sums(self, joined: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sum of the vectors of each text's words (unknown ones weigh nothing), and how many words refer to
        rows of the table, and to vectors."""
        out, full = np.zeros((len(n), self.dim)), np.flatnonzero(n > 0)
        if self.known is None or not len(full):
            return out, np.zeros(len(n)), np.zeros(len(n))
        found = pc.index_in(pc.split_pattern(joined.take(pa.array(full)), " ").flatten(), value_set=self.known)
        of = np.repeat(full, n[full])[found.is_valid().to_numpy(zero_copy_only=False)]
        at = self.at[found.drop_null().to_numpy(zero_copy_only=False)]
        for a in range(0, len(at), HELD_WORDS):
            mine = of[a:a + HELD_WORDS]
            first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            out[mine[first]] += np.add.reduceat(self.matrix[at[a:a + HELD_WORDS]].astype(float), first, axis=0)
        return out, np.bincount(of, minlength=len(n)), np.bincount(of, self.has[at], len(n))


def _vectors(block: _Block, t: pa.Table) -> pa.Table:
    """``(doc_id, i, vec, new)``: rows with one key share the sum of their words (J1: a null key has none); ``new`` marks
    the first row of a document."""
    doc, i, n = _plain(t.column("doc_id")), _plain(t.column("i")), t.column("n").to_numpy()
    new = ~same_as_before(doc)
    first = new | ~same_as_before(i)
    s, found, held = block.sums(_plain(t.column("joined")), n)
    if not first.all():
        start = np.flatnonzero(first)
        s, found, held = (np.repeat(np.add.reduceat(x, start, axis=0), np.diff(np.append(start, len(first))), axis=0) for x in (s, found, held))
    keyed = doc.is_valid().to_numpy(zero_copy_only=False) & (n > 0)
    vec = np.where(keyed[:, None], s / (n[:, None] + VECTOR_DIVISOR_EPS), 0.0)
    return pa.table({"doc_id": doc, "i": i, "vec": _lists(vec, keyed & (found > 0) & (held == 0)), "new": pa.array(new)})


def over_vectors(sents: DataFrame, vectors: DataFrame | VectorTable, dim: int, kernel: Callable[[pa.Table], pa.Table], schema: str,
                 whole: bool = True, chars: int | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``kernel`` over the vectors of texts ``(doc_id, i, sentence)``: it gets tables ``(doc_id, i, vec, new)`` in order of
    document and ``i``, with whole documents (all rows with one ``doc_id``) if ``whole``, else with whole keys, and gives
    rows of ``schema``.

    A vector is ``sum(vec(w)) / (n_words + 0.001)`` over whitespace words; unknown words count in the divisor, no words give
    zero.  ``chars`` is the number of characters of the texts, which is counted if not given.
    """
    spark = sents.sparkSession
    if chars is None:
        chars = sents.agg(F.sum(F.length("sentence").cast("long"))).first()[0]
    blocks = max(-(-int(chars or 0) // block_chars), spark.sparkContext.defaultParallelism)
    deal = F.xxhash64("doc_id") if whole else F.xxhash64(*K, F.when(F.col("doc_id").isNull(), F.col("sentence")))
    rows = sents.select(*K, F.pmod(deal, F.lit(blocks)).cast("int").alias("b"), whitespace_tokens("sentence").alias("t"))
    rows = rows.select(*K, "b", F.coalesce(F.array_join("t", " "), F.lit("")).alias("joined"), F.greatest(F.size("t"), F.lit(0)).alias("n"))
    words, table = vector_table(vectors)
    of = rows.where("n > 0").select("b", F.explode(F.split("joined", " ")).alias("word")).distinct()
    of = of.join(words.select("word", "vec_id"), "word")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields} | {
        "vec_id": words.schema["vec_id"].dataType.simpleString(), "vector": table.schema["vector"].dataType.simpleString()}
    layout = ["b", "kind", *K, "joined", "n", "vec_id", "vector"]

    def part(df: DataFrame, kind: int) -> DataFrame:
        return df.select(*(F.lit(kind).alias(c) if c == "kind" else F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c)
                           for c in layout))

    seen = of.select("b", "vec_id").distinct().join(table.select("vec_id", "vector"), "vec_id")
    dealt = part(seen, 0).unionByName(part(of.withColumnRenamed("word", "joined"), 1)).unionByName(part(rows, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, held, size, carried = None, None, [], 0, None

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            """Runs the kernel on what is complete, or on all; the rest is carried."""
            nonlocal held, size, carried
            if held:
                if block.matrix is None:
                    block.close()
                t = pa.Table.from_batches(held)
                if not last:  # a key's rows stay together
                    first = np.flatnonzero(~(same_as_before(_plain(t.column("doc_id"))) & same_as_before(_plain(t.column("i")))))
                    t, rest = t.slice(0, first[-1]), t.slice(first[-1])
                    held, size = rest.to_batches(), 0
                else:
                    held, size = [], 0
                if len(t):
                    t = _vectors(block, t)
                    if carried is not None:
                        new = t.column("new").to_numpy().copy()
                        both = pa.concat_arrays([_plain(carried.column("doc_id"))[-1:], _plain(t.column("doc_id"))[:1]])
                        new[0] = not same_as_before(both)[1]
                        t = pa.concat_tables([carried, t.set_column(3, "new", pa.array(new))]).combine_chunks()
                    carried = t
            if carried is not None:
                end = len(carried)
                if whole and not last:
                    end = int(np.flatnonzero(carried.column("new").to_numpy())[-1])
                ready, carried = carried.slice(0, end), None if end == len(carried) else carried.slice(end)
                if len(ready):
                    yield from kernel(ready).to_batches()

        for batch in batches:
            b, kind = (batch.column(c).to_numpy() for c in (0, 1))
            cuts = np.flatnonzero((b[1:] != b[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(b)]):
                if hi == lo:
                    continue
                if b[lo] != at:
                    yield from done(True)
                    block, at = _Block(dim), b[lo]
                some = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    block.rows.append((some.column("vec_id"), some.column("vector")))
                elif kind[lo] == 1:
                    block.words.append((some.column("joined"), some.column("vec_id")))
                else:
                    held.append(some.select(["doc_id", "i", "joined", "n"]))
                    size += held[-1].column("joined").nbytes
                    if size > HELD_CHARS:
                        yield from done(False)
        yield from done(True)

    dealt = dealt.repartitionById(blocks, "b").sortWithinPartitions("b", "kind", *K)
    return dealt.mapInArrow(run, schema)


def per_document(kernel: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A kernel of one document's rows ``(doc_id, i, vec)`` as one of many."""
    def run(t: pa.Table) -> pa.Table:
        start = np.flatnonzero(t.column("new").to_numpy())
        t = t.select(["doc_id", "i", "vec"])
        return pa.concat_tables([kernel(t.slice(a, z - a)) for a, z in zip(start, [*start[1:], len(t)])])

    return run
