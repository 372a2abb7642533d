"""Similarity of many vectors: all pairs within a document (E2), and the
nearest rows of many queries (E7), exactly or through an inverted file.

Work is dealt out in pairs of blocks, so no task holds a document, a list or a
set of queries of unbounded size; each pair of blocks is one matrix product,
and only the best of it leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .rank import sentence_vectors, split_by_size
from .text_vectors import VectorTable, over_vectors, per_document

#: Rows of a block.
BLOCK = 2048
#: Cosines are compared rounded to so many places, so that ties are the same in every block.
PLACES = 9


def _matrix(column) -> np.ndarray:
    """Unit rows of a column of vectors; a zero vector stays zero."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)
    size = np.linalg.norm(m, axis=1)[:, None]
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _best(cos: np.ndarray, ids: np.ndarray, top: int | None, least: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``top`` largest values, of equal ones those with the least id; nan never."""
    ok = ~np.isnan(cos) if least is None else cos >= least  # nan is never at least anything
    if top is None:
        return np.nonzero(ok)
    value = np.where(ok, np.round(cos, PLACES), -np.inf)
    if value.shape[1] > 4 * top:  # all that reach the value of the last one that counts
        edge = np.partition(value, value.shape[1] - top, axis=1)[:, value.shape[1] - top]
        ok &= value >= edge[:, None]
    row, col = np.nonzero(ok)
    order = np.lexsort((ids[col], -value[row, col], row))
    row, col = row[order], col[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1]) if len(row) else np.zeros(0, int)
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.concatenate([first, [len(row)]]))) if len(row) else row
    return row[rank < top], col[rank < top]


# ------------------------------------------------------------------ E2

def pairwise_cosine(vecs: DataFrame, top: int | None = None, least: float | None = None, block: int = BLOCK) -> DataFrame:
    """``(doc_id, i, j, cosine)`` of the ordered pairs of sentences of a
    document, ``i <> j``: all, those of at least ``least``, or the ``top`` of
    each ``i`` (ties to the lesser ``j``).

    ``vecs`` is ``(doc_id, i, vec)``.  The matrix of a document is dealt out in
    pairs of blocks of sentences; a zero vector has cosine 0 with any other.
    """
    vecs = vecs.select("doc_id", "i", F.col("vec").cast("array<double>").alias("vec"), F.floor(F.col("i") / block).cast("int").alias("b"))
    last = vecs.groupBy(F.col("doc_id").alias("of")).agg(F.max("b").alias("last"))
    dealt = vecs.join(last, F.col("doc_id").eqNullSafe(F.col("of"))).select("doc_id", "i", "vec", "b", F.explode(F.sequence(F.lit(0), "last")).alias("c"))
    dealt = dealt.withColumn("bi", F.least("b", "c")).withColumn("bj", F.greatest("b", "c"))
    types = {f.name: f.dataType.simpleString() for f in vecs.schema.fields}

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("i").to_numpy()
        m, b = _matrix(table.column("vec")), table.column("b").to_numpy()
        bi, bj = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
        out = []
        for x, y in {(bi, bj), (bj, bi)}:
            u, v = np.flatnonzero(b == x), np.flatnonzero(b == y)
            cos = m[u] @ m[v].T
            if x == y:
                np.fill_diagonal(cos, np.nan)
            row, col = _best(cos, ids[v], top, least)
            out.append((ids[u][row], ids[v][col], cos[row, col]))
        i, j, c = (np.concatenate(x) for x in zip(*out))
        return pa.table({"doc_id": table.column("doc_id").combine_chunks().take(pa.array(np.zeros(len(i), np.int64))),
                         "i": pa.array(i), "j": pa.array(j), "cosine": pa.array(c)})

    pairs = dealt.select("doc_id", "i", "vec", "b", "bi", "bj").groupBy("doc_id", "bi", "bj").applyInArrow(
        run, f"doc_id {types['doc_id']}, i {types['i']}, j {types['i']}, cosine double")
    if top is None:
        return pairs
    order = Window.partitionBy("doc_id", "i").orderBy(F.desc(F.round("cosine", PLACES)), "j")
    return pairs.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= top).drop("rn")


def _within(top: int | None, least: float | None):
    """The pairs of one document's sentences, as :func:`pairwise_cosine` gives them."""
    def run(table: pa.Table) -> pa.Table:
        ids, m = table.column("i").to_numpy(), _matrix(table.column("vec"))
        cos = m @ m.T
        np.fill_diagonal(cos, np.nan)
        row, col = _best(cos, ids, top, least)
        i, j, c = ids[row], ids[col], cos[row, col]
        if top is not None and len(np.unique(ids)) < len(ids):  # rows with one key share their places
            order = np.lexsort((j, -np.round(c, PLACES), i))
            i, j, c = i[order], j[order], c[order]
            start = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, int)
            keep = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i)))) < top
            i, j, c = i[keep], j[keep], c[keep]
        return pa.table({"doc_id": table.column("doc_id").combine_chunks().take(pa.array(np.zeros(len(i), np.int64))),
                         "i": pa.array(i), "j": pa.array(j), "cosine": pa.array(c)})

    return run


def pairwise_text_cosine(sents: DataFrame, vectors: DataFrame | VectorTable, dim: int, top: int | None = None, least: float | None = None,
                         chars: int | None = None, block: int = BLOCK) -> DataFrame:
    """:func:`pairwise_cosine` of the E1 vectors of sentences ``(doc_id, i,
    sentence)``.  A document of one block is compared where its vectors are
    made, which no shuffle carries; larger ones go through the pairs of blocks."""
    types = {f.name: f.dataType.simpleString() for f in sents.schema.fields}
    rows, large = split_by_size(sents, F.count(F.lit(1)) > block)
    out = over_vectors(rows, vectors, dim, per_document(_within(top, least)),
                       f"doc_id {types['doc_id']}, i {types['i']}, j {types['i']}, cosine double", chars=chars)
    if large is None:
        return out
    vecs = cut_lineage(sentence_vectors(large, vectors, dim), "vectors")
    return out.unionByName(pairwise_cosine(vecs, top, least, block).select(out.columns))


# ------------------------------------------------------------------ E7

def _assign(df: DataFrame, centroids: np.ndarray, probe: int) -> DataFrame:
    """``df`` (id, vec) with the ``probe`` nearest centroids of each row, a row for each."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            near = _matrix(b.column("vec")) @ shared.value.T
            k = min(probe, near.shape[1])
            lists = np.argsort(-near, axis=1, kind="stable")[:, :k]
            row = np.repeat(np.arange(b.num_rows), k)
            yield b.take(pa.array(row)).append_column("list", pa.array(lists.ravel().astype(np.int32)))

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.mapInArrow(run, f"id {types['id']}, vec array<double>, list int")


def _centroids(sample: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means."""
    pick = np.random.default_rng(seed).choice(len(sample), min(lists, len(sample)), replace=False)
    c = sample[np.sort(pick)]
    for _ in range(rounds):
        near = np.argmax(sample @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1)[:, None]
        c = np.where(size > 0, np.divide(sums, size, out=np.zeros_like(sums), where=size > 0), c)
    return c


def _probe(sample: np.ndarray, centroids: np.ndarray, recall: float, k: int = 10, queries: int = 256) -> int:
    """How many lists a query needs, as measured in the sample: its first rows
    ask for their ``k`` nearest there, and the lists that hold ``recall`` of
    them are counted.  (In the whole table the nearest are nearer still.)"""
    ask = sample[:queries]
    cos = ask @ sample.T
    cos[np.arange(len(ask)), np.arange(len(ask))] = -np.inf
    near = np.argsort(-cos, axis=1, kind="stable")[:, :min(k, max(len(sample) - 1, 1))]
    order = np.argsort(-(ask @ centroids.T), axis=1, kind="stable")
    rank = np.argsort(order, axis=1)  # of each list in a query's order
    home = np.argmax(sample @ centroids.T, axis=1)
    return int(np.quantile(np.take_along_axis(rank, home[near], axis=1), recall, method="higher")) + 1


def _search(rows: DataFrame, queries: DataFrame, k: int, block: int) -> DataFrame:
    """Each query's ``k`` nearest rows of its lists.  ``rows`` and ``queries`` are
    (id, vec, list); a list is dealt out in pairs of a block of rows and one of queries."""
    def blocks(df: DataFrame) -> DataFrame:
        return df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"))  # a row for each list

    sizes = blocks(rows).withColumnRenamed("n", "rn").join(blocks(queries).withColumnRenamed("n", "qn"), "list")
    sizes = cut_lineage(sizes, "list-sizes")
    deal = lambda df, mine, other: df.join(F.broadcast(sizes), "list").select(
        "id", "vec", "list", F.pmod(F.xxhash64("id", F.lit(7)), F.col(mine)).cast("int").alias("own"),
        F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("other"))
    a = deal(rows, "rn", "qn").select("id", "vec", "list", F.col("own").alias("rb"), F.col("other").alias("qb"))
    b = deal(queries, "qn", "rn").select("id", "vec", "list", F.col("other").alias("rb"), F.col("own").alias("qb"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(have: pa.Table, ask: pa.Table) -> pa.Table:
        ids, wanted = have.column("id").combine_chunks(), ask.column("id").combine_chunks()
        if not len(ids) or not len(wanted):
            return pa.table({"query": wanted[:0], "id": ids[:0], "cosine": pa.array([], pa.float64())})
        m, out = _matrix(have.column("vec")), []
        # places in the order of ids: what ties go by, whatever the ids' type
        place = np.empty(len(ids), np.int64)
        place[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        q = _matrix(ask.column("vec"))
        for at in range(0, len(q), 256):
            cos = q[at:at + 256] @ m.T
            row, col = _best(cos, place, k + 1, None)  # the query itself may be among them
            out.append((row + at, col, cos[row, col]))
        row, col, c = (np.concatenate(x) for x in zip(*out))
        return pa.table({"query": wanted.take(pa.array(row)), "id": ids.take(pa.array(col)), "cosine": pa.array(c)})

    keys = ["list", "rb", "qb"]
    found = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(run, f"query {kind}, id {kind}, cosine double")
    order = Window.partitionBy("query").orderBy(F.desc(F.round("cosine", PLACES)), "id")
    found = found.where(F.col("query") != F.col("id"))
    return found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).drop("rn")


def _rows(df: DataFrame, key: str, vec_col: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col(vec_col).isNotNull()).select(
        F.col(key).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))


def nearest_exact(vectors: DataFrame, queries: DataFrame, key: str, vec_col: str, k: int = 10, block: int = BLOCK) -> DataFrame:
    """E7 for many queries: ``(query, id, cosine)``, the ``k`` rows most similar
    to each (itself left out, ties to the lesser key), against all rows in blocks."""
    one = lambda df: _rows(df, key, vec_col).withColumn("list", F.lit(0))
    return _search(one(vectors), one(queries), k, block)


@dataclass(frozen=True)
class InvertedFile:
    """Rows by their nearest centroid."""

    centroids: np.ndarray
    rows: DataFrame  #: (id, vec, list), every row of the table
    probe: int  #: lists that a query asks

    @classmethod
    def build(cls, vectors: DataFrame, key: str, vec_col: str, lists: int | None = None, sample: int = 20_000, rounds: int = 8,
              seed: int = 42, recall: float = 0.97) -> InvertedFile:
        """Centroids are fitted to ``sample`` rows at most, in the order of a hash
        of their keys (the bound of what the driver holds); ``lists`` is by
        default the root of the number of rows, 4,096 at most.  Every row is
        indexed.  A query asks as many lists as ``recall`` needs in the sample:
        few where vectors lie in clusters, most of them where they do not."""
        rows = _rows(vectors, key, vec_col)
        n = rows.count()
        lists = lists or int(min(max(np.sqrt(n), 1), 4096))
        some = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("vec").toArrow()
        if not n:
            return cls(np.zeros((0, 1)), rows.withColumn("list", F.lit(0)), 1)
        unit = _matrix(some.column("vec"))
        centroids = _centroids(unit, lists, rounds, seed)
        return cls(centroids, cut_lineage(_assign(rows, centroids, 1), "inverted-file"), _probe(unit, centroids, recall))

    def nearest(self, queries: DataFrame, key: str, vec_col: str, k: int = 10, probe: int | None = None, block: int = BLOCK) -> DataFrame:
        """``(query, id, cosine)``: the ``k`` best of the rows in each query's
        ``probe`` nearest lists, by exact cosine."""
        ask = _rows(queries, key, vec_col)
        if not len(self.centroids):
            return _search(self.rows, ask.withColumn("list", F.lit(0)), k, block)
        return _search(self.rows, _assign(ask, self.centroids, probe or self.probe), k, block)
