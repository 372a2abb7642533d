"""Word vectors and text features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.text import whitespace_tokens
from ..session import cut_lineage
from .metrics import cosine
from .text_vectors import VectorTable, over_vectors, same_as_before


def vector_id(word: Column, n_vectors: int) -> Column:
    """Repeatable word -> row of the vector table: the first 32 bits of
    ``md5(word)`` modulo the table size.  Computed per word, so assigning
    vectors needs no global ordering of the vocabulary."""
    h = F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(n_vectors))


def word_ids(texts: DataFrame, text_col: str, embeddings: DataFrame) -> VectorTable:
    """The lower-case words of a corpus, each with its row of
    ``embeddings(vec_id, embedding)``.  The vocabulary is a distinct (partial
    aggregate)."""
    n = embeddings.count()
    words = texts.select(F.explode(whitespace_tokens(F.lower(text_col))).alias("word")).distinct()
    return VectorTable(words.select("word", vector_id(F.col("word"), n).alias("vec_id")),
                       embeddings.select("vec_id", F.col("embedding").alias("vector")))


def word_vectors(texts: DataFrame, text_col: str, embeddings: DataFrame) -> DataFrame:
    """The word-vector table ``(word, vector)`` of :func:`word_ids`: the vector
    table is joined on ``vec_id``; its size is checked by AQE before any
    broadcast.
    """
    words, table = word_ids(texts, text_col, embeddings)
    return words.join(table, "vec_id").select("word", "vector")


def vector_dim(embeddings: DataFrame, col: str = "embedding") -> int:
    return int(embeddings.select(F.size(col)).first()[0])


def text_vectors(df: DataFrame, key_cols: list[str], text_col: str, vectors: DataFrame, dim: int,
                 out: str = "vec") -> DataFrame:
    """E1 for whole texts (one vector per row).  Words are looked up
    case-sensitively (J1: left outer, unknown words weigh zero but count in
    the divisor ``n_words + 0.001``)."""
    from .rank import sentence_vectors

    s = df.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(key_cols)], F.col(text_col).alias("sentence"))
    s = s.select(F.struct(*[f"_k{j}" for j in range(len(key_cols))]).alias("doc_id"), F.lit(0).alias("i"), "sentence")
    v = sentence_vectors(s, vectors, dim)
    return v.select(*[F.col("doc_id")[f"_k{j}"].alias(k) for j, k in enumerate(key_cols)], F.col("vec").alias(out))


def glove_cosine(pairs: DataFrame, key_cols: list[str], vectors: DataFrame, dim: int,
                 pred: str = "prediction", ref: str = "reference", group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Mean row-wise cosine of aligned prediction and reference
    vectors (the diagonal only, never the N x N matrix), of all rows or by
    ``group_cols`` (among the keys)."""
    rows = rowwise_cosine(pairs, key_cols, vectors, dim, pred, ref)
    return rows.groupBy(*group_cols).agg(F.avg("cosine").alias("glove_cosine"))


def rowwise_cosine(pairs: DataFrame, key_cols: list[str], vectors: DataFrame, dim: int,
                   pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """``(keys, cosine)`` of aligned texts, a row for each distinct key.  The two texts of
    a key go to one block of texts, and their cosine is made where the vectors are."""
    both = pairs.select(F.struct(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(key_cols)]).alias("doc_id"), F.explode(F.array(
        F.struct(F.lit(0).alias("i"), F.col(pred).alias("sentence")),
        F.struct(F.lit(1).alias("i"), F.col(ref).alias("sentence")))).alias("x")).select("doc_id", "x.i", "x.sentence")
    rows = over_vectors(both, vectors, dim, _pair_cosine, f"doc_id {both.schema['doc_id'].dataType.simpleString()}, cosine double")
    return rows.select(*[F.col("doc_id")[f"_k{j}"].alias(k) for j, k in enumerate(key_cols)], "cosine")


def _pair_cosine(t: pa.Table) -> pa.Table:
    """``(doc_id, cosine)`` of the two texts of each key; a null vector gives 0."""
    first = np.flatnonzero(t.column("new").to_numpy())
    side = t.column("i").to_numpy()
    other = first + np.add.reduceat(side == 0, first)  # rows of a side hold one vector
    lists = t.column("vec").combine_chunks()
    v = pc.fill_null(lists.flatten(), 0.0).to_numpy(zero_copy_only=False).reshape(len(t), -1)
    return pa.table({"doc_id": t.column("doc_id").take(pa.array(first)), "cosine": cosines(v[first], v[other])})


def cosines(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The cosine of each row of two matrices; 0 for a zero vector."""
    size = np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1)
    return np.divide((u * v).sum(axis=1), size, out=np.zeros(len(u)), where=size > 0)


def lookup_with_default(words: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Word -> vector, zero vector when the word is unknown."""
    return words.join(vectors, "word", "left").select(
        "word", F.coalesce(F.col("vector").cast("array<double>"), F.array_repeat(F.lit(0.0), dim)).alias("vector"))


# ------------------------------------------------------------------ E4, E5

TERM = r"[\p{L}\p{N}_]+"


def bag_of_words(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """Lower-case terms of two or more word characters, counted per row."""
    terms = F.filter(F.regexp_extract_all(F.lower(text_col), F.lit(TERM), 0), lambda t: F.length(t) >= 2)
    return df.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


#: Characters of a block's texts, and of the documents whose weights are made at once.
BLOCK_CHARS, HELD_CHARS = 64 << 20, 16 << 20


def _documents(batches: Iterator[pa.RecordBatch], held_chars: int) -> Iterator[tuple]:
    """What ``(b, kind, key, terms, term, df)`` in order of block, kind and key holds, as ``(b, terms and df of the block,
    rows of whole keys)``."""
    at, words, held, size = None, [], [], 0
    for batch in batches:
        b, kind = (batch.column(c).to_numpy() for c in (0, 1))
        cuts = np.flatnonzero((b[1:] != b[:-1]) | (kind[1:] != kind[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(b)]):
            if hi == lo:
                continue
            if b[lo] != at:
                if held:
                    yield at, words, pa.Table.from_batches(held)
                at, words, held, size = b[lo], [], [], 0
            some = batch.slice(lo, hi - lo)
            if kind[lo] == 0:
                words.append(some.select(["term", "df"]))
                continue
            held.append(some.select(["key", "terms"]))
            size += some.column("terms").nbytes
            if size > held_chars:
                t = pa.Table.from_batches(held).combine_chunks()
                last = int(np.flatnonzero(~same_as_before(t.column("key").combine_chunks()))[-1])
                if last:
                    yield at, words, t.slice(0, last)
                held, size = t.slice(last).to_batches(), 0
    if held:
        yield at, words, pa.Table.from_batches(held)


def _term_counts(t: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of whole keys: first row of each key, the terms, and (key, term, count)."""
    t = t.combine_chunks()
    first = ~same_as_before(t.column("key").combine_chunks())
    lists = pc.split_pattern(t.column("terms").combine_chunks(), " ")
    of = np.repeat(np.cumsum(first) - 1, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    pair, tf = np.unique(of * max(len(coded.dictionary), 1) + coded.indices.to_numpy(), return_counts=True)
    return np.flatnonzero(first), coded.dictionary, *np.divmod(pair, max(len(coded.dictionary), 1)), tf


def tfidf(df: DataFrame, key: str, text_col: str, block_chars: int = BLOCK_CHARS, held_chars: int = HELD_CHARS) -> DataFrame:
    """E5: unsmoothed TF-IDF ``tf * (ln(n / df) + 1)``, rows L2-normalised.

    The texts' terms are dealt into blocks by the key.  A block counts in how
    many keys a term is, the blocks' counts are added up by term, and each block
    gets the frequencies of its terms and weighs its documents; no row for each
    term of each document is shuffled.
    """
    n = df.select(key).distinct().count()
    chars = df.agg(F.sum(F.length(text_col).cast("long"))).first()[0]
    blocks = max(-(-int(chars or 0) // block_chars), df.sparkSession.sparkContext.defaultParallelism)
    terms = F.filter(F.regexp_extract_all(F.lower(text_col), F.lit(TERM), 0), lambda t: F.length(t) >= 2)
    rows = df.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b"), F.lit(1).alias("kind"), F.col(key).alias("key"),
                     F.explode(F.array(F.array_join(terms, " "))).alias("terms"), F.lit(None).cast("string").alias("term"),
                     F.lit(None).cast("long").alias("df")).where("terms <> ''")
    key_type = rows.schema["key"].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, t in _documents(batches, held_chars):
            _, names, _, term, _ = _term_counts(t)
            d = np.bincount(term, minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), b, np.int32)), names, pa.array(d)], names=["b", "term", "d"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, t in _documents(batches, held_chars):
            first, names, doc, term, tf = _term_counts(t)
            known = pa.Table.from_batches(words).combine_chunks()
            at = pc.index_in(names, value_set=known.column("term").combine_chunks()).to_numpy(zero_copy_only=False)
            w = tf * (np.log(n / known.column("df").to_numpy()[at[term]]) + 1)
            keys = t.column("key").combine_chunks().take(pa.array(first[doc]))
            norm = np.sqrt(np.bincount(doc, w * w))
            yield pa.RecordBatch.from_arrays([keys, names.take(pa.array(term)), pa.array(w / norm[doc])], names=["key", "term", "weight"])

    dealt = lambda x: x.repartitionById(blocks, "b").sortWithinPartitions("b", "kind", "key")
    counts = dealt(rows).mapInArrow(count, "b int, term string, d long").groupBy("b", "term").agg(F.sum("d").alias("d"))
    counts = cut_lineage(counts, "terms")
    given = counts.join(counts.groupBy("term").agg(F.sum("d").alias("df")), "term").select(
        "b", F.lit(0).alias("kind"), F.lit(None).cast(key_type).alias("key"), F.lit(None).cast("string").alias("terms"), "term", "df")
    schema = StructType([StructField("key", key_type), StructField("term", StringType()), StructField("weight", DoubleType())])
    return dealt(given.unionByName(rows)).mapInArrow(weigh, schema).withColumnRenamed("key", key)


# ------------------------------------------------------------------ E6, E7

def train_word2vec(df: DataFrame, text_col: str, window: int = 10, min_count: int = 2, dim: int = 100,
                   seed: int = 42, partitions: int | None = None):
    """``ml.feature.Word2Vec`` on word lists (not sentence strings)."""
    from pyspark.ml.feature import Word2Vec

    toks = df.select(whitespace_tokens(F.lower(text_col)).alias("words"))
    w2v = Word2Vec(vectorSize=dim, windowSize=window, minCount=min_count, seed=seed, inputCol="words",
                   outputCol="vec")
    if partitions:
        w2v = w2v.setNumPartitions(partitions)
    return w2v.fit(toks)


def nearest(vectors: DataFrame, key: str, vec_col: str, query: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` rows most cosine-similar to one query vector (the
    query itself excluded), ties by key.  ``query`` must hold one row; its
    vector becomes a literal, so the search is one scan and a top-k."""
    rows = query.select(key, F.col(vec_col).cast("array<double>")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"the query must be one row, not {'none' if not rows else 'several'}")
    (name, vector), = rows
    cand = vectors.where(F.col(key) != F.lit(name))
    scored = cand.select(key, cosine(F.col(vec_col).cast("array<double>"), F.array(*map(F.lit, vector))).alias("cosine"))
    return scored.orderBy(F.desc("cosine"), F.asc(key)).limit(k)
