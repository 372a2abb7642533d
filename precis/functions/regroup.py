"""Word-level joins: every word of a text replaced by what a table says.

The texts are written once, as words joined by spaces, and dealt into blocks.
A block gets each distinct word of its texts once, with its values, and then
its texts, in which the values take the words' places; so what moves is the
texts and the blocks' vocabularies, never a row for each word of each text.  A
task holds the vocabulary of one block and the texts in hand.

A row is dealt by a number of its own, not by its key columns, so rows with
equal keys (one id in two splits) stay apart and many of them spread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..session import cut_lineage

#: Characters of a block's texts, and of those whose words are looked up at once.
BLOCK_CHARS, HELD_CHARS = 64 << 20, 16 << 20
#: What becomes of a word without values: it stays, or goes; any other value takes its place.
STAYS, GOES = "stays", "goes"


class _Values:
    """The values of a block's words: those of ``known[i]`` are ``values[start[i]:start[i] + n[i]]``, in order."""

    def __init__(self, words: list[pa.Array], values: list[pa.Array], kind: pa.DataType):
        names = pa.concat_arrays(words) if words else pa.array([], pa.string())
        value = pa.concat_arrays(values) if values else pa.array([], kind)
        self.known = names.unique()
        at = pc.index_in(names, value_set=self.known).filter(value.is_valid())
        value = value.drop_null()
        self.n = np.bincount(at.to_numpy(zero_copy_only=False), minlength=len(self.known))
        self.start = np.cumsum(self.n) - self.n
        self.values = value.take(pc.sort_indices(pa.table({"at": at, "value": value}), [("at", "ascending"), ("value", "ascending")]))

    def of(self, joined: pa.Array, unknown) -> pa.ListArray:
        """The values of each text's words; a null text gives a null list."""
        null = joined.is_null().to_numpy(zero_copy_only=False)
        some = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(joined), 0), False).to_numpy(zero_copy_only=False))
        lists = pc.split_pattern(joined.take(pa.array(some)), " ")
        words, tokens = lists.flatten(), np.zeros(len(joined) + 1, np.int64)
        tokens[some + 1] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        found = pc.index_in(words, value_set=self.known)
        hit, at = found.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(found, 0).to_numpy(zero_copy_only=False)
        if unknown == STAYS:
            pool, other = pa.concat_arrays([self.values, words]), len(self.values) + np.arange(len(words))
        else:
            pool = self.values if unknown == GOES else pa.concat_arrays([self.values, pa.array([unknown], self.values.type)])
            other = np.full(len(words), len(self.values))
        n = np.full(len(words), 0 if unknown == GOES else 1)
        n[hit], other[hit] = self.n[at[hit]], self.start[at[hit]]
        ends = np.concatenate([[0], np.cumsum(n)])
        each = np.repeat(other - ends[:-1], n) + np.arange(ends[-1])
        offsets = ends[np.cumsum(tokens)].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pool.take(pa.array(each)), mask=pa.array(null))


def _slices(held: list[pa.RecordBatch], texts: list[str]) -> Iterator[pa.Table]:
    """The rows in hand by runs of some ``HELD_CHARS``."""
    t = pa.Table.from_batches(held).combine_chunks()
    sizes = sum(pc.fill_null(pc.binary_length(t.column(c)), 0).to_numpy().astype(np.int64) for c in texts)
    run = (np.cumsum(sizes) - sizes) // HELD_CHARS
    cuts = np.flatnonzero(np.diff(run)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(t)]):
        yield t.slice(lo, hi - lo)


def replace_words(df: DataFrame, words: dict[str, Column], lookup: DataFrame | Callable[[DataFrame], DataFrame], unknown,
                  joined: bool = True, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``df`` with the columns that ``words`` names (column name -> array of words, which hold no space and are not empty;
    null words are left out) made anew: each word gives its values in ``lookup(word, value)``, in order, one word none if its
    only value is null, and ``unknown`` if the table does not have it.  The result is the values joined by spaces, or
    an array of them if not ``joined``; a null array stays null.

    ``lookup`` may be made from a table of the words (``word``, not distinct).  The texts are written before they are read
    for their words and for the result.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in words]
    texts = [f"t{k}" for k in range(len(words))]
    own = F.monotonically_increasing_id()
    rows = df.select(own.alias("rid"), F.struct(own.alias("rid"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept))).alias("rest"),
                     *(F.array_join(w, " ").alias(t) for t, w in zip(texts, words.values())))
    rows = cut_lineage(rows, "texts")
    chars = rows.agg(F.sum(sum((F.coalesce(F.length(t).cast("long"), F.lit(0)) for t in texts), F.lit(0)))).first()[0]
    blocks = max(-(-int(chars or 0) // block_chars), spark.sparkContext.defaultParallelism)
    rows = rows.withColumn("b", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int"))
    said = F.concat(*(F.when(F.length(t) > 0, F.split(t, " ")).otherwise(F.array().cast("array<string>")) for t in texts))
    of = rows.select("b", F.explode(said).alias("word")).distinct()
    if callable(lookup):
        lookup = lookup(of.select("word"))
    value_type, rest_type = lookup.schema["value"].dataType, rows.schema["rest"].dataType
    given = of.join(lookup.select("word", "value"), "word").select(
        "b", F.lit(0).alias("kind"), "word", "value", F.lit(None).cast(rest_type).alias("rest"), *(F.lit(None).cast("string").alias(t) for t in texts))
    dealt = given.unionByName(rows.select("b", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("word"),
                                          F.lit(None).cast(value_type).alias("value"), "rest", *texts))
    made = StructType([StructField("rest", rest_type), *(StructField(t, StringType() if joined else ArrayType(value_type)) for t in texts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, said, held, size = None, None, [], [], 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            for t in _slices(held, texts) if held else ():
                out = [t.column("rest").combine_chunks()]
                for c in texts:
                    got = values.of(t.column(c).combine_chunks(), unknown)
                    out.append(pc.binary_join(got, " ") if joined else got)
                yield pa.RecordBatch.from_arrays(out, names=["rest", *texts])
            held, size = [], 0

        for batch in batches:
            b, kind = (batch.column(c).to_numpy() for c in (0, 1))
            cuts = np.flatnonzero((b[1:] != b[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(b)]):
                if hi == lo:
                    continue
                if b[lo] != at:
                    yield from done()
                    at, values, said = b[lo], None, []
                some = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    said.append((some.column("word"), some.column("value")))
                    continue
                if values is None:
                    values, said = _Values([w for w, _ in said], [v for _, v in said], batch.schema.field("value").type), []
                held.append(some.select(["rest", *texts]))
                size += sum(some.column(c).nbytes for c in texts)
                if size > HELD_CHARS:
                    yield from done()
        yield from done()

    out = dealt.repartitionById(blocks, "b").sortWithinPartitions("b", "kind").mapInArrow(run, made)
    named = {c: F.col(f"rest.c{k}") for k, c in enumerate(kept)} | {c: F.col(t) for t, c in zip(texts, words)}
    return out.select(*(named[c].alias(c) for c in df.columns))
