"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.session import cut_lineage

#: Bytes of text a task works on at a time.
BATCH_BYTES = 4 << 20

#: Space characters of the byte range: space, tab, line feed, vertical tab,
#: form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column named twice in one projection, or once inside a lambda, may be
    computed again at each use once Catalyst has merged the projections; a
    lambda variable is a computed value.
    """
    return F.transform(F.array(value), body)[0]


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back."""
    return cut_lineage(df, f"llm-{tag}")


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialise` wrote and nothing will read again
    (what was made from them is written itself)."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` added or replaced, each computed once per row.

    ``withColumns`` would do, but Catalyst may merge projections and then
    compute a column again at each use inside a lambda; a generator that makes
    one row of each row keeps the steps apart.
    """
    made = F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return df.select(*(F.col(n) for n in df.columns if n not in columns), made)


def running_sums(df: DataFrame, *names: str) -> DataFrame:
    """Arrays of longs replaced by their running sums (inclusive), within the row.

    Sums blocks of about sqrt(n) first, so n values take n * sqrt(n) steps.
    """
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    width = lambda c: F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(c).cast("double"))).cast("int"))
    block = lambda c, i: F.floor(i / width(c)).cast("int")
    none = F.array().cast("array<bigint>")

    def of_blocks(n: str) -> Column:
        return F.when(F.size(n) > 0, F.transform(
            F.sequence(F.lit(0), block(n, F.size(n) - 1)),
            lambda b: total(F.slice(n, b * width(n) + 1, width(n))))).otherwise(none)

    def before_blocks(n: str) -> Column:
        return F.transform(f"{n}_sums", lambda _, b: total(F.slice(f"{n}_sums", F.lit(1), b)))

    def running(n: str) -> Column:
        return F.transform(n, lambda _, i: F.col(f"{n}_sums")[block(n, i)] + total(
            F.slice(n, block(n, i) * width(n) + 1, i % width(n) + 1)))

    df = stage(df, **{f"{n}_sums": of_blocks(n) for n in names})
    df = stage(df, **{f"{n}_sums": before_blocks(n) for n in names})
    df = stage(df, **{n: running(n) for n in names})
    return df.drop(*(f"{n}_sums" for n in names))


def text_rows(batches: Iterator[pa.RecordBatch], column: str | int, limit: int = BATCH_BYTES
              ) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Arrow batches cut so that their texts hold about ``limit`` bytes together
    (a longer text alone), with the texts as bytes; null gives b"".

    Only the texts of one cut are Python objects at a time, and what Arrow
    holds in reserve goes back once the task's rows are done: workers stay
    between stages, beside the executor's heap.
    """
    for batch in batches:
        col = batch.column(column).cast(pa.binary())
        start = size = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(col), 0).to_pylist()):
            if i > start and size + n > limit:
                yield batch.slice(start, i - start), [t or b"" for t in col.slice(start, i - start).to_pylist()]
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start), [t or b"" for t in col.slice(start).to_pylist()]
    batch = col = None
    pa.default_memory_pool().release_unused()


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64: spreads the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(n, np.uint64)
    out[:1] = 1
    out[1:] = np.uint64(base)
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values (van Herk's two running minima)."""
    n = len(values)
    if width <= 1 or n == 0:
        return values
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


#: Bits of the fixed-size filters below (2 MB).
FILTER_BITS = 24


def bit_filter(df: DataFrame, column: str) -> np.ndarray:
    """A bit for each value of the top bits of a column of 64-bit hashes: 2 MB
    whatever the number of rows.

    A filter only trims what is sent on; joins decide.  Bits are gathered into
    64-bit words by an aggregate that begins inside tasks, so that at most
    2 ** 18 rows reach the driver, in one job.
    """
    tops = df.select(F.shiftrightunsigned(F.col(column).cast("long"), 64 - FILTER_BITS).alias("top"))
    words = tops.select(F.shiftright("top", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(top & 63 AS int))").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out.view(np.uint8)


def top_bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = top_bits(hashes)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def positional(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named by position (_own0, _own1, ...), so that no
    name of theirs can clash with one made beside them, and where ``names`` are."""
    own = [f"_own{i}" for i in range(len(df.columns))]
    return df.toDF(*own), [own[df.columns.index(n)] for n in names]


def key_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of batches sorted by ``keys`` (64-bit integers): tables of whole groups,
    with the groups' bounds."""
    rest: list[pa.RecordBatch] = []

    def bounds(t: pa.Table) -> np.ndarray:
        change = np.zeros(max(t.num_rows - 1, 0), bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1, [t.num_rows]])

    for b in batches:
        if not b.num_rows:
            continue
        rest.append(b)
        t = pa.Table.from_batches(rest)
        at = bounds(t)
        if len(at) > 2:  # the last group may go on
            yield t.slice(0, at[-2]), at[:-1]
            rest = t.slice(at[-2]).combine_chunks().to_batches()
    if rest:
        t = pa.Table.from_batches(rest)
        yield t, bounds(t)
    b = t = rest = None
    pa.default_memory_pool().release_unused()


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counted here)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(node, root) of the nodes of ``edges`` (u, v): root is the least node of
    the component.

    Alternating large-star and small-star steps; each step is an aggregate and
    a join on the node, so that a hub's edges can be split among tasks.  The
    edges are written under spark.checkpoint.dir after each round.
    """
    cur = materialise(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                      .distinct(), tag)
    state = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        nxt = (large.join(small, "a").where("b <> m").select(F.col("m").alias("u"), F.col("b").alias("v"))
               .unionByName(small.select(F.col("m").alias("u"), F.col("a").alias("v"))).distinct())
        cur = materialise(nxt, tag)
        now = cur.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    return cur.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
        cur.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
