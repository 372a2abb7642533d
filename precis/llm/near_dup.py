"""N-gram Jaccard join: MinHash banding, verified on full n-gram sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.llm.common import (bit_filter, broadcast_if_small, components, in_filter, key_groups, materialise, mix64,
                               positional, text_rows)
from precis.llm.words import grams, within, words_of

SHINGLE = 5
HASHES = 100
#: Similarity as a fraction, compared exactly.
NUM, DEN = 4, 5
RECALL = 0.9999
_BATCH = 1 << 20
#: Members of a bucket or a component that are compared in one task, and the
#: n-grams that they may have together.
_BLOCK, _BLOCK_GRAMS = 512, 2_000_000
#: n-grams of a comparison that are sorted at a time.
_RANGE_GRAMS = 500_000
_BUCKET = 4096


def banding(hashes: int = HASHES, similarity: float = NUM / DEN, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest chance meetings, for
    which pairs of the given similarity share a band with the target recall."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - similarity ** rows) ** bands >= recall:
            return bands, rows
    return hashes, 1


BANDS, ROWS = banding()
_RNG = np.random.default_rng(42)
_A = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 64, HASHES, dtype=np.uint64)
#: Least share of equal signature bytes for pairs that go on to verification:
#: four and a half standard deviations below what pairs at the threshold have.
_AGREE = 62


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct hashes of the 5-word shingles of each text; a text of
    fewer words is one shingle, a text without words has none."""
    w = words_of(texts)
    g = grams(w.hashes, SHINGLE)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(g[a:b - SHINGLE + 1]))
        else:
            out.append(grams(w.hashes[a:b], b - a) if b > a else g[:0])
    return out


def _set_hash(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, as two sums over its elements."""
    flat = np.concatenate([*sets, np.zeros(1, np.uint64)])
    ends = np.cumsum([len(s) for s in sets])
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(flat ^ np.uint64(salt)))])
        out.append((sums[ends] - sums[np.concatenate([[0], ends[:-1]])]).view(np.int64))
    return out[0], out[1]


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, a row for each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), HASHES), np.uint64)
    step = 1 << 16
    if len(flat) > 4 * step and len(sets) == 1:  # a very long text
        for j in range(HASHES):
            out[0, j] = min((flat[i:i + step] * _A[j] + _B[j]).min() for i in range(0, len(flat), step))
        return out
    for j in range(HASHES):
        out[:, j] = np.minimum.reduceat(flat * _A[j] + _B[j], starts)
    return out


def _sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, n, s1, s2, sig, bands): th hashes the text, s1 and s2 the set."""
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"),
                      F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _A[:ROWS]
        for batch, texts in text_rows(batches, "text", _BATCH):
            sets = shingle_sets(texts)
            n = np.array([len(s) for s in sets])
            s1, s2 = _set_hash(sets)
            full = np.flatnonzero(n)
            sig = np.zeros((len(sets), HASHES), np.uint8)
            bands = np.zeros((len(sets), BANDS), np.int64)
            if len(full):
                m = _signatures([sets[i] for i in full])
                sig[full] = (mix64(m) >> np.uint64(56)).astype(np.uint8)
                parts = m[:, :BANDS * ROWS].reshape(len(full), BANDS, ROWS)
                bands[full] = mix64((mix64(parts) * weights).sum(axis=2, dtype=np.uint64)
                                    + np.arange(BANDS, dtype=np.uint64) * _A[-1]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("th"), pa.array(n, pa.int32()), pa.array(s1), pa.array(s2),
                 pa.array([r.tobytes() for r in sig], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))],
                names=["id", "th", "n", "s1", "s2", "sig", "bands"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, th bigint, n int, s1 bigint, s2 bigint, sig binary, bands array<bigint>")


def _in_blocks(df: DataFrame, key: str, blocks: str) -> DataFrame:
    """Rows dealt to pairs of blocks (bi <= bj) of their group: each row goes to
    ``blocks`` pairs, so that all pairs of a group meet, in tasks of two blocks."""
    df = df.withColumn("b", F.pmod(F.xxhash64("cid"), F.col(blocks)).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    df = df.withColumn("bi", F.least("b", "other").cast("long")).withColumn("bj", F.greatest("b", "other").cast("long"))
    df = df.drop("other", blocks)
    return df.repartition(key, "bi", "bj").sortWithinPartitions(key, "bi", "bj", "cid")


def _similar_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group, edges that span the components of the graph whose edges
    are pairs with enough equal signature bytes: fewer edges than members."""
    for t, at in key_groups(batches, ["bucket", "bi", "bj"]):
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(t.num_rows, HASHES)
        cid = t.column("cid").to_numpy()
        size = np.diff(at)
        u, v = [], []
        two = at[:-1][size == 2]
        ok = (sig[two] == sig[two + 1]).sum(axis=1) >= _AGREE
        u.append(cid[two[ok]])
        v.append(cid[two[ok] + 1])
        for a, n in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist()):
            left = np.arange(a, a + n)
            while len(left) > 1:
                queue, left = [left[0]], left[1:]
                root = cid[queue[0]]
                while queue and len(left):
                    near = (sig[left] == sig[queue.pop()]).sum(axis=1) >= _AGREE
                    if near.any():
                        queue += left[near].tolist()
                        u.append(np.full(near.sum(), root))
                        v.append(cid[left[near]])
                        left = left[~near]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a group's sorted sets (two different ones), summed
    over ranges of hashes, so that what is sorted at a time stays small."""
    n = len(sets)
    out = np.zeros((n, n))
    ranges = 1 + sum(map(len, sets)) // _RANGE_GRAMS
    bounds = np.arange(1, ranges, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // ranges)
    cuts = [np.concatenate([[0], np.searchsorted(s, bounds), [len(s)]]) for s in sets]
    for r in range(ranges):
        parts = [s[c[r]:c[r + 1]] for s, c in zip(sets, cuts)]
        flat = np.concatenate(parts)
        if not len(flat):
            continue
        owner = np.repeat(np.arange(n), [len(p) for p in parts])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]])
        column = np.cumsum(new) - 1
        shared = np.bincount(column)[column] > 1  # an element of one set is in no intersection
        owner, column = owner[shared], column[shared]
        _, column = np.unique(column, return_inverse=True)
        step = 4096
        for a in range(0, (column[-1] + 1) if len(column) else 0, step):
            lo, hi = np.searchsorted(column, [a, a + step])
            m = np.zeros((n, step), np.float32)
            m[owner[lo:hi], column[lo:hi] - a] = 1
            out += m @ m.T
    return out.astype(np.int64)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each member of a pair of blocks: the number of rows it is linked to
    there, and the least member of its component there."""
    for t, at in key_groups(batches, ["comp", "bi", "bj"]):
        cid, size, block = (t.column(c).to_numpy() for c in ("cid", "size", "b"))
        raw = t.column("set")
        bi, bj = t.column("bi").to_numpy(), t.column("bj").to_numpy()
        links = np.zeros(t.num_rows, np.int64)
        root = cid.copy()
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a < 2:
                continue
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in raw.slice(a, b - a)]
            n = np.array([len(s) for s in sets])
            both = _common(sets)
            near = DEN * both >= NUM * (n[:, None] + n[None, :] - both)
            np.fill_diagonal(near, False)
            if bi[a] != bj[a]:  # pairs within a block are counted where it meets itself
                near &= block[a:b, None] != block[None, a:b]
            links[a:b] = near @ size[a:b]
            least = cid[a:b].copy()
            while True:  # least member reached, one step further each time
                step = np.minimum(least, np.where(near, least[None, :], np.iinfo(np.int64).max).min(axis=1))
                if (step == least).all():
                    break
                least = step
            root[a:b] = least
        yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(links), pa.array(root)], names=["cid", "links", "root"])


def _sets_of(docs: DataFrame, id_col: str, text_col: str, bits: np.ndarray) -> DataFrame:
    """(s1, s2, n, set) of the documents whose (id, text hash) may be wanted."""
    th = F.xxhash64(text_col)
    src = docs.select(F.xxhash64(F.col(id_col), th).alias("row"), F.col(text_col).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_numpy().view(np.uint64)
            for _, texts in text_rows(iter([batch.filter(pa.array(in_filter(shared.value, rows)))]), "text", _BATCH):
                sets = shingle_sets(texts)
                s1, s2 = _set_hash(sets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s1), pa.array(s2), pa.array([len(s) for s in sets], pa.int32()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], names=["s1", "s2", "n", "set"])

    return src.mapInArrow(run, "s1 bigint, s2 bigint, n int, set binary")


def _linked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Signed rows with a row id, and the classes of rows with equal n-gram sets
    with their links and group."""
    signed = materialise(_sign(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "signed")
    classes = materialise(signed.where("n > 0").groupBy("s1", "s2", "n").agg(
        F.min("rid").alias("cid"), F.min("id").alias("class_id"), F.count("*").alias("size")), "classes")
    reps = signed.join(classes.select("cid", "size"), F.col("rid") == F.col("cid"))
    banded = reps.select("cid", F.explode("bands").alias("bucket"))
    shared = (banded.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
              .withColumn("blocks", F.ceil(F.col("m") / _BUCKET).cast("long")).drop("m"))
    members = (banded.join(shared, "bucket")
               .join(signed.select(F.col("rid").alias("cid"), "sig"), "cid"))
    edges = _in_blocks(members, "bucket", "blocks").select("bucket", "bi", "bj", "cid", "sig").mapInArrow(
        _similar_edges, "u bigint, v bigint")
    comps = components(edges, "similar")
    sized = comps.withColumnRenamed("node", "cid").withColumnRenamed("root", "comp").join(
        reps.select("cid", "size", "id", "th", "n", "s1", "s2"), "cid")
    sized = materialise(sized, "candidates")
    blocks = sized.groupBy("comp").agg(F.greatest(
        F.ceil(F.count("*") / _BLOCK), F.ceil(F.sum("n") / _BLOCK_GRAMS)).cast("long").alias("blocks"))
    bits = bit_filter(sized.select(F.xxhash64("id", "th").alias("row")), "row")
    sets = _sets_of(docs, id_col, text_col, bits).dropDuplicates(["s1", "s2", "n"])
    paired = _in_blocks(sized.join(blocks, "comp").join(sets, ["s1", "s2", "n"])
                        .select("comp", "cid", "size", "set", "blocks"), "comp", "blocks")
    verified = materialise(paired.select("comp", "bi", "bj", "b", "cid", "size", "set").mapInArrow(
        _verified, "cid bigint, links bigint, root bigint"), "verified")
    links = verified.groupBy("cid").agg(F.sum("links").alias("links"))
    groups = components(verified.select(F.col("root").alias("u"), F.col("cid").alias("v")), "linked")
    named = (classes.join(links, "cid", "left").join(groups.withColumnRenamed("node", "cid"), "cid", "left")
             .select("s1", "s2", "n", "cid", "class_id", "size", F.coalesce("links", F.lit(0)).alias("links"),
                     F.coalesce("root", "cid").alias("root")))
    return signed, named


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_links, group_id, n_shingles): one row for each document.

    Documents with equal sets of 5-word shingles are one class, named by its
    least id.  n_links counts the other documents with a Jaccard similarity of
    at least 0.8 (all of the class, and all of each linked class); group_id is
    the least id that links lead to.

    MinHash signatures are cut into bands by the target recall; representatives
    of classes that share a band meet in their bucket, large buckets in pairs
    of blocks.  There, pairs whose signatures agree well enough only have to be
    connected, so a bucket gives fewer edges than members.  The full sets of a
    component are then compared pair by pair inside tasks, again in pairs of
    blocks, and only counts leave the task.

    Texts of 1 to 4 words are one shingle.  Null and empty texts, and texts
    without words, have no shingles: they are classes of their own, without
    links.  Null ids stay null; rows with equal ids are told apart by their
    position.  An empty table gives an empty one; other columns are not read.
    """
    signed, named = _linked(docs, id_col, text_col)
    # written first, so that the join's sides are plain exchanges and a large group can be split
    groups = materialise(named.groupBy("root").agg(F.min("class_id").alias("group_id")), "groups")
    named = named.join(groups, "root").select("s1", "s2", "n", "class_id", "size", "links", "group_id")
    return signed.select("id", "s1", "s2", "n").join(named, ["s1", "s2", "n"], "left").select(
        F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce(F.col("size") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("group_id", "id").alias("group_id"), F.col("n").cast("long").alias("n_shingles"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the near copies: of each group of linked documents the
    row with the least id (then the least text hash) stays, all columns kept,
    whatever their names.  Rows with null ids go last in a group; of repeated
    rows one stays.  Texts without words (null and empty ones among them) have
    no copies and stay; an empty table gives an empty one."""
    signed, named = _linked(docs, id_col, text_col)
    rows = signed.where("n > 0").select("id", "th", "rid", "s1", "s2", "n").join(
        named.select("s1", "s2", "n", "root"), ["s1", "s2", "n"])
    first = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "th", "rid"))
    # written first, so that the join's sides are plain exchanges and a large group can be split
    best = materialise(rows.groupBy("root").agg(first.alias("best"), F.count("*").alias("rows")).where("rows > 1"), "best")
    marked = rows.join(best, "root").withColumn("stays", F.col("rid") == F.col("best.rid"))
    keys = materialise(marked.groupBy(F.col("id").alias("_copy_id"), F.col("th").alias("_copy_th")).agg(
        F.max("stays").alias("_copy_stays"), F.count("*").alias("_copy_rows")).where("not _copy_stays or _copy_rows > 1"), "copies")
    rows, (own_id, own_text) = positional(docs, id_col, text_col)
    match = F.col(own_id).eqNullSafe(F.col("_copy_id")) & (F.xxhash64(own_text) == F.col("_copy_th"))
    out = rows.join(broadcast_if_small(keys, 200_000), match, "left_anti")
    repeated = keys.where("_copy_stays")  # the row that stays has equal rows: take one of them
    if not repeated.isEmpty():
        out = out.unionByName(rows.join(repeated, match).dropDuplicates(["_copy_id", "_copy_th"]).select(*rows.columns))
    return out.toDF(*docs.columns)
