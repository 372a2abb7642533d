"""Removal of byte strings that occur more than once in a corpus, by column-wise
construction over many documents.

The construction inserts one symbol of every string a round, from right to
left, and keeps two things up to date: the order of the strings by what has
been inserted so far (the rows of the collection's Burrows-Wheeler transform
that belong to the round) and the length of the common prefix of neighbours.
A string of ``LENGTH`` bytes is repeated where a neighbour's common prefix
reaches ``LENGTH``.

To spread this over tasks, only strings that can hold a match meet, and they
meet aligned.  Every window of LENGTH bytes is named by the least hash of its
k-grams (its anchor), which depends on the window's bytes alone: equal windows
have equal anchors at equal distances.  So the windows of one anchor make a
run, and runs with equal anchor hashes, aligned at the anchor, are the
collection of one construction; equal windows begin in the same column, that
is, they are inserted in the same round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.llm.common import (bit_filter, broadcast_if_small, discard, in_filter, key_groups, materialise, mix64, powers,
                               text_rows, window_min)
from precis.llm.shared_words import shared_words

LENGTH = 400
_GRAM = 100
_SPAN = LENGTH - _GRAM  # an anchor lies 0 to _SPAN bytes behind its window's start
_BATCH = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_CODES = np.random.default_rng(23).integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_POW = [powers(b, _BATCH + LENGTH) for b in _BASES]
_INV = [powers(pow(b, -1, 1 << 64), _BATCH + LENGTH) for b in _BASES]
_PLACE = np.uint64((1 << 21) - 1)  # low bits that hold a place; _BATCH + LENGTH is less

#: Strings of one construction, and of one batch of small ones.
GROUP_LIMIT = 50_000
_GROUPED = 8192

_RUN = [("fp", pa.int64()), ("g1", pa.int64()), ("g2", pa.int64()), ("pos", pa.int64()), ("w", pa.int32()),
        ("rel", pa.int32())]
_RUN_SQL = "fp bigint, g1 bigint, g2 bigint, pos bigint, w int, rel int"


def _runs(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: (start, windows, anchor - start,
    anchor hash, two hashes of the run's bytes) in ``data``; windows do not
    cross ``bounds``."""
    out: list[list[np.ndarray]] = [[] for _ in range(6)]
    every = np.frombuffer(data, np.uint8)
    for at in range(0, max(len(every) - LENGTH + 1, 0), _BATCH):
        part = every[at:at + _BATCH + LENGTH - 1]
        n = len(part)
        sums = []
        for codes, pow_ in zip(_CODES, _POW):
            s = np.zeros(n + 1, np.uint64)
            np.cumsum(codes[part] * pow_[:n], out=s[1:])
            sums.append(s)
        grams = mix64((sums[0][_GRAM:] - sums[0][:-_GRAM]) * _INV[0][:n - _GRAM + 1])
        # equal hashes: the last place counts, whatever the window's place is
        ranked = (grams & ~_PLACE) | (_PLACE - np.arange(len(grams), dtype=np.uint64))
        anchor = (_PLACE - (window_min(ranked, _SPAN + 1) & _PLACE)).astype(np.int64)
        starts = np.arange(len(anchor))
        owner = np.searchsorted(bounds, starts + at, "right")
        ok = starts + at + LENGTH <= bounds[np.minimum(owner, len(bounds) - 1)]
        starts, anchor, owner = starts[ok], anchor[ok], owner[ok]
        if not len(starts):
            continue
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
        first = np.flatnonzero(new)
        count = np.diff(np.concatenate([first, [len(starts)]]))
        s, a = starts[first], anchor[first]
        e = s + count - 1 + LENGTH
        shape = ((e - s) << 12 | (a - s)).astype(np.uint64)
        hashes = [mix64((p[e] - p[s]) * inv[s] + shape) for p, inv in zip(sums, _INV)]
        for o, x in zip(out, (s + at, count, a - s, grams[a], *hashes)):
            o.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    return b"".join(texts), np.cumsum([len(t) for t in texts])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text as bytes (null as empty) and a key of two hashes; rows with equal
    keys have equal texts, so they may share what is found."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.lit(1)).alias("kd"),
                       F.xxhash64(text, F.lit(2)).alias("kt"), text.alias("text"))


def _listed(keyed: DataFrame) -> DataFrame:
    """(kd, kt, runs) of each document that has windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_rows(batches, "text", _BATCH):
            data, bounds = _joined(texts)
            s, w, rel, fp, g1, g2 = _runs(data, bounds)
            starts = np.concatenate([[0], bounds])
            owner = np.searchsorted(bounds, s, "right")
            runs = pa.StructArray.from_arrays(
                [pa.array(fp.view(np.int64)), pa.array(g1.view(np.int64)), pa.array(g2.view(np.int64)),
                 pa.array(s - starts[owner], pa.int64()), pa.array(w, pa.int32()), pa.array(rel, pa.int32())],
                fields=[pa.field(*f) for f in _RUN])
            offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("kd"), batch.column("kt"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)],
                names=["kd", "kt", "runs"])

    sql = _RUN_SQL.replace(" ", ":").replace(",:", ",")
    return keyed.select("kd", "kt", "text").mapInArrow(run, f"kd bigint, kt bigint, runs array<struct<{sql}>>")


def _place_hash(kd: np.ndarray, kt: np.ndarray, pos: np.ndarray) -> np.ndarray:
    c = _CODES[0]
    return mix64(kd.view(np.uint64) * (c[0] | np.uint64(1)) + kt.view(np.uint64) * (c[1] | np.uint64(1))
                 + pos.view(np.uint64) * (c[2] | np.uint64(1)))


def _hashed_places(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = _place_hash(*(b.column(c).to_numpy() for c in ("kd", "kt", "pos")))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return df.select("kd", "kt", "pos").mapInArrow(run, "h bigint")


_STRING_SQL = "key bigint, kd bigint, kt bigint, anchor bigint, lo int, hi int, seg binary"


def _strings(keyed: DataFrame, bits: np.ndarray) -> DataFrame:
    """The runs whose place may be wanted, with their bytes: windows begin at
    lo to hi from the anchor, ``seg`` begins at lo."""
    shared = keyed.sparkSession.sparkContext.broadcast(bits)  # 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_rows(batches, "text", _BATCH):
            data, bounds = _joined(texts)
            s, w, rel, fp, _, _ = _runs(data, bounds)
            if not len(s):
                continue
            owner = np.searchsorted(bounds, s, "right")
            kd, kt = (batch.column(c).to_numpy()[owner] for c in ("kd", "kt"))
            pos = s - np.concatenate([[0], bounds])[owner]
            ok = np.flatnonzero(in_filter(shared.value, _place_hash(kd, kt, pos)))
            seg = [data[a:b] for a, b in zip(s[ok].tolist(), (s[ok] + w[ok] - 1 + LENGTH).tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(fp[ok].view(np.int64)), pa.array(kd[ok]), pa.array(kt[ok]), pa.array((pos + rel)[ok], pa.int64()),
                 pa.array(-rel[ok], pa.int32()), pa.array((w - 1 - rel)[ok], pa.int32()), pa.array(seg, pa.binary())],
                names=["key", "kd", "kt", "anchor", "lo", "hi", "seg"])

    return keyed.select("kd", "kt", "text").mapInArrow(run, _STRING_SQL)


def _construct(symbols: np.ndarray, group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Insert the columns of ``symbols`` (a row for each place from -_SPAN on, -1
    where a string has no byte) from the last to the first; returns for each
    start from -_SPAN to 0 and each string whether its window is repeated.

    A round sorts the strings of each group by their new symbol, stably on the
    order so far.  Neighbours with one symbol had all strings between them in
    the last order, so their common prefix is one more than the least there.
    """
    n = symbols.shape[1]
    order = np.argsort(group, kind="stable")
    group = group[order].astype(np.uint16)  # the same in every round
    one = group[1:] == group[:-1]
    common = np.zeros(n + 1, np.int16)
    found = np.zeros((_SPAN + 1, n), bool)
    for column in range(len(symbols) - 1, -1, -1):
        new = symbols[column][order]
        by = np.argsort((new + 1).astype(np.uint16), kind="stable")
        by = by[np.argsort(group[by], kind="stable")]
        new, a, b = new[by], by[:-1], by[1:]
        same = np.flatnonzero((new[1:] == new[:-1]) & (new[1:] >= 0) & one)
        nxt = np.zeros(n + 1, np.int16)
        if len(same):
            bounds = np.empty(2 * len(same), np.int64)
            bounds[0::2] = a[same] + 1
            bounds[1::2] = b[same] + 1
            nxt[same + 1] = np.minimum(np.minimum.reduceat(common, bounds)[0::2] + 1, LENGTH)
        order, common = order[by], nxt
        if column <= _SPAN:
            at = np.flatnonzero(common[:n] >= LENGTH)
            if len(at):
                found[column, order[at]] = True
                found[column, order[at - 1]] = True
    start = np.arange(-_SPAN, 1)[:, None]
    return found & (start >= lo) & (start <= hi)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of strings sorted by key: (kd, kt, s, e) spans covered by repeated windows."""
    for t, at in key_groups(batches, ["key"]):
        size = np.diff(at)
        lo, hi, anchor = (t.column(c).to_numpy() for c in ("lo", "hi", "anchor"))
        kd, kt, seg = t.column("kd").to_numpy(), t.column("kt").to_numpy(), t.column("seg").combine_chunks()
        row, start, end = [], [], []
        several = np.flatnonzero(size > 1)
        taken = 0
        while taken < len(several):
            total = np.cumsum(size[several[taken:taken + 60_000]])
            use = several[taken:taken + max(1, int(np.searchsorted(total, _GROUPED, "right")))]
            taken += len(use)
            rows = np.concatenate([np.arange(at[g], at[g + 1]) for g in use])
            group = np.repeat(np.arange(len(use)), size[use])
            parts = [x.as_py() for x in seg.take(pa.array(rows))]
            n = np.array([len(p) for p in parts])
            flat = np.frombuffer(b"".join(parts), np.uint8)
            column = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n - (lo[rows] + _SPAN), n)
            symbols = np.full((_SPAN + LENGTH, len(rows)), -1, np.int16)
            symbols[column, np.repeat(np.arange(len(rows)), n)] = flat
            found = _construct(symbols, group, lo[rows], hi[rows])
            edge = np.diff(np.pad(found, ((1, 1), (0, 0))).astype(np.int8), axis=0)
            which, first = np.nonzero(edge.T == 1)
            _, last = np.nonzero(edge.T == -1)
            row.append(rows[which])
            start.append(anchor[rows[which]] + first - _SPAN)
            end.append(anchor[rows[which]] + last - 1 - _SPAN + LENGTH)
        if row:
            row, start, end = map(np.concatenate, (row, start, end))
            yield pa.RecordBatch.from_arrays(
                [pa.array(kd[row]), pa.array(kt[row]), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                names=["kd", "kt", "s", "e"])


_SPANS_SQL = "kd bigint, kt bigint, s bigint, e bigint"


def _halved(blocks: int):
    """Cut strings into those of the windows that begin in each of ``blocks``
    aligned blocks of starts; the new key adds the bytes that all windows of the
    block share."""
    width = 512 // blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, kd, kt, anchor, lo, hi, seg in zip(*(b.column(i).to_pylist() for i in range(7))):
                for block in range((lo + _SPAN) // width, (hi + _SPAN) // width + 1):
                    first, last = block * width - _SPAN, (block + 1) * width - 1 - _SPAN
                    shared = seg[last - lo:first - lo + LENGTH]
                    h = hashlib.blake2b(shared, digest_size=8, key=key.to_bytes(8, "little", signed=True),
                                        salt=block.to_bytes(2, "little")).digest()
                    x, y = max(lo, first), min(hi, last)
                    out.append((int.from_bytes(h, "little", signed=True), kd, kt, anchor, x, y, seg[x - lo:y - lo + LENGTH]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, (
                    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                names=["key", "kd", "kt", "anchor", "lo", "hi", "seg"])

    return run


def _split_hot(strings: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Strings of which no key has more than ``limit``, and spans found on the way.

    The windows of an overfull key are cut into aligned halves by where they
    begin, again and again.  All windows of a block share its middle bytes, so
    strings that differ there part; strings that become equal are repeated as a
    whole, and one of them stays for the others.  A block of one start has
    equal strings only, so this ends with the ninth cut.
    """
    spans: DataFrame | None = None
    done: DataFrame | None = None
    rows, blocks = materialise(strings, "hot-strings"), 1
    while True:
        hot = rows.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > limit).select("key")
        hot = materialise(hot, "hot-keys")
        if hot.isEmpty():
            return (rows if done is None else done.unionByName(rows)), spans
        cold = rows.join(hot, "key", "left_anti")
        done = cold if done is None else done.unionByName(cold)
        blocks *= 2
        cut = rows.join(hot, "key", "left_semi").select(*rows.columns).mapInArrow(_halved(blocks), _STRING_SQL)
        same = ["key", "lo", "hi", "h1", "h2"]
        cut = materialise(cut.withColumn("h1", F.xxhash64("seg")).withColumn("h2", F.xxhash64("seg", F.lit(3))), "halved")
        several = cut.groupBy(*same).agg(F.count("*").alias("copies")).where("copies > 1")
        found = cut.join(several, same).select("kd", "kt", (F.col("anchor") + F.col("lo")).alias("s"),
                                               (F.col("anchor") + F.col("hi") + LENGTH).alias("e"))
        spans = found if spans is None else spans.unionByName(found)
        rows = materialise(cut.groupBy(*same).agg(F.min(F.struct("kd", "kt", "anchor", "seg")).alias("one"))
                           .select("key", "one.kd", "one.kt", "one.anchor", "lo", "hi", "one.seg"), "halves")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   limit: int = GROUP_LIMIT) -> DataFrame:
    """(kd, kt, spans): for documents with repeated strings, the byte spans that
    windows of them cover; spans may overlap.

    Runs with a unique anchor hash hold no match.  Runs with equal bytes are
    classes: a class of several is repeated as a whole.  One run of each class
    of an anchor with several classes goes to a construction.
    """
    keyed = _keyed(docs, id_col, text_col)
    listed = materialise(_listed(keyed), "runs")
    runs = listed.select("kd", "kt", F.inline("runs"))
    # written first, so that the join's sides are plain exchanges and a hash with many runs can be split
    again = materialise(runs.groupBy("fp").agg(F.count("*").alias("m")).where("m > 1").select("fp"), "again")
    met = materialise(runs.join(again, "fp"), "met")
    discard(listed, again)
    classes = materialise(met.groupBy("fp", "g1", "g2").agg(F.count("*").alias("n"), F.min(F.struct(
        "kd", "kt", "pos")).alias("one")), "classes")
    whole = met.join(classes.where("n > 1").select("fp", "g1", "g2"), ["fp", "g1", "g2"]).select(
        "kd", "kt", F.col("pos").alias("s"), (F.col("pos") + F.col("w") - 1 + LENGTH).alias("e"))
    mixed = classes.groupBy("fp").agg(F.count("*").alias("m")).where("m > 1")
    wanted = classes.join(mixed, "fp").select("fp", "m", "one.kd", "one.kt", "one.pos")
    wanted = materialise(wanted, "wanted")
    strings = _strings(keyed, bit_filter(_hashed_places(wanted), "h"))
    hot = wanted.where(F.col("m") > limit).select(F.col("fp").alias("key")).distinct()
    extra = None
    if not hot.isEmpty():
        split, extra = _split_hot(strings.join(broadcast_if_small(hot, 100_000), "key", "left_semi"), limit)
        strings = strings.join(broadcast_if_small(hot, 100_000), "key", "left_anti").select(*split.columns).unionByName(split)
    partly = strings.repartition("key").sortWithinPartitions("key").select(
        *(f.split()[0] for f in _STRING_SQL.split(", "))).mapInArrow(_repeated, _SPANS_SQL)
    spans = whole.unionByName(partly)
    if extra is not None:
        spans = spans.unionByName(extra)
    return spans.groupBy("kd", "kt").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = GROUP_LIMIT,
                   with_kept: bool = False, with_shared: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every document, and the
    kept bytes if asked for; with ``with_shared`` also n_shared_words.

    Every byte is removed that a string of 400 bytes covers which also starts
    anywhere else, in the same or another document, overlaps included; strings
    are judged on the input.  Matches never cross documents.

    Null and empty texts have no bytes; texts under 400 bytes lose none.  Equal
    rows are occurrences of their own, so repeated long texts go whole.  Null
    ids stay null; an empty table gives an empty one; other columns are not
    read.  Runs are compared by 128-bit fingerprints where their bytes are not.

    n_shared_words (long) tells of passages that repeat across documents but
    may be shorter than 400 bytes: the words inside runs of 51 words that
    another document holds too.  They are not removed; rows with equal ids and
    texts are one document in this.
    """
    keyed = _keyed(docs, id_col, text_col)
    spans = repeated_spans(docs, id_col, text_col, limit)
    shared = F.lit(None).cast("long")
    if with_shared:
        passages = shared_words(keyed).withColumnRenamed("n_shared_words", "shared")
        # 16 bytes a key and a number: both go to the texts in one join
        spans = spans.join(passages, ["kd", "kt"], "full")
        shared = F.coalesce("shared", F.lit(0).cast("long"))
    rows = keyed.join(spans, ["kd", "kt"], "left").select("id", "text", "spans", shared.alias("shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_rows(batches, "text", _BATCH):
            out: list[list] = [[] for _ in range(5)]
            for text, found in zip(texts, batch.column("spans").to_pylist()):
                merged: list[list[int]] = []
                for x in sorted((x["s"], x["e"]) for x in found or ()):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append(list(x))
                edges = [0, *(p for m in merged for p in m), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                for o, v in zip(out, (len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(),
                                      kept if with_kept else None)):
                    o.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(o, t) for o, t in zip(
                    out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))), batch.column("shared")],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "shared"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, shared bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256",
                      *(["kept"] if with_kept else []), *([F.col("shared").alias("n_shared_words")] if with_shared else []))
