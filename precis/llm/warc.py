"""WARC archives: written with revisit records, and read back by verifying the
chain of record boundaries."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from precis.llm.common import bit_filter, broadcast_if_small, discard, in_filter, key_groups, materialise, text_rows
from precis.session import ensure_checkpoint_dir

MAGIC = b"WARC/1.0\r\n"
END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
#: Bytes of an archive by which records cut by the end of a split meet what their payloads span.
_CELL = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, page: str | None, url: str | None, digest: str, n: int, refers_to: str | None, payload: bytes) -> str:
    name = lambda p: f"<urn:page:{quote(p, safe='') if p is not None else ''}>"
    block = _HTTP % n + (payload if kind == "response" else b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {n}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return MAGIC.decode() + "\r\n".join(head) + END.decode() + block.decode("utf-8", "replace")


def _first_bits(digest: str) -> int:
    """The first 64 bits of a digest, signed."""
    return int.from_bytes(base64.b32decode(digest)[:8], "big", signed=True)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least: int = 0) -> None:
    """Write a record for each row, in as many files as there are tasks.

    Of rows with equal payloads of at least ``least`` bytes, the one with the
    largest id is a response and the others are revisits that refer to it.
    Digests are counted first.  A filter of fixed size over those that repeat
    then tells which rows cannot be among them: these are written where they
    are read.  The others travel, compressed, to where they meet the largest id.
    """
    src = pages.select(F.col(id_col).cast("string").alias("page"), F.col(id_col).alias("id"),
                       F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("binary").alias("html"))
    kind = src.schema["id"].dataType.simpleString()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_rows(batches, "html"):
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([payload_digest(t) for t in texts]), pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "digest", "n"])

    last = src.select("id", "html").mapInArrow(digests, f"id {kind}, digest string, n bigint").groupBy("digest", "n").agg(
        F.max("id").alias("last"), F.count("*").alias("m")).where((F.col("m") > 1) & (F.col("n") >= least))
    last = materialise(last.select("digest", "n", "last"), "warc-repeats")

    def first_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(_first_bits, b.column(0).to_pylist()), pa.int64())], names=["h"])

    bits = bit_filter(last.select("digest").mapInArrow(first_bits, "h bigint"), "h")
    shared = pages.sparkSession.sparkContext.broadcast(bits)  # 2 MB

    def rows_of(repeats: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pack = zstandard.ZstdCompressor(level=3).compress
            for batch, texts in text_rows(batches, "html"):
                found = [payload_digest(t) for t in texts]
                maybe = in_filter(shared.value, np.array([_first_bits(d) for d in found], np.int64).view(np.uint64))
                take = np.flatnonzero(maybe == repeats)
                if not len(take):
                    continue
                page, id_, url = (batch.column(c).take(pa.array(take)) for c in ("page", "id", "url"))
                if repeats:
                    yield pa.RecordBatch.from_arrays(
                        [page, id_, url, pa.array([found[i] for i in take]), pa.array([len(texts[i]) for i in take], pa.int64()),
                         pa.array([pack(texts[i]) for i in take], pa.binary())],
                        names=["page", "id", "url", "digest", "n", "packed"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([
                        _record("response", p, u, found[i], len(texts[i]), None, texts[i])
                        for i, p, u in zip(take, page.to_pylist(), url.to_pylist())], pa.string())], names=["value"])

        return run

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("kind", "page", "url", "digest", "n", "last", "packed")]
            out, size = [], 0
            for k, page, url, d, n, last_, packed in zip(*cols):
                out.append(_record(k, page, url, d, n, last_, unpack(packed) if k == "response" else b""))
                size += len(out[-1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out)], names=["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    single = src.mapInArrow(rows_of(False), "value string")
    met = src.mapInArrow(rows_of(True), f"page string, id {kind}, url string, digest string, n bigint, packed binary").join(
        last, ["digest", "n"], "left")
    met = met.withColumn("kind", F.when(F.col("last").isNull() | F.col("id").eqNullSafe(F.col("last")), "response")
                         .otherwise("revisit"))
    met = met.select("kind", "page", "url", "digest", "n", F.col("last").cast("string").alias("last"), "packed")
    single.unionByName(met.mapInArrow(build, "value string")).write.option("lineSep", END.decode()).text(path)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magic strings, in order within each split of a file."""
    return spark.read.option("lineSep", MAGIC.decode()).text(path).select(
        F.col("value").cast("binary").alias("value"), F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bool, int, bytes]]:
    """(file, block, begins, place, chunk): chunks with their place behind the
    start of the split's first chunk; ``begins`` marks the first one of a split."""
    at, place = None, 0
    for batch in batches:
        for value, file, block in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block"))):
            begins = (file, block) != at
            if begins:
                at, place = (file, block), 0
            yield file, block, begins, place, value or b""
            place += len(value or b"") + len(MAGIC)


_FIELDS = [("file", pa.int64()), ("block", pa.int64()), ("place", pa.int64()), ("end", pa.int64()), ("next", pa.int64()),
           ("leaves", pa.int64()), ("complete", pa.bool_()), ("kind", pa.string()), ("page", pa.string()),
           ("refers_to", pa.string()), ("stated", pa.string()), ("n", pa.int64()), ("digest", pa.string())]
_SQL = ("file bigint, block bigint, place bigint, end bigint, next bigint, leaves bigint, complete boolean, kind string, "
        "page string, refers_to string, stated string, n bigint, digest string")


def _headers(chunk: bytes) -> tuple[dict[bytes, bytes], int] | None:
    """Header fields and the length of the header with its blank line."""
    end = chunk.find(END)
    if end < 0:
        return None
    fields = {}
    for line in chunk[:end].split(b"\r\n"):
        name, sep, value = line.partition(b":")
        if not sep:
            return None
        fields[name.strip().lower()] = value.strip()
    return fields, end + len(END)


def _page(value: bytes | None) -> str | None:
    m = re.fullmatch(rb"<urn:page:(.*)>", value or b"")
    return unquote(m[1].decode()) if m and m[1] else None


class _Open:
    """A candidate whose payload is still being read."""

    def __init__(self, row: dict, left: int):
        self.row, self.left, self.sha, self.n = row, left, hashlib.sha1(), 0

    def take(self, data: bytes) -> bool:
        part = data[:self.left]
        self.sha.update(part)
        self.n += len(part)
        self.left -= len(part)
        if not self.left:
            self.row |= {"n": self.n, "digest": base64.b32encode(self.sha.digest()).decode(), "complete": True}
        return not self.left


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each magic string with its record's successor, both as places
    in the split, and for each split a row for where it ends.

    ``leaves`` is the first place behind the split's last magic string that the
    chain from the candidate reaches, or -1 if it breaks off before.
    """
    def done(rows: list[dict]) -> pa.RecordBatch:
        known = {r["place"]: r for r in rows if r["kind"] != "start"}
        last = max(known, default=-1)
        for r in sorted(known.values(), key=lambda r: -r["place"]):
            to = r["next"]
            r["leaves"] = known[to]["leaves"] if to in known and to > r["place"] else to if to > last else -1
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema(_FIELDS))

    rows: list[dict] = []
    waiting: list[_Open] = []
    for file, block, begins, place, chunk in _splits(batches):
        if begins and rows:
            yield done(rows)
        if begins:
            rows, waiting = [], []
        row = dict.fromkeys((f for f, _ in _FIELDS)) | {
            "file": file, "block": block, "place": place - len(MAGIC), "end": place + len(chunk) + len(MAGIC), "next": -1,
            "leaves": -1, "complete": False}
        rows.append(row)
        waiting = [w for w in waiting if not w.take(MAGIC + chunk)]
        if begins and block == 0:
            row["kind"] = "start"  # what stands before the first magic string
            continue
        row["kind"] = ""
        head = _headers(chunk)
        size = head and re.fullmatch(rb"[0-9]{1,18}", head[0].get(b"content-length", b""))
        if not size:
            continue
        fields, body = head
        length = int(size[0])
        row |= {"next": place + body + length + len(END), "kind": fields.get(b"warc-type", b"").decode("utf-8", "replace"),
                "page": _page(fields.get(b"warc-record-id")), "refers_to": _page(fields.get(b"warc-refers-to")),
                "stated": fields.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha1:")}
        if row["kind"] == "revisit":
            row |= {"n": int(fields.get(b"warc-payload-length", b"0")), "digest": row["stated"], "complete": True}
            continue
        http = chunk.find(END, body, body + length)
        skip = http + len(END) - body if http >= 0 else 0
        one = _Open(row, length - skip)
        if not one.take(chunk[body + skip:]):
            waiting.append(one)
    if rows:
        yield done(rows)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split, the candidates on the chain from its entries."""
    for t, at in key_groups(batches, ["file", "block"]):
        place, nxt, entry = (t.column(c).to_numpy(zero_copy_only=False) for c in ("place", "next", "entry"))
        keep = np.zeros(t.num_rows, bool)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            row = {p: i for i, p in enumerate(place[a:b].tolist(), a)}
            for i in np.flatnonzero(entry[a:b]) + a:
                while i is not None and not keep[i]:
                    keep[i] = True
                    i = row.get(int(nxt[i]))
        for b in t.filter(pa.array(keep)).to_batches():
            yield b


def reachable(spark: SparkSession, path: str) -> DataFrame:
    """Records on the chain of boundaries from the start of each file.

    Each task lists the magic strings of its splits with their records'
    successors, and follows them to where they leave the split.  Places become
    file offsets by the lengths of the splits before.  Then the chain from
    offset 0 is followed by pointer jumping: each round joins the reached
    offsets with the jumps and the jumps with themselves, so they double.
    Offsets that are reached enter their split, where the chain is walked.  A
    magic string inside a payload is not reached.
    """
    found = materialise(_chunks(spark, path).mapInArrow(_candidates, _SQL), "warc-candidates")
    ends = found.groupBy("file", "block").agg(F.max("end").alias("length"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.select("file", "block", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("base"))
    on = found.where("kind <> 'start'").join(base, ["file", "block"])
    for c in ("place", "next", "leaves"):
        on = on.withColumn(c, F.when((F.col(c) >= 0) | F.lit(c == "place"), F.col(c) + F.col("base")).otherwise(-1))
    on = materialise(on.drop("base", "end"), "warc-offsets")
    discard(found)
    jumps = on.where("leaves >= 0").select("file", F.col("place").alias("u"), F.col("leaves").alias("v"))
    entries = jumps.select("file", F.col("v").alias("u")).distinct()
    starts = on.where("place = 0").select("file", F.lit(0).cast("long").alias("u")).distinct()
    jumps = materialise(jumps.join(entries.unionByName(starts).distinct(), ["file", "u"]), "warc-jumps")
    reached = materialise(starts, "warc-reached")
    n = -1
    while (now := reached.count()) != n:
        n, old = now, (reached, jumps)
        reached = materialise(reached.unionByName(reached.join(jumps, ["file", "u"]).select("file", F.col("v").alias("u")))
                              .distinct(), "warc-reached")
        further = jumps.select("file", F.col("u").alias("v"), F.col("v").alias("w"))
        jumps = materialise(jumps.join(further, ["file", "v"]).select("file", "u", F.col("w").alias("v")), "warc-jumps")
        discard(*old)
    marked = on.join(reached.withColumn("entry", F.lit(True)), (on["file"] == reached["file"]) & (on["place"] == reached["u"]),
                     "left").select(on["*"], F.coalesce("entry", F.lit(False)).alias("entry"))
    sql = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in marked.schema)
    return marked.repartition("file", "block").sortWithinPartitions("file", "block", "place").mapInArrow(_walk, sql)


def _across(spark: SparkSession, path: str, cut: DataFrame) -> DataFrame:
    """(file, place, n, digest) of responses that go on beyond their split
    because their payload holds the magic string there.

    A record is sent to each cell of the file that it spans and a chunk to the
    one that it starts in, so that chunks meet the records around them only.
    """
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, _, place, chunk in _splits(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in (
                (file, pa.int64()), (block, pa.int64()), (place, pa.int64()), (chunk, pa.binary()))],
                names=["file", "block", "place", "value"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, one, out = None, None, []
        for b in batches:
            for file, place, nxt, start, value in zip(*(b.column(c).to_pylist() for c in (
                    "file", "place", "next", "start", "value"))):
                if (file, place) != at:
                    at = (file, place)
                    fields, body = _headers(value)
                    length = int(fields[b"content-length"])
                    http = value.find(END, body, body + length)
                    skip = http + len(END) - body if http >= 0 else 0
                    one = _Open({"file": file, "place": place}, length - skip)
                    out.append(one.row)
                    one.take(value[body + skip:])
                else:
                    one.take(MAGIC + value)
        if out:
            yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in ("file", "place", "n", "digest")} for r in out])

    chunks = _chunks(spark, path).mapInArrow(placed, "file bigint, block bigint, place bigint, value binary")
    lengths = chunks.groupBy("file", "block").agg(F.max(F.col("place") + F.length("value") + len(MAGIC)).alias("length"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = lengths.select("file", "block", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("base"))
    cell = lambda c: F.floor(c / _CELL)
    at = chunks.join(broadcast_if_small(base, 200_000), ["file", "block"]).select(
        "file", (F.col("place") + F.col("base")).alias("start"), "value").withColumn("cell", cell(F.col("start")))
    wanted = cut.select("file", "place", "next", F.explode(F.sequence(cell(F.col("place")), cell(F.col("next")))).alias("cell"))
    rows = at.join(broadcast_if_small(wanted, 200_000), ["file", "cell"]).where((F.col("start") > F.col("place")) & (F.col("start") < F.col("next")))
    return (rows.select("file", "place", "next", "start", "value").repartition("file", "place")
            .sortWithinPartitions("file", "place", "start")
            .mapInArrow(digest, "file bigint, place bigint, n bigint, digest string"))


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the
    records that the boundary chain reaches; digests of responses are computed
    from their payloads, and a digest that differs from the stated one fails."""
    rows = materialise(reachable(spark, path), "warc-records")
    cut = rows.where("kind = 'response' and not complete")
    if not cut.isEmpty():
        whole = _across(spark, path, cut).select("file", "place", F.col("n").alias("n2"), F.col("digest").alias("d2"))
        rows = rows.join(whole, ["file", "place"], "left").withColumn("n", F.coalesce("n", "n2")).withColumn(
            "digest", F.coalesce("digest", "d2"))
    right = F.col("digest").eqNullSafe(F.col("stated"))
    digest = F.when(right, F.col("digest")).otherwise(F.raise_error(F.concat(
        F.lit("payload digest differs from the stated one at record "), F.coalesce("page", F.lit("")))))
    return rows.where(F.col("kind").isin("response", "revisit")).select(
        F.col("page").cast(id_type).alias("page_id"), F.col("n").alias("payload_bytes"), digest.alias("payload_digest"),
        F.col("kind").alias("record_type"), F.col("refers_to").cast(id_type).alias("refers_to"))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               least: int = 0, path: str | None = None) -> DataFrame:
    """Write a record for each page under ``path`` (by default a folder under
    spark.checkpoint.dir), read the archives back, and return what they hold.

    Null and empty payloads are payloads of 0 bytes.  A null id is less than
    any other and stays null; equal rows with the largest id are all responses.
    Null addresses are left out of the record; control characters and spaces
    in them are escaped.  An empty table gives an empty one; other columns are
    not read.
    """
    spark = pages.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/precis-llm-warc-{uuid.uuid4().hex}"
    write_archives(pages, path, id_col, url_col, html_col, least)
    out = read_archives(spark, path, pages.schema[id_col].dataType.simpleString())
    return out.withColumnRenamed("page_id", id_col)
