"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.llm.common import ASCII_SPACE, BATCH_BYTES, text_rows

#: Longest unit kept in a task's table of known lengths, and its largest size.
_KEEP_BYTES, _KEEP_UNITS = 64, 400_000


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def check_boundaries(path: str) -> None:
    """Raise ValueError if the tokenizer does not count alike when texts are cut
    at the space characters of the byte range (a byte-level one that keeps the
    space in the token does not)."""
    tok = _tokenizer(path)
    ids = lambda t: tok.encode(t, add_special_tokens=False).ids
    for a, b in (("ab", "cd"), ("Word", "next"), ("x.", "'s"), ("12", "3"), ("é", "ü!"), ("(", ")")):
        for c in (*ASCII_SPACE, "  ", "\n\n", " \t"):
            if len(ids(f"{a}{c}{b}")) != len(ids(a)) + len(ids(b)):
                raise ValueError(f"{path}: tokens reach across white space ({a!r}, {c!r}, {b!r}); texts cannot be cut there")


def pieces(text: bytes, limit: int) -> Iterator[bytes]:
    """Cut a long text behind byte-range space characters into pieces of about
    ``limit`` bytes.  A run without such a character is never cut."""
    start = 0
    while len(text) - start > limit:
        cut = max(text.rfind(c, start, start + limit) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut < 0:
            ahead = [p for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (p := text.find(c, start + limit)) >= 0]
            if not ahead:
                break
            cut = min(ahead)
        yield text[start:cut + 1]
        start = cut + 1
    yield text[start:]


def _lengths(path: str, texts: list[bytes], known: dict[bytes, int], limit: int) -> list[int]:
    tok = _tokenizer(path)

    def encode(units: list[bytes]) -> list[int]:
        got = tok.encode_batch([u.decode("utf-8", "replace") for u in units], add_special_tokens=False)
        return [len(e.ids) for e in got]

    split = [[p.split() for p in pieces(t, limit)] for t in texts]
    units = {u for t in split for p in t for u in p}
    new = [u for u in units if u not in known]
    if len(known) + len(new) > _KEEP_UNITS:
        known.clear()
        new = list(units)
    once: dict[bytes, int] = {}
    size, group = 0, []
    for u in [*new, None]:  # groups of about the same number of bytes
        if group and (u is None or size + len(u) > limit):
            for v, n in zip(group, encode(group)):
                (known if len(v) <= _KEEP_BYTES else once)[v] = n
            size, group = 0, []
        if u is not None:
            size += len(u)
            group.append(u)
    if once:
        return [sum(known[u] if u in known else once[u] for p in t for u in p) for t in split]
    return [sum(sum(map(known.__getitem__, p)) for p in t) for t in split]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; other columns are not read.

    ``path`` names a tokenizer file of the tokenizers library whose
    pre-tokenizer never joins characters across white space and drops it
    (:func:`check_boundaries` tries that first, and raises ValueError).
    Then the space characters of the byte range are safe boundaries: neither
    normal form C, nor lower-casing, nor the split pattern, nor the special
    strings reach across one.  Texts are cut there, each distinct unit of a
    batch is encoded once, and only lengths leave the task.  Batches hold about
    ``batch_bytes`` bytes; a longer text is worked on in pieces.

    Null and empty texts have 0 bytes and 0 tokens.  A null id stays null;
    repeated rows give repeated results; an empty table gives an empty one.
    """
    check_boundaries(path)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch, texts in text_rows(batches, "text", batch_bytes):
            n = _lengths(path, texts, known, batch_bytes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64())],
                names=["id", "n_bytes", "n_tokens"])

    out = src.mapInArrow(run, f"id {id_type}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
