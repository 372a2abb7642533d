"""Quality classifier: zstandard dictionaries of good and bad labelled text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.llm.common import text_rows

#: Bytes compressed at a time: the dictionary, not the text itself, has to
#: explain most of a piece, however long the text is.
PIECE = 1024
LEVEL = 6
DICTIONARY_BYTES = 1 << 18


def _shape_table() -> bytes:
    """Letters of the byte range and bytes of longer characters become ``a`` or
    ``A``, digits ``0``: what is left is the shape of the text in any language."""
    t = bytearray(range(256))
    for i in range(256):
        c = chr(i)
        t[i] = ord("a") if "a" <= c <= "z" or i > 127 else ord("A") if "A" <= c <= "Z" else ord("0") if "0" <= c <= "9" else i
    return bytes(t)


_SHAPE = _shape_table()
_VIEWS = (bytes, lambda b: b.translate(_SHAPE))


@dataclass(frozen=True)
class Model:
    """Dictionaries (good and bad, for each view) and the calibration."""

    dictionaries: tuple[tuple[bytes, bytes], ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    prior: float

    def scorer(self):
        if not self.dictionaries:
            return lambda text: self.prior
        features = _features(self.dictionaries)
        mean, scale, w = (np.array(x) for x in (self.mean, self.scale, self.weights))

        def score(text: bytes) -> float:
            z = float(np.append((features(text) - mean) / scale, 1.0) @ w)
            return 1.0 / (1.0 + np.exp(-min(max(z, -30.0), 30.0)))

        return score


def _features(dictionaries):
    """Of each view: the size difference over the larger size, as a mean over
    pieces; the smaller size over the text's size; and the text's length."""
    packs = []
    for pair in dictionaries:
        both = []
        for raw in pair:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            both.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False,
                                                 write_checksum=False, write_dict_id=False).compress)
        packs.append(tuple(both))

    def features(text: bytes) -> np.ndarray:
        parts = [text[i:i + PIECE] for i in range(0, max(len(text), 1), PIECE)]
        n = np.array([len(p) for p in parts], float)
        w = np.maximum(n, 1) / max(n.sum(), 1.0)
        out = []
        for view, (good, bad) in zip(_VIEWS, packs):
            seen = [view(p) for p in parts]
            g = np.array([len(good(p)) for p in seen], float)
            b = np.array([len(bad(p)) for p in seen], float)
            # tanh: a piece that one dictionary happens to hold whole counts once
            out.append(float((np.tanh(8 * (b - g) / np.maximum(g, b)) * w).sum()))
            share = float((np.minimum(g, b) / np.maximum(n, 1) * w).sum())
            out += [share, min(share, 0.25)]
        out += [np.log1p(n.sum()), 1 / (1 + n.sum() / 100)]
        return np.array(out)

    return features


def _dictionary(texts: list[bytes]) -> bytes:
    """Raw content: one run of each text, from a place that its length sets.

    DICTIONARY_BYTES is a second bound: a run is 1 KB at least, so that a
    dictionary is full after 256 texts of that length, in the sample's order;
    further ones are not used."""
    run = max(PIECE, DICTIONARY_BYTES // max(len(texts), 1))
    out = []
    for t in texts:
        start = (len(t) * 7919 % (len(t) - run)) if len(t) > run else 0
        out.append(t[start:start + run])
    return b"".join(out)[:DICTIONARY_BYTES]


def _calibrate(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps; rows weigh as their class does."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    row = np.where(y == 1, prior / max((y == 1).sum(), 1), (1 - prior) / max((y == 0).sum(), 1))
    row = row / row.mean()
    w = np.zeros(a.shape[1])
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (row * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w))
        w = w + 0.8 * np.linalg.solve(h, a.T @ (row * (y - p)) - 1e-2 * w)
    return mean, scale, w


def held_out(id_col) -> F.Column:
    """True where crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", per_class: int = 2000, max_bytes: int = 16384) -> Model:
    """Learn dictionaries and calibration from a bounded sample.

    The sample is the documented bound: ``per_class`` labelled ids of each
    class in hash order, of which texts of up to ``max_bytes`` bytes are used
    (at most 2 * per_class * max_bytes bytes on the driver).  Half of each
    class makes the dictionaries, the other half the calibration.  A
    dictionary holds ``DICTIONARY_BYTES``: runs of 1 KB or more of the first
    texts, 256 of them if they are long.  Held-out
    ids, ids with two different labels and null labels are left out.  Without
    rows of both classes the score is the share of good labels (0.5 if there
    are none).
    """
    one = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
           .groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("y2"))
           .where("y = y2").select("id", "y", F.xxhash64(F.lit(5), "id").alias("h")))
    share = one.agg(F.avg("y")).first()[0]
    prior = 0.5 if share is None else float(share)
    sample = one.where("y = 1").orderBy("h", "id").limit(per_class).unionByName(
        one.where("y = 0").orderBy("h", "id").limit(per_class))
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
            .where(F.octet_length("text") <= max_bytes)
            .join(F.broadcast(sample), "id")  # at most 2 * per_class ids
            .groupBy("id", "y", "h").agg(F.min("text").alias("text")).collect())
    rows.sort(key=lambda r: (r.h, r.id))
    texts = {y: [bytes(r.text) for r in rows if r.y == y] for y in (1, 0)}
    if min(map(len, texts.values())) < 2:
        return Model((), (), (), (), prior)
    half = {y: len(t) // 2 for y, t in texts.items()}
    dictionaries = tuple(tuple(_dictionary([view(t) for t in texts[y][:half[y]]]) for y in (1, 0)) for view in _VIEWS)
    if not all(len(d) >= 8 for pair in dictionaries for d in pair):
        return Model((), (), (), (), prior)
    f = _features(dictionaries)
    x = np.array([f(t) for y in (1, 0) for t in texts[y][half[y]:]])
    y = np.array([y for y in (1, 0) for _ in texts[y][half[y]:]])
    mean, scale, w = _calibrate(x, y, min(max(prior, 0.01), 0.99))
    return Model(dictionaries, tuple(mean), tuple(scale), tuple(w), prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted) of every row, over the whole text.

    The score compares how well the good and the bad dictionary compress each
    piece of the text, and of its shape; calibrated so that it is the chance
    of label 1.  Null and empty texts are scored as the empty text; a null id
    is not held out; repeated rows give repeated results; other columns are
    not read.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch, texts in text_rows(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([float(of(t)) for t in texts], pa.float64())], names=["id", "score"])

    out = src.mapInArrow(run, f"id {id_type}, score double")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, all columns kept."""
    names = docs.columns
    at = names.index(text_col)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch, texts in text_rows(batches, at):
            yield batch.filter(pa.array([of(t) >= threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, schema)
