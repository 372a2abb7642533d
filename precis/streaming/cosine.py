"""Word-vector cosine on a stream (M5), by key, with a reset (ST4).

A micro-batch's words meet the static table of vectors by blocks of texts, where
the cosines of its pairs are made (no vector of a word leaves its block); these
are a stream of their own, of which a keyed state operator
keeps the sum and the number of the key's present epoch.  A row
of a later epoch, a ``reset`` row or a pair, starts the key from zero; rows of
earlier epochs that come late are left out.  So the state depends on the rows
only, not on how they were cut into batches.  A key is dealt over ``salts``
states, so one hot key is the work of many tasks; the states of the key's last
epoch are added at the end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.text_vectors import VectorTable, over_vectors, same_as_before
from .metrics import FILES_PER_BATCH, _scratch

SALTS = 16
_KEYS = ["key", "salt"]
#: A pair's cosine, or a reset (without one), as the keyed state gets them; and the state's updates.
COSINES = "key string, salt int, epoch long, reset boolean, cosine double"
UPDATES = "key string, salt int, epoch long, total double, n long"


def _add_up(sums: dict, words: pd.DataFrame, dim: int) -> None:
    """Adds the vectors of words to the two sums of their pairs."""
    pair, pairs = pd.factorize(words["id"])
    at = pair * 2 + words["side"].to_numpy()
    known = words["vector"].notna().to_numpy()
    more = np.zeros((len(pairs) * 2, dim))
    if known.any():
        np.add.at(more, at[known], np.stack(words["vector"][known].to_list()).astype(float))
    for p, v in zip(pairs, more.reshape(-1, 2, dim)):
        sums[p] = sums[p] + v if p in sums else v.copy()


def _cosines(sums: dict) -> np.ndarray:
    v = np.stack(list(sums.values()))
    size = np.linalg.norm(v, axis=2).prod(axis=1)
    dot = (v[:, 0] * v[:, 1]).sum(axis=1)
    return np.divide(dot, size, out=np.zeros(len(dot)), where=size > 0)


def _of_pairs(dim: int):
    """The cosine of each document's two texts, as a kernel of :func:`over_vectors`."""
    def run(t: pa.Table) -> pa.Table:
        new, side = t.column("new").to_numpy(), t.column("i").combine_chunks()
        once = np.flatnonzero(new | ~same_as_before(side))  # rows of one text hold one vector
        v = pc.fill_null(t.column("vec").combine_chunks().flatten(), 0.0).to_numpy(zero_copy_only=False).reshape(-1, dim)
        sums = {}
        _add_up(sums, pd.DataFrame({"id": np.cumsum(new)[once], "side": side.to_numpy()[once], "vector": list(v[once])}), dim)
        return pa.table({"doc_id": t.column("doc_id").take(pa.array(np.flatnonzero(new))), "cosine": _cosines(sums)})

    return run


def pair_cosines(events: DataFrame, vectors: DataFrame | VectorTable, dim: int, id_cols: Sequence[str], key: str = "key",
                 epoch: str = "epoch", reset: str = "reset", pred: str = "prediction", ref: str = "reference",
                 salts: int = SALTS) -> DataFrame:
    """The rows ``COSINES`` of a micro-batch's events: one for each pair, one for each reset.

    ``id_cols`` tell the pairs of an epoch apart (rows of one pair add up); null texts have
    no words (cosine 0); a null epoch is 0, a null reset is none.
    """
    rows = events.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(epoch).cast("long"), F.lit(0)).alias("epoch"),
                         F.coalesce(F.col(reset), F.lit(False)).alias("reset"), F.to_json(F.struct(*id_cols)).alias("id"), pred, ref)
    sides = F.array(F.struct(F.lit(0).alias("i"), F.col(pred).alias("sentence")),
                    F.struct(F.lit(1).alias("i"), F.col(ref).alias("sentence")))
    texts = rows.where("not reset").select(F.struct("key", "epoch", "id").alias("doc_id"), F.explode(sides).alias("x")).select(
        "doc_id", "x.i", "x.sentence")
    found = over_vectors(texts, vectors, dim, _of_pairs(dim), "doc_id struct<key string, epoch bigint, id string>, cosine double")
    found = found.select("doc_id.*", F.lit(False).alias("reset"), "cosine")
    both = found.unionByName(rows.where("reset").select("key", "epoch", "id", "reset", F.lit(None).cast("double").alias("cosine")))
    return both.select("key", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), "epoch", "reset", "cosine")


def cosine_stream(stream: DataFrame, vectors: DataFrame | VectorTable, dim: int, id_cols: Sequence[str], salts: int = SALTS) -> str | None:
    """Runs :func:`pair_cosines` over all that is available; the folder of the rows, in one of its own for each micro-batch
    (running it again gives the same), or None if there was none."""
    base, numbers = _scratch(stream.sparkSession, "cosines"), []

    def write(batch: DataFrame, number: int) -> None:
        pair_cosines(batch, vectors, dim, id_cols, salts=salts).write.mode("overwrite").parquet(f"{base}/{number}")
        numbers.append(number)

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", _scratch(stream.sparkSession, "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{base}/*" if numbers else None


def cosine_state(stream: DataFrame) -> DataFrame:
    """The state's updates ``UPDATES`` for a stream of ``COSINES``.  A task holds one batch of them."""
    def update(group, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, total, n = state.get if state.exists else (None, 0.0, 0)
        for rows in frames:
            newest = int(rows["epoch"].max())
            if at is None or newest > at:
                at, total, n = newest, 0.0, 0
            mine = rows["cosine"][(rows["epoch"] == at) & ~rows["reset"].astype(bool)]
            total, n = total + float(mine.sum()), n + len(mine)
        state.update((at, total, n))
        yield pd.DataFrame({"key": [group[0]], "salt": [group[1]], "epoch": [at], "total": [total], "n": [n]})

    return stream.groupBy(*_KEYS).applyInPandasWithState(update, UPDATES, "epoch long, total double, n long", "update",
                                                         GroupStateTimeout.NoTimeout)


def run_updates(state: DataFrame, keys: Sequence[str] = _KEYS) -> DataFrame:
    """Run a query of update mode over all that is available; the last row of
    each state.  A micro-batch writes its updates, then the table so far with
    them, to folders of its own number on shared storage: running it again
    gives the same, and nothing goes through the driver."""
    spark = state.sparkSession
    base, last = _scratch(spark, "state"), []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/new/{number}")
        table = spark.read.schema(state.schema).parquet(f"{base}/new/{number}")
        if number:
            old, new = spark.read.schema(state.schema).parquet(f"{base}/all/{number - 1}").alias("o"), table.alias("n")
            same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
            table = table.unionByName(old.join(new, same, "left_anti"))
        table.write.mode("overwrite").parquet(f"{base}/all/{number}")
        last[:] = [f"{base}/all/{number}"]

    q = (state.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", _scratch(spark, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(state.schema).parquet(last[0]) if last else spark.createDataFrame([], state.schema)


def cosine_by_key(states: DataFrame) -> DataFrame:
    """``(key, epoch, total, n)``: the states of each key's last epoch added up."""
    newest = F.max("epoch").over(Window.partitionBy("key"))
    return states.withColumn("newest", newest).where("epoch = newest") \
        .groupBy("key", "epoch").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def streaming_cosine(spark: SparkSession, path: str, schema, vectors: DataFrame | VectorTable, dim: int, id_cols: Sequence[str],
                     files_per_batch: int = FILES_PER_BATCH, salts: int = SALTS) -> DataFrame:
    """M5 by key end to end: file source -> cosines of pairs -> keyed state -> ``(key, epoch, total, n)``."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    made = cosine_stream(stream, vectors, dim, id_cols, salts)
    if made is None:
        return cosine_by_key(spark.createDataFrame([], UPDATES))
    made = spark.readStream.schema(COSINES).option("maxFilesPerTrigger", files_per_batch).parquet(made)
    return cosine_by_key(run_updates(cosine_state(made)))
