"""Story files through the data source, and the streaming cosine with its reset."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from precis.operators import vectors as V
from precis.sources import story_source as S
from precis.streaming import cosine as C
from precis.streaming import metrics as ST


def test_story_files_round_trip(spark, tmp_path):
    rows = [("a/b c+%.x", "One.\n\nTwo.", ["H1", "H2"]), ("é", "Ünï.", None), ("3", None, []), ("4", "", [None, "x"])]
    df = spark.createDataFrame(rows, "doc_id string, article string, highlights array<string>")
    path = f"file://{tmp_path}/s"
    S.write_stories(df, path)
    S.write_stories(df, path)  # the same names: nothing is doubled
    (tmp_path / "s" / "note.txt").write_text("not a story")
    got = {r.key: (r.article, r.highlights) for r in S.load_stories(spark, path).collect()}
    assert got == {"a/b c+%.x": ("One. Two. ", "H1 . H2 . "), "é": ("Ünï. ", ""), "3": ("", ""), "4": ("", "x . ")}
    assert {r.key for r in S.load_stories(spark, path, "*.txt").collect()} == {"note"}
    assert not [f for _, _, fs in os.walk(tmp_path) for f in fs if not f.startswith(".") and not f.endswith((".story", ".txt"))]


def test_story_tasks_and_names(spark, tmp_path):
    df = spark.range(300).select("id", F.repeat(F.lit("word "), 50).alias("article"), F.array(F.lit("h")).alias("highlights"))
    S.write_stories(df.repartition(4), str(tmp_path), "id")
    assert len(os.listdir(tmp_path)) <= S.FOLDERS
    one = (300 * S.OPEN_BYTES) // 5
    raw = spark.read.format("stories").option("taskBytes", one).load(str(tmp_path))
    assert raw.count() == 300 and 5 <= raw.rdd.getNumPartitions() <= 7
    for bad in (df.union(df), df.withColumn("id", F.lit(None).cast("long")).limit(1)):
        with pytest.raises(ValueError, match="distinct"):
            S.write_stories(bad, str(tmp_path), "id")
    os.makedirs(tmp_path / "empty")
    assert S.load_stories(spark, str(tmp_path / "empty")).count() == 0


VECTORS = [(w, [float(v) for v in np.random.default_rng(k).normal(size=4)]) for k, w in enumerate("abcdefgh")]
SCHEMA = "key string, epoch long, reset boolean, id long, prediction string, reference string"


def _events():
    rng = np.random.default_rng(5)
    text = lambda: " ".join(rng.choice(list("abcdefghxyz"), rng.integers(0, 7)))
    rows = [(k or "None", e, False, 100 * e + i, text(), text()) for k in ("hot", None) for e in range(3) for i in range(20 if k else 6)]
    rows += [("cleared", 0, False, 1, "a b", "a"), ("cleared", 1, True, None, None, None)]
    rows += [("plain", None, None, 1, "a b", "b a"), ("plain", None, None, 2, None, "b"), ("plain", None, None, 3, "", "")]
    return rows


@pytest.mark.parametrize("order", ["forward", "backward"])
def test_streaming_cosine_and_reset(spark, order):
    rows = _events() if order == "forward" else _events()[::-1]
    df = spark.createDataFrame(rows, SCHEMA)
    vectors = spark.createDataFrame(VECTORS, "word string, vector array<double>")
    path = ST.stage_files(df.coalesce(1), rows_per_file=13)
    got = {r.key: (r.epoch, r.n, r.total) for r in
           C.streaming_cosine(spark, path, df.schema, vectors, 4, ["id"], files_per_batch=2, salts=3).collect()}
    pairs = df.where("not coalesce(reset, false)").select(F.coalesce("key", F.lit("None")).alias("key"),
                                                           F.coalesce("epoch", F.lit(0)).alias("epoch"), "id", "prediction", "reference")
    batch = V.rowwise_cosine(pairs, ["key", "epoch", "id"], vectors, 4).collect()
    last = {"hot": 2, "None": 2, "plain": 0}
    for key, epoch in last.items():
        want = [r.cosine for r in batch if r.key == key and r.epoch == epoch]
        assert got[key][:2] == (epoch, len(want)) and got[key][2] == pytest.approx(sum(want), abs=1e-9)
    assert got["cleared"] == (1, 0, 0.0) and len(got) == 4


def test_streaming_cosine_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    vectors = spark.createDataFrame(VECTORS, "word string, vector array<double>")
    assert C.streaming_cosine(spark, ST.stage_files(df), df.schema, vectors, 4, ["id"]).count() == 0


def test_story_query_has_a_file_for_each_id(spark, tmp_path):
    from precis.plans.report_queries import s2_s3_stories

    rows = [(1, "One. Two."), (1, "One. Two."), (None, "Three."), (-2, "Four.\n\nFive.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in s2_s3_stories(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(1, "One. Two. ", "One. . One. Two. . One. . "), (None, "Three. ", "Three. . "), (-2, "Four. Five. ", "Four. . ")], key=str)


def test_cosine_state_holds_sums_and_not_the_words_of_all_batches():
    """Words of a pair that come in several batches are added to two vectors of the pair."""
    import pandas as pd

    from precis.streaming.cosine import _add_up, _cosines

    sums = {}
    for batch in ([("a", 0, [1.0, 0.0]), ("a", 1, [1.0, 0.0])], [("a", 1, [0.0, 1.0]), ("b", 0, None)]):
        _add_up(sums, pd.DataFrame(batch, columns=["id", "side", "vector"]), 2)
    assert list(sums) == ["a", "b"] and sums["a"].tolist() == [[1, 0], [1, 1]]
    assert _cosines(sums).tolist() == pytest.approx([2 ** -0.5, 0.0])


def test_the_keyed_state_gets_a_number_for_each_pair(spark, monkeypatch):
    """Neither words nor vectors are dealt out by key: a micro-batch's cosines are, made by blocks of texts."""
    rows = [("k", 0, False, 1, "a b", "a"), ("k", 0, False, 1, "c", "x"), ("k", 0, False, 2, None, "a"), ("k", None, None, 3, "a a", "a"),
            (None, 1, True, None, None, None)]
    vectors = spark.createDataFrame(VECTORS + [("h", None)], "word string, vector array<double>")
    got = {(r.key, r.epoch, r.reset, None if r.cosine is None else round(r.cosine, 9)) for r in
           C.pair_cosines(spark.createDataFrame(rows, SCHEMA), vectors, 4, ["id"]).collect()}
    v = {w: np.array(x) for w, x in VECTORS}
    first = v["a"] + v["b"] + v["c"]  # rows of one pair add up
    want = first @ v["a"] / np.linalg.norm(first) / np.linalg.norm(v["a"])
    assert got == {("k", 0, False, round(want, 9)), ("k", 0, False, 0.0), ("k", 0, False, 1.0), (None, 1, True, None)}
    seen, state = [], C.cosine_state
    monkeypatch.setattr(C, "cosine_state", lambda s, *a, **b: seen.append(s.dtypes) or state(s, *a, **b))
    path = ST.stage_files(spark.createDataFrame(rows[:3], SCHEMA))
    assert [r.n for r in C.streaming_cosine(spark, path, SCHEMA, vectors, 4, ["id"], salts=2).collect()] == [2]
    assert seen == [[("key", "string"), ("salt", "int"), ("epoch", "bigint"), ("reset", "boolean"), ("cosine", "double")]]
