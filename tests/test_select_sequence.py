"""Fixtures F-TOPK, F-PAD, F-BUDGET, F-BINS, F-GRID, F-STORY, and the
streaming = batch invariant."""

import math

import pytest
from pyspark.sql import functions as F

from precis.functions import sequence as S
from precis.operators import report as W
from precis.operators import sampling as SM
from precis.operators.select import first_k_accepted, length_budget
from precis.operators.stats import equal_width_histogram
from precis.sources.stories import parse_story


def test_top_k_keeps_ties(spark):
    df = spark.createDataFrame([(0, t, l) for t, l in enumerate([3.0, 2.0, 2.0, 1.0])], "step_id long, token_id int, logit double")
    assert sorted(r[0] for r in SM.top_k(df, 2).select("token_id").collect()) == [0, 1, 2]


def test_top_p_previous_sum(spark):
    df = spark.createDataFrame([(0, t, math.log(p)) for t, p in enumerate([0.5, 0.3, 0.2])], "step_id long, token_id int, logit double")
    assert sorted(r[0] for r in SM.top_p(df, 0.5).select("token_id").collect()) == [0, 1]
    assert sorted(r[0] for r in SM.top_p(df, 0.49).select("token_id").collect()) == [0]


def test_softmax_and_draw(spark):
    df = spark.createDataFrame([(s, t, float(t)) for s in range(3) for t in range(4)], "step_id long, token_id int, logit double")
    p = SM.softmax(df, 0.8)
    sums = [r[1] for r in p.groupBy("step_id").agg(F.sum("prob")).collect()]
    assert all(x == pytest.approx(1.0) for x in sums)
    a = sorted(tuple(r) for r in SM.draw(p, 42).collect())
    assert a == sorted(tuple(r) for r in SM.draw(p, 42).collect()) and len(a) == 3


def test_padding(spark):
    df = spark.createDataFrame([([5, 6], [7])], "d array<int>, s array<int>")
    r = df.select(S.sample_row("d", "s", 6).alias("x"), S.sample_row("d", "s", 3).alias("y")).first()
    assert r["x"]["tokens"] == [5, 6, 1, 7, 0, 0] and r["x"]["sum_idx"] == 2
    assert r["y"]["tokens"] == [5, 6, 1, 7]
    lab = df.select(S.label_range(S.pad_right(S.join_with_sep("d", "s"), 6), F.lit(2))).first()[0]
    assert lab == [7, 0, 0]


def test_budget_and_first_k(spark):
    rows = [(1, "train", [0] * 2, [0]), (2, "train", [0] * 9, [0] * 9), (3, "train", [0] * 3, [0]), (4, "train", [0], [0])]
    df = spark.createDataFrame(rows, "doc_id long, split string, d array<int>, s array<int>")
    ok = length_budget(df, "d", "s", 5)
    assert sorted(r[0] for r in ok.select("doc_id").collect()) == [1, 3, 4]
    k = first_k_accepted(df, (F.size("d") + F.size("s") + 1) <= 5, 2)
    assert sorted(r[0] for r in k.select("doc_id").collect()) == [1, 3]


def test_histogram_top_edge(spark):
    df = spark.createDataFrame([("a", 0), ("a", 5), ("a", 10)], "split string, n long")
    assert sorted(r["bin"] for r in equal_width_histogram(df, "n", "split").collect()) == [1, 6, 10]


def test_grid_tie_first_listed(spark):
    g = spark.createDataFrame([("p2", "m", "BLEU-1", 0.5), ("p1", "m", "BLEU-1", 0.5), ("p1", "m", "ROUGE-1-recall", 0.1),
                               ("p2", "m", "ROUGE-1-recall", 0.2)], "pipeline string, model string, metric string, value double")
    best = {r["metric"]: r["pipeline"] for r in W.best_per(g, "metric", "pipeline", "value", ["p1", "p2"]).collect()}
    assert best == {"BLEU-1": "p1", "ROUGE-1-recall": "p2"}


def test_story_parse(spark):
    text = "One.\n\nTwo.\n@highlight\n\nH1\n@highlight\nH2"
    r = spark.createDataFrame([(text,)], "v string").select(parse_story("v").alias("s")).first()["s"]
    assert r["article"] == "One. Two. " and r["highlights"] == "H1 . H2 . "


def test_streaming_equals_batch(spark):
    from precis.operators.metrics import corpus_bleu
    from precis.streaming import metrics as ST
    rows = [(i, f"a b c d {i}", f"a b x d {i % 3}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, prediction string, reference string")
    path = ST.stage_files(df, 3)
    s = ST.streaming_bleu(spark, path, df.schema).first()
    b = corpus_bleu(df).first()
    assert [s[f"bleu_{n}"] for n in range(1, 5)] == pytest.approx([b[f"bleu_{n}"] for n in range(1, 5)])
    # ST4: a new query with a new checkpoint starts from an empty state.
    s2 = ST.streaming_bleu(spark, path, df.schema).first()
    assert s2["bleu_1"] == pytest.approx(s["bleu_1"])


def test_encode_decode_roundtrip(spark):
    from precis.operators.encode import FIRST_WORD_ID, build_vocabulary, decode, encode
    df = spark.createDataFrame([(1, "b a b", "a"), (2, "", "c"), (3, "c  b", "")], "doc_id long, document string, summary string")
    vocab = build_vocabulary(df, ["document", "summary"])
    ids = {r["word"]: r["id"] for r in vocab.collect()}
    assert ids["b"] == FIRST_WORD_ID and ids["a"] == FIRST_WORD_ID + 1 and ids["c"] == FIRST_WORD_ID + 2
    enc = encode(df, ["document", "summary"], vocab)
    got = {r["doc_id"]: (r["document"], r["summary"]) for r in enc.collect()}
    assert got[1] == ([3, 4, 3], [4]) and got[2] == ([], [5]) and got[3] == ([5, 3], [])
    dec = {r["doc_id"]: r["text"] for r in decode(enc, "document", vocab).collect()}
    assert dec == {1: "b a b", 2: "", 3: "c b"}


def test_vector_file_later_line_wins(spark, tmp_path):
    from precis.sources.stories import read_word_vectors
    p = tmp_path / "vec.txt"
    p.write_text("cat 1 2\ndog 3 4\ncat 5 6\n")
    got = {r["word"]: list(r["vector"]) for r in read_word_vectors(spark, str(p)).collect()}
    assert got == {"cat": [5.0, 6.0], "dog": [3.0, 4.0]}
