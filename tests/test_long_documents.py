"""Embedding TextRank of long documents, block by block, against the kernel that holds a document."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from precis.operators import long_documents as L
from precis.operators import rank as R


def _vecs(spark, ids="string"):
    rng = np.random.default_rng(3)
    docs = {"a": np.abs(rng.normal(size=(61, 5))), "b": np.abs(rng.normal(size=(7, 5))), "one": np.ones((1, 5)),
            "zero": np.zeros((4, 5)), "mixed": np.abs(rng.normal(size=(40, 5))), None: np.abs(rng.normal(size=(30, 5))),
            "bad": np.array([[1.0, 0, 0, 0, 0], [-1.0, 0.02, 0, 0, 0], [0.02, 1, 0, 0, 0], [0.02, -1, 0, 0, 0], [1, 0.3, 0, 0, 0]])}
    docs["mixed"][3] = 0
    docs["mixed"][5] = docs["mixed"][6]
    rows = [(d, i, v.tolist()) for d, m in docs.items() for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "doc_id string, i int, vec array<double>").repartition(3)


@pytest.mark.parametrize("block", [4, 1000])
def test_blocks_equal_one_task(spark, block):
    vecs = _vecs(spark)
    kernel = {(r.doc_id, r.i): r for r in R._cosine_in_tasks(vecs, 0.85, 1e-6, 60).collect()}
    got = {(r.doc_id, r.i): r for r in L.embedding_rounds(vecs, 0.85, 1e-6, 60, R.DANGLING_EPS, R._DIVERGED, block).collect()}
    assert got.keys() == kernel.keys()
    for k, r in kernel.items():
        assert got[k].converged == r.converged, k
        assert got[k].score == (pytest.approx(r.score, abs=1e-9) if r.converged else None), k
    assert any(r.converged for r in got.values()) and not all(r.converged for r in got.values())


def test_only_long_documents_go_through_rounds(spark, monkeypatch):
    vecs, seen = _vecs(spark), []
    rounds = R.embedding_rounds
    monkeypatch.setattr(R, "embedding_rounds", lambda v, *a: seen.append({r.doc_id for r in v.collect()}) or rounds(v, *a))
    got = {(r.doc_id, r.i): r.score for r in R.embedding_textrank_scores(vecs, small=35).collect()}
    assert seen == [{"a", "mixed"}]
    want = {(r.doc_id, r.i): r.score for r in R.embedding_textrank_scores(vecs, sents=vecs).collect()}
    assert len(seen) == 1 and got.keys() == want.keys()
    assert all(got[k] == (want[k] if want[k] is None else pytest.approx(want[k], abs=1e-9)) for k in want)


def test_empty_table(spark):
    assert L.embedding_rounds(_vecs(spark).limit(0), 0.85, 1e-6, 10, R.DANGLING_EPS, R._DIVERGED).count() == 0
    assert R.embedding_textrank_scores(_vecs(spark).where(F.lit(False))).count() == 0


def test_lsa_and_luhn_in_tasks_equal_those_by_words(spark):
    """Documents that a task holds take no shuffle of words; repeated and null keys count as in the joins."""
    from precis.operators import rank as R

    rng = np.random.default_rng(5)
    rows = [(d, i, " ".join(rng.choice(list("abcdefgh"), rng.integers(0, 12)))) for d in range(12) for i in range(int(rng.integers(1, 9)))]
    rows += rows[:5] + [(0, 0, "a b a"), (None, 0, "a a b"), (None, 1, "a"), (3, 90, None), (4, 90, "1 2"), (50, 0, "")]
    sents = spark.createDataFrame(rows, "doc_id long, i int, sentence string")
    for scores in (R.lsa_scores, R.luhn_scores):
        got, want = (sorted(((r.doc_id, r.i, round(r.score, 9)) for r in scores(sents, small=s).collect()), key=str) for s in (None, (0, 0)))
        assert len(got) == len(rows) and got == want
    plan = R.lsa_scores(sents)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Window" not in plan


def test_rankers_of_one_table_share_an_exchange(spark, monkeypatch):
    """words are made and dealt out once for all rankers of a table; documents meet the kernel by many, in pieces."""
    from precis.operators import rank as R

    rng = np.random.default_rng(7)
    rows = [(d, i, " ".join(rng.choice(list("abcdefgh"), 6))) for d in range(40) for i in range(int(rng.integers(1, 9)))]
    rows += [(50, i, "one two one") for i in range(30)] + [(None, 0, "a b a b"), (None, 1, None)]
    sents = spark.createDataFrame(rows, "doc_id long, i int, sentence string")
    both = R.lsa_scores(sents).withColumnRenamed("score", "lsa").join(R.luhn_scores(sents).withColumnRenamed("score", "luhn"), R.K)
    both.collect()
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") + plan.count("ReusedQueryStage") >= 1 and plan.count("MapGroupsInArrow") >= 2
    for scores in (R.lsa_scores, R.luhn_scores, R.textrank_scores, R.lexrank_scores, lambda s: R.kl_scores(s, 2)):
        found = lambda: sorted(((r.doc_id, r.i, round(r.score, 9)) for r in scores(sents).collect()), key=str)  # noqa: B023, E731
        whole = found()
        monkeypatch.setattr(R, "HELD_CHARS", 20)
        assert found() == whole and len(whole) == len(rows)
        monkeypatch.undo()


def test_words_are_found_by_one_pattern(spark):
    """A run of word characters is a word, or passed over whole."""
    from precis.functions.text import expand_contractions, rank_words

    text = "It's a well-known x2 2x _a a_b 'quoted' -dash \U0001d7d9abc \U0001d49cbc na\u00efve don't. \U0001f600face"
    got = spark.createDataFrame([(text,), (None,), ("12 _",)], "t string").select(rank_words("t").alias("w")).collect()
    assert got[0].w == ["it's", "a", "well-known", "\U0001d49cbc", "na\u00efve", "don't", "face"] and got[1].w is None and got[2].w == []
    more = spark.createDataFrame([("I can't and won't",), ("none here",), (None,)], "t string")
    assert [r[0] for r in more.select(expand_contractions("t")).collect()][1:] == ["none here", None]
    plan = more.select(expand_contractions("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") < 3  # was made three times
