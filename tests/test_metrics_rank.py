"""Metric and ranker fixtures (F-PAIR, F-VEC, F-GRAPH, F-LUHN) and
brute-force twins written from the definitions."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from precis.functions.text import rank_words, rouge_tokens, whitespace_tokens
from precis.operators import metrics as M
from precis.operators import rank as R

PRED, REF = "I have thirty six years", "I am thirty six years old"


def pairs(spark, rows):
    return spark.createDataFrame([(k, p, r) for k, (p, r) in enumerate(rows)], "doc_id long, prediction string, reference string")


def test_bleu_pair(spark):
    r = M.corpus_bleu(pairs(spark, [(PRED, REF)])).first()
    assert r["bleu_1"] == pytest.approx(0.654985, abs=1e-6)
    assert r["bleu_2"] == pytest.approx(0.517811, abs=1e-6)
    assert r["bleu_3"] == pytest.approx(0.418268, abs=1e-6)
    assert r["bleu_4"] == 0.0


def test_rouge_pair(spark):
    r = M.rouge(pairs(spark, [(PRED, REF)])).first()
    assert r["rouge1_precision"] == pytest.approx(0.8)
    assert r["rouge1_recall"] == pytest.approx(4 / 6)
    assert r["rouge1_fmeasure"] == pytest.approx(0.727273, abs=1e-6)
    assert (r["rouge2_precision"], r["rouge2_recall"]) == (pytest.approx(0.5), pytest.approx(0.4))
    assert r["rougeL_fmeasure"] == pytest.approx(0.727273, abs=1e-6)


def test_identical_texts_score_one(spark):
    t = "the cat sat on the mat today"
    r = M.corpus_bleu(pairs(spark, [(t, t)])).first()
    assert r["bleu_4"] == pytest.approx(1.0)
    g = M.rouge(pairs(spark, [(t, t)])).first()
    assert g["rougeL_fmeasure"] == pytest.approx(1.0) and g["rouge2_fmeasure"] == pytest.approx(1.0)


def _lcs(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            dp[i + 1][j + 1] = dp[i][j] + 1 if a[i] == b[j] else max(dp[i][j + 1], dp[i + 1][j])
    return dp[-1][-1]


def test_lcs_fold_matches_dp(spark):
    rng = np.random.default_rng(7)
    rows = [([str(x) for x in rng.integers(0, 5, rng.integers(0, 12))], [str(x) for x in rng.integers(0, 5, rng.integers(0, 12))])
            for _ in range(40)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = [r[0] for r in df.select(M.lcs_length("a", "b")).collect()]
    assert got == [_lcs(a, b) for a, b in rows]


def test_clipped_overlap(spark):
    df = spark.createDataFrame([(["a", "a", "b", "c"], ["a", "b", "b", "d"])], "p array<string>, r array<string>")
    assert df.select(M.clipped_overlap("p", "r")).first()[0] == 2


def test_vectors_and_cosine(spark):
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, vector array<float>")
    s = spark.createDataFrame([(0, 0, "a b"), (0, 1, "a zz"), (0, 2, ""), (0, 3, "   ")], "doc_id long, i int, sentence string")
    v = {r["i"]: r["vec"] for r in R.sentence_vectors(s, vec, 2).collect()}
    assert v[0] == pytest.approx([1 / 2.001, 1 / 2.001]) and v[1] == pytest.approx([1 / 2.001, 0.0])
    assert v[2] == [0.0, 0.0] and v[3] == [0.0, 0.0]
    c = spark.createDataFrame([([1.0, 0.0], [1 / 2.001, 1 / 2.001], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = c.select(M.cosine("a", "b").alias("x"), M.cosine("a", "z").alias("y")).first()
    assert r["x"] == pytest.approx(0.707107, abs=1e-6) and r["y"] == 0.0


def test_pagerank_path_graph(spark):
    e = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 0, 1.0), (0, 0, 2, 1.0), (0, 2, 0, 1.0)], "doc_id long, i int, j int, w double")
    nodes = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "doc_id long, i int")
    got = {r["i"]: r["score"] for r in R.pagerank(e, nodes).collect()}
    assert got[0] == pytest.approx(0.486486, abs=1e-5) and got[1] == pytest.approx(0.256757, abs=1e-5)
    nodes4 = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (0, 3)], "doc_id long, i int")
    got4 = [r["score"] for r in R.pagerank(e, nodes4).collect()]
    assert sum(got4) == pytest.approx(1.0, abs=1e-6)


def _sents(spark, docs):
    rows = [(d, i, s) for d, ss in enumerate(docs) for i, s in enumerate(ss)]
    return spark.createDataFrame(rows, "doc_id long, i int, sentence string")


def test_luhn_chunks(spark):
    s = _sents(spark, [["alpha bx cx dx alpha", "beta ex fx gx hx beta", "alpha beta"]])
    got = {r["i"]: r["score"] for r in R.luhn_scores(s).collect()}
    assert got[0] == pytest.approx(0.8) and got[1] == 0.0 and got[2] == pytest.approx(2.0)


DOC = ["The cat sat on the mat.", "A dog sat on the log.", "The cat and the dog met.", "Birds fly high.",
       "Cats like mats and dogs like logs.", "fly"]


def _words(spark, sents):
    df = spark.createDataFrame([(s,) for s in sents], "s string")
    return [r[0] for r in df.select(rank_words("s")).collect()]


def test_textrank_factored_equals_dense(spark):
    ws = _words(spark, DOC)
    n = len(ws)
    W = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            rank = sum(ws[j].count(w) for w in ws[i])
            if rank:
                norm = math.log(len(ws[i])) + math.log(len(ws[j]))
                W[i, j] = rank if abs(norm) < 1e-12 else rank / norm
    W = W / (W.sum(axis=1)[:, None] + 1e-7)
    M_ = np.full((n, n), 0.15 / n) + 0.85 * W
    p = np.full(n, 1.0 / n)
    for _ in range(30):
        nxt = M_.T @ p
        done = np.linalg.norm(nxt - p) <= 1e-4
        p = nxt
        if done:
            break
    got = [r["score"] for r in R.textrank_scores(_sents(spark, [DOC])).orderBy("i").collect()]
    assert got == pytest.approx(list(p), abs=1e-9)


def test_lexrank_equals_dense(spark):
    ws = _words(spark, DOC)
    n = len(ws)
    tfs = [{t: c / max(Counter(s).values()) for t, c in Counter(s).items()} for s in ws]
    idf = {t: math.log(n / (1 + sum(1 for s in ws if t in s))) for s in ws for t in s}
    A = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            num = sum(tfs[i][t] * tfs[j][t] * idf[t] ** 2 for t in set(ws[i]) & set(ws[j]))
            d1 = sum((tfs[i][t] * idf[t]) ** 2 for t in set(ws[i]))
            d2 = sum((tfs[j][t] * idf[t]) ** 2 for t in set(ws[j]))
            sim = num / (math.sqrt(d1) * math.sqrt(d2)) if d1 > 0 and d2 > 0 else 0.0
            A[i, j] = 1.0 if sim > 0.1 else 0.0
    deg = np.maximum(A.sum(axis=1), 1)
    A = A / deg[:, None]
    p = np.full(n, 1.0 / n)
    for _ in range(20):
        nxt = A.T @ p
        done = np.linalg.norm(nxt - p) <= 0.1
        p = nxt
        if done:
            break
    got = [r["score"] for r in R.lexrank_scores(_sents(spark, [DOC])).orderBy("i").collect()]
    assert got == pytest.approx(list(p), abs=1e-12)


def test_lsa_equals_svd(spark):
    ws = _words(spark, DOC)
    vocab = sorted({w for s in ws for w in s})
    A = np.zeros((len(vocab), len(ws)))
    for j, s in enumerate(ws):
        for w in s:
            A[vocab.index(w), j] += 1
    mx = A.max(axis=0)
    B = np.where(mx > 0, 0.4 + 0.6 * A / np.where(mx > 0, mx, 1), 0.0)
    _, sig, vt = np.linalg.svd(B, full_matrices=False)
    ranks = np.sqrt(((sig[:, None] ** 2) * vt ** 2).sum(axis=0))
    got = [r["score"] for r in R.lsa_scores(_sents(spark, [DOC])).orderBy("i").collect()]
    assert got == pytest.approx(list(ranks), abs=1e-9)


def test_kl_greedy_equals_direct(spark):
    ws = _words(spark, DOC)
    allw = [w for s in ws for w in s]
    pdoc = {w: c / len(allw) for w, c in Counter(allw).items()}
    remaining, summary, order = list(range(len(ws))), [], []
    for _ in range(3):
        kls = []
        for i in remaining:
            joint = Counter(ws[i]) + Counter(w for k in summary for w in ws[k])
            tot = sum(joint.values())
            kls.append(sum(pdoc[w] * math.log(pdoc[w] / (c / tot)) for w, c in joint.items()))
        best = remaining[kls.index(min(kls))]
        order.append(best)
        summary.append(best)
        remaining.remove(best)
    got = {r["i"]: r["score"] for r in R.kl_scores(_sents(spark, [DOC]), 3).collect()}
    assert [i for i, _ in sorted(((i, s) for i, s in got.items() if s > -3), key=lambda t: -t[1])] == order


def test_assemble_ties_and_order(spark):
    s = _sents(spark, [["x one.", "y two.", "z three."]])
    sc = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 2.0)], "doc_id long, i int, score double")
    assert R.assemble(sc, s, 2).first()["summary"] == "y two. z three."
    assert R.assemble(sc, s, 1).first()["summary"] == "y two."


def test_lexrank_prefix_filter_matches_all_pairs(spark):
    """Edges from prefix-filtered candidates equal the brute-force graph."""
    rng = np.random.default_rng(3)
    vocab = ["w" + chr(97 + k) for k in range(12)]
    docs = [[" ".join(rng.choice(vocab, rng.integers(1, 7))) + "." for _ in range(rng.integers(2, 9))] for _ in range(6)]
    s = _sents(spark, docs)
    got = {(r["doc_id"], r["i"], r["j"]) for r in R.lexrank_edges(s).collect()}
    want = set()
    for d, sents in enumerate(docs):
        ws = _words(spark, sents)
        n = len(ws)
        tfs = [{t: c / max(Counter(x).values()) for t, c in Counter(x).items()} for x in ws]
        idf = {t: math.log(n / (1 + sum(1 for x in ws if t in x))) for x in ws for t in x}
        vec = [{t: tfs[i][t] * idf[t] for t in tfs[i]} for i in range(n)]
        nrm = [math.sqrt(sum(v * v for v in x.values())) for x in vec]
        for i in range(n):
            for j in range(n):
                if nrm[i] > 0 and nrm[j] > 0:
                    dot = sum(vec[i][t] * vec[j].get(t, 0.0) for t in vec[i])
                    if dot / (nrm[i] * nrm[j]) > 0.1:
                        want.add((d, i, j))
    assert got == want


def test_rouge_bootstrap_brackets_mean(spark):
    rows = [(f"a b c {k % 4}", f"a b d {k % 3}") for k in range(30)]
    df = pairs(spark, rows)
    mean = M.rouge(df, types=("rouge1",)).first()["rouge1_fmeasure"]
    lo, mid, hi = M.rouge_bootstrap(df, types=("rouge1",), n_resamples=200).first()["rouge1_fmeasure"]
    assert lo <= mean <= hi and lo <= mid <= hi
    again = M.rouge_bootstrap(df, types=("rouge1",), n_resamples=200).first()["rouge1_fmeasure"]
    assert list(again) == [lo, mid, hi]


def test_textrank_spreads_the_mass_of_wordless_sentences(spark):
    rows = R.textrank_scores(_sents(spark, [["the cat sat", "the dog sat", "2019.", "..."]])).collect()
    assert all(r["converged"] for r in rows) and sum(r["score"] for r in rows) == pytest.approx(1.0, abs=1e-4)


def test_pagerank_chain_settles(spark):
    n = 5
    e = spark.createDataFrame([(0, i, j, 1.0) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n], "doc_id long, i int, j int, w double")
    rows = R.pagerank(e, spark.createDataFrame([(0, i) for i in range(n)], "doc_id long, i int")).collect()
    assert all(r["converged"] for r in rows) and sum(r["score"] for r in rows) == pytest.approx(1.0, abs=1e-9)


def test_embedding_textrank_settles_or_says_so(spark):
    """Positive cosines settle and equal the dense iteration; row sums near
    zero do not, and give no scores; ids may be strings."""
    good = [[3.0, 1.0], [2.0, 2.0], [1.0, 3.0], [1.0, 1.0]]
    bad = [[1.0, 0.0], [-1.0, 0.02], [0.02, 1.0], [0.02, -1.0], [1.0, 0.3]]
    rows = [("good", i, v) for i, v in enumerate(good)] + [("bad", i, v) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "doc_id string, i int, vec array<double>")
    got = {(r["doc_id"], r["i"]): r for r in R.embedding_textrank_scores(df, max_rounds=15).collect()}
    u = np.array(good) / np.linalg.norm(good, axis=1)[:, None]
    w = u @ u.T
    np.fill_diagonal(w, 0)
    w = w / w.sum(axis=1)[:, None]
    p = np.full(4, 0.25)
    for _ in range(100):
        nxt = 0.85 * w.T @ p + 0.15 / 4
        settled = np.abs(nxt - p).sum() < 4e-6
        p = nxt
        if settled:
            break
    assert [got["good", i]["score"] for i in range(4)] == pytest.approx(list(p), abs=1e-9)
    assert all(got["good", i]["converged"] for i in range(4))
    assert all(not got["bad", i]["converged"] and got["bad", i]["score"] is None for i in range(5))


def test_custom_ranker(spark):
    before = dict(R.RANKERS)
    undo = R.register_ranker("Shortest", lambda s, n, vectors: s.select("doc_id", "i", (-F.length("sentence")).cast("double").alias("score")))
    s = _sents(spark, [["a long first sentence.", "mid one.", "x."]])
    assert R.summarise(s, "Shortest", 2).first()["summary"] == "mid one. x."
    undo()
    assert R.RANKERS == before


def _ranked(df):
    return sorted((r["doc_id"], r["i"], r["score"]) for r in df.collect())


def test_large_documents_score_like_small_ones(spark):
    """The rounds of joins and the kernels state the same rules."""
    docs = [DOC, ["the cat sat", "the dog sat", "2019.", "...", "a cat and a dog"], ["one two"], ["..."], DOC + DOC]
    s = _sents(spark, docs)
    for small, large in ((R.textrank_scores(s), R.textrank_scores(s, small=(0, 0))), (R.lexrank_scores(s), R.lexrank_scores(s, small=(0, 0))),
                         (R.kl_scores(s, 3), R.kl_scores(s, 3, small=(0, 0))), (R.kl_scores(s, 3, small=(4, 10**6)), R.kl_scores(s, 3))):
        a, b = _ranked(small), _ranked(large)
        assert [x[:2] for x in a] == [x[:2] for x in b] and [x[2] for x in a] == pytest.approx([x[2] for x in b], abs=1e-9)
    e = spark.createDataFrame([(d, i, j, float(i + 1)) for d in (0, 1) for i in range(6) for j in (i - 1, i + 2) if 0 <= j < 6 and i != 3],
                              "doc_id long, i int, j int, w double")
    nodes = spark.createDataFrame([(d, i) for d in (0, 1, 2) for i in range(6)], "doc_id long, i int")
    a, b = _ranked(R.pagerank(e, nodes)), _ranked(R.pagerank(e, nodes, small=0))
    assert len(a) == 18 and [x[2] for x in a] == pytest.approx([x[2] for x in b], abs=1e-12)


def test_metric_of_the_user_is_in_the_grid(spark):
    from precis.plans.flagship import grid

    undo = M.register_metric("Shorter", M.Metric(lambda p, r: {"less": (F.length(p) < F.length(r)).cast("int")}, lambda s, n: s["less"] / n))
    docs = spark.createDataFrame([(1, "One cat sat. Two dogs ran far. The third slept! A fourth one. And so on."), (2, "Only one."), (3, "")],
                                 "doc_id long, text string")
    rows = grid(docs, ["simple", "nothing"], ["Luhn", "KL"], n=1).collect()
    undo()
    assert not M.METRICS and len(rows) == 2 * 2 * 11
    got = {(r["pipeline"], r["model"]): r["value"] for r in rows if r["metric"] == "Shorter"}
    assert len(got) == 4 and got["nothing", "Luhn"] == pytest.approx(1 / 3)


def test_embedding_summary_is_in_score_order(spark):
    s = _sents(spark, [["low", "high", "mid"]])
    sc = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.9), (0, 2, 0.5)], "doc_id long, i int, score double")
    assert R.embedding_textrank_order(sc, s, 2).first()["summary"] == "high. mid"


def test_lcs_is_that_of_the_table():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (list(rng.choice(list("abcd"), rng.integers(0, 40))) for _ in range(2))
        assert M._lcs_one(a, b) == _lcs(a, b)


def test_registered_grid_has_every_cleaning_and_ranker(spark, monkeypatch):
    from precis.operators import rank
    from precis.plans import report_queries as Q

    asked = {}

    def grid(docs, pipelines, models, n=None, vectors=None):
        asked.update(pipelines=pipelines, models=models, n=n, vectors=vectors)
        return spark.createDataFrame([("p", "m", "x", 1.0)], "pipeline string, model string, metric string, value double")

    monkeypatch.setattr(Q, "grid", grid)
    monkeypatch.setattr(Q, "corpus_vectors", lambda docs, embeddings: (embeddings, 3), raising=False)
    assert Q.m8_grid(spark, "/root/testdata/sf0.001").count() == 1
    assert set(asked["pipelines"]) == {"strong", "mid", "simple", "nothing"} and set(asked["models"]) <= set(rank.RANKERS)
    assert len(asked["models"]) == 6 and asked["n"] is None and asked["vectors"] is not None


def test_chain_splits_texts_once(spark, tmp_path):
    from precis.plans.rank_queries import r7_pagerank_chain
    docs = spark.createDataFrame([(1, "One is here. Two is there. Three is gone."), (2, "Only one."), (3, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = r7_pagerank_chain(spark, str(tmp_path))
    assert "documents.parquet" not in out._jdf.queryExecution().optimizedPlan().toString() and "text#" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["doc_id"], r["i"]): r["score"] for r in out.collect()}
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (2, 0)] and got[1, 0] == got[1, 2] < got[1, 1] and abs(got[2, 0] - 1) < 1e-6


def test_overlaps_of_a_batch_equal_the_folds_of_each_row(spark, monkeypatch):
    """The grid's metrics count the n-grams of many rows together; null and empty texts are as in the folds."""
    import io
    from contextlib import redirect_stdout

    monkeypatch.setattr(M, "_OVERLAPS_UDF", [])
    rng = np.random.default_rng(3)
    text = lambda: rng.choice([None, "", " ", *(" ".join(rng.choice(["a", "b", "c'd", "E!", "--", "ünï x"], rng.integers(1, 25))) for _ in range(9))])
    df = spark.createDataFrame([(k % 3, text(), text()) for k in range(150)] + [(9, None, None)], "g int, prediction string, reference string")
    tokens = df.select(whitespace_tokens("prediction").alias("a"), whitespace_tokens("reference").alias("b"),
                       rouge_tokens("prediction").alias("c"), rouge_tokens("reference").alias("d"))
    both = M.overlaps("a", "b", "c", "d")
    fold = M.bleu_stats("a", "b", 4) + M.rouge_scores("c", "d")
    made = M.bleu_stats("a", "b", 4, both) + M.rouge_scores("c", "d", counted=both)
    for r in tokens.select(F.array(*(c.cast("double") for c in fold)).alias("x"), F.array(*(c.cast("double") for c in made)).alias("y")).collect():
        assert r.x == r.y
    assert M._count_overlaps(*[pa.array([], pa.string())] * 4).to_pylist() == []
    monkeypatch.setattr(M, "HELD_BYTES", 8)
    a = pa.array(["a b a", None, "", "b b c", "a"])
    b = pa.array(["b a", "a", "a", "c b b", "a a"])
    assert [list(x.values()) for x in M._count_overlaps(a, b, a, b).to_pylist()] == [
        [2, 1, 0, 0, 2, 1, 2], [0] * 7, [0] * 7, [3, 1, 0, 0, 3, 1, 2], [1, 0, 0, 0, 1, 0, 1]]
    with redirect_stdout(out := io.StringIO()):
        M.evaluate_metrics(df, group_cols=["g"], clean=False).explain(True)
    assert "ArrowEvalPython" in out.getvalue() and "aggregate(" not in out.getvalue()


def test_lexrank_edges_in_tasks_equal_those_of_joins(spark, monkeypatch):
    """Documents that a task holds need no row for each word; rows that share a key, null keys and empty sentences are as in the joins."""
    import io
    from contextlib import redirect_stdout

    rng = np.random.default_rng(8)
    say = lambda: " ".join(rng.choice(list("abcdefghij"), rng.integers(0, 7)))
    rows = [(d, i, say()) for d in range(12) for i in range(int(rng.integers(1, 9)))] + [(None, 0, "a b"), (None, 1, "a b c"), (20, 0, "7"), (20, 1, "")]
    rows += [r for r in rows if r[0] in (2, 3)]
    s = spark.createDataFrame(rows, "doc_id long, i int, sentence string").cache()
    got, want = R.lexrank_edges(s), R._edges_of_words(s, R.LEXRANK_THRESHOLD)
    assert got.schema == want.schema
    found = sorted(tuple(r) for r in got.collect())
    assert found == sorted(tuple(r) for r in want.collect()) and len(found) > 50
    assert found == sorted(tuple(r) for r in R.lexrank_edges(s, small=(4, 1000)).collect())
    with redirect_stdout(out := io.StringIO()):
        got.explain()
    assert "Generate" not in out.getvalue() and "Join" not in out.getvalue()
    x = R.rank_kernels.texts(pa.table({"doc_id": [1, 1, 1, 2, 2, 2], "joined": ["a b", "c d", "e", "a x", "b y", "c"]}), np.array([1, 0, 0] * 2) > 0, np.zeros(6, bool))
    monkeypatch.setattr(R.rank_kernels, "_EDGES", 0)
    assert [a.min() for a, _ in R.rank_kernels.lexrank_edges(0.1)(x)] == [0, 3]
    monkeypatch.setattr(R.rank_kernels, "_BLOCK", 7)  # a few rows and words at a time
    assert [a.tolist() for a, _ in R.rank_kernels.lexrank_edges(0.1)(x)] == [[0, 1], [2], [3, 4], [5]]
