"""All pairs, nearest rows and word vectors against dense numpy."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from precis.operators import embeddings as E
from precis.operators import nearest as N
from precis.operators import rank as R
from precis.operators import vectors as V
from precis.operators.metrics import cosine
from precis.session import table

SF = "/root/testdata/sf0.01"


def dense(m):
    m = np.array(m, float)
    size = np.linalg.norm(m, axis=1)[:, None]
    u = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
    return u @ u.T


@pytest.mark.parametrize("block", [3, N.BLOCK])
def test_pairwise_cosine_equals_the_matrix(spark, block):
    rng = np.random.default_rng(1)
    docs = {d: rng.normal(size=(n, 4)) for d, n in ((1, 1), (2, 7), (3, 10), (None, 4))}
    docs[3][4] = 0
    docs[3][5] = docs[3][6]
    rows = [(d, i, v.tolist()) for d, m in docs.items() for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "doc_id long, i int, vec array<double>").repartition(3)
    got = {(r.doc_id, r.i, r.j): r.cosine for r in N.pairwise_cosine(df, block=block).collect()}
    want = {(d, i, j): c[i, j] for d, m in docs.items() for c in [dense(m)] for i in range(len(m)) for j in range(len(m)) if i != j}
    assert got == pytest.approx(want, abs=1e-12)
    near = {(r.doc_id, r.i, r.j) for r in N.pairwise_cosine(df, least=0.5, block=block).collect()}
    assert near == {k for k, c in want.items() if c >= 0.5}
    top = {(r.doc_id, r.i, r.j) for r in N.pairwise_cosine(df, top=2, block=block).collect()}
    best = set()
    for d, i in {k[:2] for k in want}:
        ranked = sorted((-round(c, 9), k[2]) for k, c in want.items() if k[:2] == (d, i))
        best |= {(d, i, j) for _, j in ranked[:2]}
    assert top == best
    assert N.pairwise_cosine(df.limit(0), top=2).count() == 0


def test_pairwise_cosine_of_all_given_documents(spark):
    docs = table(spark, SF, "documents")
    emb = table(spark, SF, "embeddings")
    vecs = R.sentence_vectors(R.sentence_table(docs), V.word_vectors(docs, "text", emb), V.vector_dim(emb)).cache()
    per = {}
    for r in vecs.collect():
        per.setdefault(r.doc_id, {})[r.i] = r.vec
    got = {r.doc_id: (r.n, r.s) for r in N.pairwise_cosine(vecs, block=100).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum("cosine").alias("s")).collect()}
    for d, m in per.items():
        c = dense([m[i] for i in sorted(m)])
        np.fill_diagonal(c, 0)
        n = len(m) * (len(m) - 1)
        assert (n == 0 and d not in got) or (got[d][0] == n and got[d][1] == pytest.approx(c.sum(), abs=1e-6))


def brute_near(rows, queries, k):
    c = dense([v for _, v in rows])
    out = set()
    for q in queries:
        at = [x for x, _ in rows].index(q)
        ranked = sorted((-round(c[at, j], 9), rows[j][0]) for j in range(len(rows)) if rows[j][0] != q)
        out |= {(q, x) for _, x in ranked[:k]}
    return out


def test_nearest_rows_of_many_queries(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 6))
    v[100:200] = v[100]  # a third of all rows is one vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    queries = list(range(0, 300, 10))
    ask = df.where("id % 10 = 0")
    want = brute_near(rows, queries, 5)
    for block in (16, N.BLOCK):
        assert {(r.query, r.id) for r in N.nearest_exact(df, ask, "id", "v", 5, block).collect()} == want
    index = N.InvertedFile.build(df, "id", "v", lists=8)
    assert index.rows.count() == 300
    assert {(r.query, r.id) for r in index.nearest(ask, "id", "v", 5, probe=8, block=16).collect()} == want  # all lists: exact
    nulls = spark.createDataFrame([(None, [1.0, 0.0]), (1, None), (2, [0.0, 1.0]), (3, [0.0, 2.0])], "id long, v array<double>")
    assert [(r.query, r.id) for r in N.nearest_exact(nulls, nulls, "id", "v").orderBy("query").collect()] == [(2, 3), (3, 2)]
    assert N.nearest_exact(df.limit(0), ask, "id", "v").count() == 0
    assert N.InvertedFile.build(df.limit(0), "id", "v").nearest(ask, "id", "v").count() == 0


def test_inverted_file_recall(spark):
    emb = table(spark, SF, "embeddings")
    ask = emb.where(F.col("vec_id") % 100 == 0)
    exact = {(r.query, r.id) for r in N.nearest_exact(emb, ask, "vec_id", "embedding").collect()}
    found = {(r.query, r.id) for r in N.InvertedFile.build(emb, "vec_id", "embedding").nearest(ask, "vec_id", "embedding").collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def test_inverted_file_asks_few_lists_of_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    hubs = rng.normal(size=(30, 16))
    v = hubs[rng.integers(0, 30, 3000)] + 0.15 * rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(3)
    ask = df.where("id % 100 = 0")
    index = N.InvertedFile.build(df, "id", "v", sample=1000)
    exact = {(r.query, r.id) for r in N.nearest_exact(df, ask, "id", "v").collect()}
    found = {(r.query, r.id) for r in index.nearest(ask, "id", "v").collect()}
    assert index.probe <= len(index.centroids) // 4 and len(found & exact) >= 0.9 * len(exact)


def test_ppmi_and_its_factors(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(words[int(min(39, rng.exponential(9)))] for _ in range(rng.integers(0, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, None), (98, "once")], "doc_id long, text string")
    pairs, seen = Counter(), Counter()
    for t in texts:
        t = t.split()
        seen.update(t)
        for i in range(len(t)):
            for j in range(i + 1, min(len(t), i + 4)):
                pairs[t[i], t[j]] += 1
                pairs[t[j], t[i]] += 1
    pairs = {k: n for k, n in pairs.items() if seen[k[0]] > 1 and seen[k[1]] > 1}
    margin = Counter()
    for (a, _), n in pairs.items():
        margin[a] += n
    total = sum(pairs.values())
    want = {k: w for k, n in pairs.items() if (w := np.log(n * total / (margin[k[0]] * margin[k[1]]))) > 0}
    m = E.ppmi(df, window=3).cache()
    assert {(r.a, r.b): r.weight for r in m.collect()} == pytest.approx(want, abs=1e-9)
    names = sorted({a for a, _ in want})
    full = np.zeros((len(names), len(names)))
    for (a, b), w in want.items():
        full[names.index(a), names.index(b)] = w
    value, basis = np.linalg.eigh(full)
    order = np.argsort(-np.abs(value))
    for dim in (4, 12):
        vec = {r.word: r.vector for r in E.factorise(m, dim, more=12).collect()}
        assert sorted(vec) == names
        x = np.array([vec[w] for w in names])
        first = order[:dim]
        assert (x * x).sum(axis=0) == pytest.approx(np.abs(value[first]), rel=0.02)
        best = np.linalg.norm(full - (basis[:, first] * value[first]) @ basis[:, first].T)
        mine = np.linalg.norm(full - (x * np.sign(value[first])) @ x.T)
        assert mine <= 1.02 * best
    assert E.factorise(m, 32, more=20).count() == len(names)  # more than the rank needs


def test_pairs_of_words_are_counted_in_cells(spark, monkeypatch):
    """Many chunks and cells, repeated texts, words beside themselves and of one occurrence; hashes that meet are drawn again."""
    monkeypatch.setattr(E, "CHUNK", 50)
    monkeypatch.setattr(E, "CELL", 40)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"W{int(rng.exponential(6))}" for _ in range(rng.integers(0, 30))) for _ in range(80)] + ["x y x", None, " ", "ab ab ab", "one"]
    df = spark.createDataFrame([(t,) for t in texts * 2 + ["once w1 w2"]], "text string").repartition(3)
    tokens = [(t or "").lower().split() for t in texts * 2 + ["once w1 w2"]]
    seen, pairs = Counter(w for t in tokens for w in t), Counter()
    for t in tokens:
        for i in range(len(t)):
            for j in range(i + 1, min(len(t), i + 6)):
                pairs[t[i], t[j]] += 1
                pairs[t[j], t[i]] += 1
    assert {(r.a, r.b): r.n for r in E.cooccurrences(df).collect()} == dict(pairs)
    pairs = {k: n for k, n in pairs.items() if seen[k[0]] > 1 and seen[k[1]] > 1}
    margin = Counter()
    for (a, _), n in pairs.items():
        margin[a] += n
    rows = {}
    for (a, b), n in pairs.items():
        if (w := np.log(n * sum(pairs.values()) / (margin[a] * margin[b]))) > 0:
            rows.setdefault(a, []).append(w)
    got = {r.word: (r.contexts, r.total, r.best) for r in E.ppmi_of_words(df).collect()}
    assert got == {a: (len(w), pytest.approx(sum(w)), pytest.approx(max(w))) for a, w in rows.items()}
    counts = E.count_cells(df, min_count=2)
    assert counts.p > 3 and counts.cells.count() == counts.cells.select("cell").distinct().count() > 6  # a row holds a cell


def test_factors_of_a_matrix_in_cells(spark, monkeypatch):
    """They are those of the rows of the table; products are sums over cells and no vector is joined with a pair."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(" ".join(f"w{int(rng.exponential(20))}" for _ in range(40)),) for _ in range(60)] + [("alone",)] * 2, "text string")
    monkeypatch.setattr(E, "SLICE", 7)
    monkeypatch.setattr(E, "HELD_PAIRS", 50)
    matrix = E.cut_lineage(E.ppmi(df), "test-ppmi")
    want = {r.word: np.linalg.norm(r.vector) for r in E.factorise(matrix, 8, more=6).collect()}
    counts = E.count_cells(df, min_count=2)
    got = {r.word: np.linalg.norm(r.vector) for r in E.factorise_cells(counts, 8, more=6).collect()}
    assert "alone" not in got and len(got) > 50 and got == pytest.approx(want, abs=1e-7)


def test_text_vectors_by_block_equal_the_sums_of_each_sentence(spark):
    """Repeated and null keys, repeated words and vectors, null vectors, long documents, many blocks."""
    from precis.operators import text_vectors as T

    rng = np.random.default_rng(3)
    names = [f"w{k}" for k in range(40)]
    docs = [(d, i, " ".join(rng.choice([*names, "zz"], rng.integers(0, 9)))) for d in range(30) for i in range(int(rng.integers(1, 8)))]
    docs += [(5, 0, "w1 w2"), (None, 0, "w1"), (31, 0, "  "), (31, 1, None), (31, 2, "nil zz"), (31, 3, "nil w1"), (31, 4, "gone w1"), (31, 5, "gone")]
    sents = spark.createDataFrame(docs, "doc_id long, i int, sentence string")
    words = spark.createDataFrame([(n, k % 11) for k, n in enumerate(names)] + [("nil", 11), ("gone", 99)], "word string, vec_id long")
    vec = {k: rng.normal(size=3).astype(np.float32) for k in range(11)}
    rows = [(k, v.tolist()) for k, v in vec.items()] + [(3, vec[3].tolist()), (11, None)]
    vectors = T.VectorTable(words, spark.createDataFrame(rows, "vec_id long, vector array<float>"))
    weight = {n: (2 if k % 11 == 3 else 1) * vec[k % 11].astype(float) for k, n in enumerate(names)}
    want = []
    for d, i, s in docs:
        n = len((s or "").split())
        mine = [w for e, j, t in docs if d is not None and (e, j) == (d, i) for w in (t or "").split()]
        v = sum((weight[w] for w in mine if w in weight), np.zeros(3)) / (n + 0.001) if n else np.zeros(3)
        want.append((d, i, [None] * 3 if mine == ["nil", "zz"] else v))
    key = lambda r: (r[0] is None, r[0], r[1])
    got = sorted(((r.doc_id, r.i, r.vec) for r in R.sentence_vectors(sents, vectors, 3).collect()), key=key)
    assert [k[:2] for k in got] == [k[:2] for k in sorted(want, key=key)]
    for a in {k[:2] for k in got}:
        mine, theirs = ([r[2] for r in x if r[:2] == a] for x in (got, want))
        assert (mine == theirs) if None in mine[0] else np.allclose(sorted(map(list, mine)), sorted(map(list, theirs)), atol=1e-6)

    clean = sents.where("doc_id < 31")
    whole = R.sentence_vectors(clean, vectors, 3).cache()
    nxt = whole.selectExpr("doc_id", "i - 1 as i", "vec as nv")
    want = sorted((r.doc_id, r.i, round(r.c, 6)) for r in whole.join(nxt, ["doc_id", "i"]).select("doc_id", "i", cosine("vec", "nv").alias("c")).collect())
    for small in (None, 3):  # all within blocks, and the longer ones by a join
        got = sorted((r.doc_id, r.i, round(r.cosine, 6)) for r in R.adjacent_cosine(clean, vectors, 3, small=small).collect())
        assert len(got) == len(want) and np.allclose(got, want, atol=2e-6)
    once = clean.where("doc_id <> 5")
    for top in (None, 2):
        want = sorted((r.doc_id, r.i, r.j) for r in N.pairwise_cosine(R.sentence_vectors(once, vectors, 3), top=top).collect())
        for block in (N.BLOCK, 3):
            assert sorted((r.doc_id, r.i, r.j) for r in N.pairwise_text_cosine(once, vectors, 3, top=top, block=block).collect()) == want


def test_sentence_vectors_move_texts_and_not_a_vector_for_each_word(spark):
    """No aggregate of dimensions: the only vectors in an exchange are the rows that a block refers to."""
    from precis.operators import text_vectors as T

    sents = spark.createDataFrame([(0, 0, "a b")], "doc_id long, i int, sentence string")
    vectors = T.VectorTable(spark.createDataFrame([("a", 0)], "word string, vec_id long"), spark.createDataFrame([(0, [1.0])], "vec_id long, vector array<float>"))
    plan = R.sentence_vectors(sents, vectors, 1)._jdf.queryExecution().executedPlan().toString()
    assert "sum(" not in plan and "MapInArrow" in plan


def test_tfidf_by_blocks(spark):
    import math

    from precis.operators.vectors import tfidf
    words = ["oak", "elm", "Ash", "fir", "yew", "x", "box!"]
    rows = [(None if k % 13 == 0 else k // 2, None if k % 17 == 0 else " ".join(words[(k * j + j) % 7] for j in range(k % 8))) for k in range(120)]
    want, tf = {}, {}
    for key, text in rows:
        for w in (text or "").lower().replace("!", "").split():
            if len(w) > 1:
                tf.setdefault(key, {}).setdefault(w, 0)
                tf[key][w] += 1
    n = len({key for key, _ in rows})
    for key, counts in tf.items():
        w = {t: c * (math.log(n / sum(t in o for o in tf.values())) + 1) for t, c in counts.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want |= {(key, t): x / norm for t, x in w.items()}
    df = spark.createDataFrame(rows, "id long, text string")
    out = tfidf(df, "id", "text", block_chars=100, held_chars=30)
    assert out.columns == ["id", "term", "weight"]
    got = {(r["id"], r["term"]): r["weight"] for r in out.collect()}
    assert out.count() == len(want) == len(got) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "MapInArrow" in plan


def test_rowwise_cosine_is_made_where_the_vectors_are(spark):
    """No vector of a text leaves its block; rows that share a key add up, null texts and vectors count as zero."""
    import io
    from contextlib import redirect_stdout

    from precis.operators import vectors as V

    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("n", None)], "word string, vector array<float>")
    rows = [(1, 0, "a", "b a"), (1, 1, "a b", "b"), (1, 1, "a", "x"), (2, None, None, "a"), (None, 3, "n", "n a"), (4, 4, "a x", "a a")]
    df = spark.createDataFrame(rows, "k long, t int, prediction string, reference string")
    made = V.rowwise_cosine(df, ["k", "t"], vectors, 2)
    got = {(r.k, r.t): r.cosine for r in made.collect()}
    want = {(1, 0): 2 ** -0.5, (1, 1): 5 ** -0.5, (2, None): 0.0, (None, 3): 0.0, (4, 4): 1.0}
    assert got == pytest.approx(want) and made.count() == len(want)
    with redirect_stdout(out := io.StringIO()):
        made.explain()
    above, _, below = out.getvalue().partition("MapInArrow")
    assert below and "Exchange" not in above and "Aggregate" not in above
