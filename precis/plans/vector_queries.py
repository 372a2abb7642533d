"""Registered vector queries.

Word vectors come from the ``embeddings`` table: every lower-case word of
the corpus takes the row ``md5(word)[0:8] mod count(embeddings)``.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.fixed import PAGERANK_ALPHA, PAGERANK_TOL, VECTOR_DIVISOR_EPS
from ..functions.text import whitespace_tokens
from ..operators import embeddings as E
from ..operators import nearest as N
from ..operators import rank as R
from ..operators import vectors as V
from ..session import cut_lineage, table
from ..sources.corpus import conversation_pairs
from . import duck
from .rank_queries import BASE, ROUNDS, TIE_NUDGE, _f, _unrolled
from .registry import register


def _r6(c):
    return F.round(c + TIE_NUDGE, 6)


def _rs(x: str) -> str:
    return f"round({x} + {TIE_NUDGE!r}, 6)"


def _wv_sql(src: str) -> str:
    """CTE ``wv(word, vector)`` for the lower-case words of ``src`` (a query
    with a ``text`` column)."""
    return (f"vocab AS (SELECT DISTINCT unnest({duck.ws_tokens('lower(text)')}) AS word FROM ({src})), "
            "wv AS (SELECT v.word, e.embedding AS vector FROM vocab v JOIN embeddings e ON "
            "e.vec_id = ('0x' || substr(md5(v.word), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings))")


def _sv_sql(sents: str, keys: str) -> str:
    """CTE ``sv(keys, d, v)``: E1 vectors exploded by dimension (only
    dimensions of texts with at least one known word)."""
    return (f"st AS (SELECT {keys}, {duck.ws_tokens('sentence')} AS t FROM {sents}), "
            f"sx AS (SELECT {keys}, len(t) AS n, unnest(t) AS word FROM st), "
            f"hit AS (SELECT sx.*, wv.vector FROM sx JOIN wv USING (word)), "
            f"dims AS (SELECT {keys}, n, unnest(vector)::DOUBLE AS v, unnest(range(1, len(vector) + 1)) AS d FROM hit), "
            f"sv AS (SELECT {keys}, d, sum(v) / (any_value(n) + {_f(VECTOR_DIVISOR_EPS)}) AS v FROM dims GROUP BY {keys}, d)")


def _doc_vectors(spark, sf):
    docs = table(spark, sf, "documents")
    emb = table(spark, sf, "embeddings")
    return V.word_vectors(docs, "text", emb), V.vector_dim(emb)


def _sentences(spark, sf):
    """Sentences, the words' rows among the embeddings, their dimension, and the characters."""
    docs = table(spark, sf, "documents")
    emb = table(spark, sf, "embeddings")
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0]
    words, rows = V.word_ids(docs, "text", emb)
    return R.sentence_table(docs), V.VectorTable(cut_lineage(words, "words"), rows), V.vector_dim(emb), chars


def _fingerprint(vec):
    """Norm and a position-weighted sum: two numbers that pin a vector."""
    l2 = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, v: a + v * v))
    ws = F.aggregate(F.zip_with(vec, F.sequence(F.lit(1), F.size(vec)), lambda v, d: v * d), F.lit(0.0), lambda a, v: a + v)
    return l2, ws


_DOC_WV = _wv_sql("SELECT text FROM documents")


@register("e1_sentence_vectors",
          "WITH " + BASE + ", " + _DOC_WV + ", " + _sv_sql("sents", "doc_id, i")
          + ", fp AS (SELECT doc_id, i, sqrt(sum(v * v)) AS l2, sum(v * d) AS ws FROM sv GROUP BY doc_id, i) "
          f"SELECT s.doc_id, s.i, {_rs('coalesce(fp.l2, 0.0)')} AS l2, {_rs('coalesce(fp.ws, 0.0)')} AS ws "
          "FROM sents s LEFT JOIN fp USING (doc_id, i)")
def e1_sentence_vectors(spark, sf):
    """E1 (+ J1 inside): mean-like sentence vectors, reported as (norm,
    position-weighted sum) per sentence."""
    sents, wv, dim, chars = _sentences(spark, sf)
    v = R.sentence_vectors(sents, wv, dim, chars)
    l2, ws = _fingerprint(F.col("vec"))
    return v.select("doc_id", "i", _r6(l2).alias("l2"), _r6(ws).alias("ws"))


@register("e2_adjacent_cosine",
          "WITH " + BASE + ", " + _DOC_WV + ", " + _sv_sql("sents", "doc_id, i")
          + ", nrm AS (SELECT doc_id, i, sqrt(sum(v * v)) AS nrm FROM sv GROUP BY ALL), "
          "dot AS (SELECT a.doc_id, a.i, sum(a.v * b.v) AS dot FROM sv a JOIN sv b ON a.doc_id = b.doc_id AND b.i = a.i + 1 "
          "AND a.d = b.d GROUP BY a.doc_id, a.i), "
          "pairs AS (SELECT s.doc_id, s.i FROM sents s SEMI JOIN sents t ON t.doc_id = s.doc_id AND t.i = s.i + 1) "
          f"SELECT p.doc_id, p.i, {_rs('CASE WHEN na.nrm > 0 AND nb.nrm > 0 THEN coalesce(dot.dot, 0.0) / (na.nrm * nb.nrm) ELSE 0.0 END')} AS cosine "
          "FROM pairs p LEFT JOIN dot USING (doc_id, i) LEFT JOIN nrm na ON na.doc_id = p.doc_id AND na.i = p.i "
          "LEFT JOIN nrm nb ON nb.doc_id = p.doc_id AND nb.i = p.i + 1")
def e2_adjacent_cosine(spark, sf):
    """E2 for given sentence pairs (here each sentence and the next): cosine
    with 0 for a zero vector.  The full N x N matrix is never built; R1 uses
    its algebraic form instead."""
    sents, wv, dim, chars = _sentences(spark, sf)
    return R.adjacent_cosine(sents, wv, dim, chars).select("doc_id", "i", _r6(F.col("cosine")).alias("cosine"))


# ------------------------------------------------------------------ M5 / E3 on pairs

_PAIR_SRC = "SELECT text FROM conversations"


def _pairs_sv() -> str:
    return ("pairs AS (" + duck.PAIRS + "), " + _wv_sql(_PAIR_SRC) + ", "
            "pt AS (SELECT conv_id, turn, 0 AS side, prediction AS sentence FROM pairs UNION ALL "
            "SELECT conv_id, turn, 1 AS side, reference AS sentence FROM pairs), "
            + _sv_sql("pt", "conv_id, turn, side")
            + ", nrm AS (SELECT conv_id, turn, side, sqrt(sum(v * v)) AS nrm FROM sv GROUP BY ALL), "
            "dot AS (SELECT a.conv_id, a.turn, sum(a.v * b.v) AS dot FROM sv a JOIN sv b ON a.conv_id = b.conv_id "
            "AND a.turn = b.turn AND a.d = b.d AND a.side = 0 AND b.side = 1 GROUP BY ALL), "
            "cos AS (SELECT p.conv_id, p.turn, CASE WHEN na.nrm > 0 AND nb.nrm > 0 THEN coalesce(dot.dot, 0.0) / (na.nrm * nb.nrm) "
            "ELSE 0.0 END AS c FROM pairs p LEFT JOIN dot USING (conv_id, turn) "
            "LEFT JOIN nrm na ON na.conv_id = p.conv_id AND na.turn = p.turn AND na.side = 0 "
            "LEFT JOIN nrm nb ON nb.conv_id = p.conv_id AND nb.turn = p.turn AND nb.side = 1)")


def _pair_vectors(spark, sf):
    conv = table(spark, sf, "conversations")
    emb = table(spark, sf, "embeddings")
    return conversation_pairs(conv), V.word_ids(conv, "text", emb), V.vector_dim(emb)


@register("e3_rowwise_cosine", "WITH " + _pairs_sv() + f" SELECT conv_id, turn, {_rs('c')} AS cosine FROM cos")
def e3_rowwise_cosine(spark, sf):
    pairs, wv, dim = _pair_vectors(spark, sf)
    return V.rowwise_cosine(pairs, ["conv_id", "turn"], wv, dim).select("conv_id", "turn", _r6(F.col("cosine")).alias("cosine"))


@register("m5_glove_cosine", "WITH " + _pairs_sv() + f" SELECT {_rs('avg(c)')} AS glove_cosine FROM cos")
def m5_glove_cosine(spark, sf):
    pairs, wv, dim = _pair_vectors(spark, sf)
    return V.glove_cosine(pairs, ["conv_id", "turn"], wv, dim).select(_r6(F.col("glove_cosine")).alias("glove_cosine"))


# ------------------------------------------------------------------ J1

@register("j1_lookup_default",
          "WITH " + _DOC_WV + f", w AS (SELECT DISTINCT unnest({duck.ws_tokens('text')}) AS word FROM "
          "(SELECT text FROM documents UNION ALL SELECT text FROM benchmark)) "
          f"SELECT w.word, (wv.word IS NOT NULL) AS known, "
          f"{_rs('coalesce(sqrt(list_dot_product(wv.vector::DOUBLE[], wv.vector::DOUBLE[])), 0.0)')} AS norm "
          "FROM w LEFT JOIN wv USING (word)")
def j1_lookup_default(spark, sf):
    """Word -> vector with a zero default for all words of documents and
    benchmark (case-sensitive, as the lookup table is lower-case)."""
    wv, dim = _doc_vectors(spark, sf)
    texts = table(spark, sf, "documents").select("text").unionByName(table(spark, sf, "benchmark").select("text"))
    words = texts.select(F.explode(whitespace_tokens("text")).alias("word")).distinct()
    looked = V.lookup_with_default(words, wv.withColumn("known", F.lit(True)), dim)
    known = words.join(wv.select("word", F.lit(True).alias("known")), "word", "left")
    l2, _ = _fingerprint(F.col("vector"))
    return looked.join(known, "word").select("word", F.coalesce("known", F.lit(False)).alias("known"), _r6(l2).alias("norm"))


# ------------------------------------------------------------------ E4, E5

_TERMS = ("list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda t: length(t) >= 2)")


@register("e4_bag_of_words",
          f"SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY ALL")
def e4_bag_of_words(spark, sf):
    return V.bag_of_words(table(spark, sf, "documents"), "doc_id", "text")


@register("e5_tfidf",
          f"WITH b AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY ALL), "
          "n AS (SELECT count(DISTINCT doc_id) AS n FROM documents), "
          "df AS (SELECT term, count(*) AS df FROM b GROUP BY term), "
          "w AS (SELECT b.doc_id, b.term, b.tf * (ln(n.n / df.df) + 1) AS w FROM b JOIN df USING (term), n) "
          f"SELECT doc_id, term, {_rs('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))')} AS weight FROM w")
def e5_tfidf(spark, sf):
    t = V.tfidf(table(spark, sf, "documents"), "doc_id", "text")
    return t.select("doc_id", "term", _r6(F.col("weight")).alias("weight"))


# ------------------------------------------------------------------ E6, E7

@register("e6_word2vec",
          f"SELECT word, 50::BIGINT AS size FROM (SELECT unnest({duck.ws_tokens('lower(text)')}) AS word FROM documents) "
          "GROUP BY word HAVING count(*) >= 2")
def e6_word2vec(spark, sf):
    """Word2Vec (window 10, min count 2) trained on the documents, in as many
    partitions as the session has cores.  The vectors depend on the
    distributed training; the words and their vectors' size do not."""
    docs = table(spark, sf, "documents")
    model = V.train_word2vec(docs, "text", dim=50, partitions=spark.sparkContext.defaultParallelism)
    return model.getVectors().select("word", F.size(vector_to_array("vector")).cast("long").alias("size"))


@register("e7_nearest",
          "WITH q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0) "
          "SELECT vec_id, cosine FROM (SELECT e.vec_id, "
          "round(list_dot_product(e.embedding::DOUBLE[], q.qv) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) "
          "* sqrt(list_dot_product(q.qv, q.qv))), 6) AS cosine, "
          "list_dot_product(e.embedding::DOUBLE[], q.qv) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) "
          "* sqrt(list_dot_product(q.qv, q.qv))) AS raw FROM embeddings e, q WHERE e.vec_id <> 0) "
          "ORDER BY raw DESC, vec_id LIMIT 10")
def e7_nearest(spark, sf):
    """Top 10 vectors by cosine to vector 0 (the limit is the feature)."""
    emb = table(spark, sf, "embeddings")
    top = V.nearest(emb, "vec_id", "embedding", emb.where(F.col("vec_id") == 0), 10)
    return top.select("vec_id", F.round("cosine", 6).alias("cosine"))


_COS = "CASE WHEN a.nrm > 0 AND b.nrm > 0 THEN list_dot_product(a.v, b.v) / (a.nrm * b.nrm) ELSE 0.0 END"


@register("e2_pairwise_top",
          "WITH " + BASE + ", " + _DOC_WV + ", " + _sv_sql("sents", "doc_id, i")
          + ", lv AS MATERIALIZED (SELECT s.doc_id, s.i, coalesce(x.v, (SELECT list_transform(any_value(vector), lambda z: 0.0::DOUBLE) FROM wv)) AS v, "
          "coalesce(x.nrm, 0.0) AS nrm FROM sents s LEFT JOIN (SELECT doc_id, i, list(v ORDER BY d) AS v, sqrt(sum(v * v)) AS nrm FROM sv GROUP BY ALL) x "
          "USING (doc_id, i)), "
          f"pc AS (SELECT a.doc_id, a.i, b.i AS j, {_COS} AS c FROM lv a JOIN lv b ON a.doc_id = b.doc_id AND a.i <> b.i) "
          f"SELECT doc_id, i::BIGINT AS i, {_rs('sum(c)')} AS total, {_rs('max(c)')} AS best FROM "
          "(SELECT * FROM pc QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY round(c, 9) DESC, j) <= 5) GROUP BY doc_id, i")
def e2_pairwise_top(spark, sf):
    """The five sentences of the document most similar to each, as the sum
    and the largest of their cosines (which of equal ones is taken does not matter)."""
    sents, wv, dim, chars = _sentences(spark, sf)
    top = N.pairwise_text_cosine(sents, wv, dim, top=5, chars=chars)
    return top.groupBy("doc_id", F.col("i").cast("long").alias("i")).agg(_r6(F.sum("cosine")).alias("total"), _r6(F.max("cosine")).alias("best"))


_NEAR_COS = ("list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) "
             "* sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))")


@register("e7_many_nearest",
          f"SELECT query, id, round(c, 6) AS cosine FROM (SELECT q.vec_id AS query, e.vec_id AS id, {_NEAR_COS} AS c FROM embeddings q "
          "JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0) "
          "QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, id) <= 10")
def e7_many_nearest(spark, sf):
    """The ten nearest of every vector whose id is divisible by 100, against all rows."""
    emb = table(spark, sf, "embeddings")
    near = N.nearest_exact(emb, emb.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding", 10)
    return near.select("query", "id", F.round("cosine", 6).alias("cosine"))


@register("e7_inverted_file")
def e7_inverted_file(spark, sf):
    """The same through an index of all rows (recall measured in the tests)."""
    emb = table(spark, sf, "embeddings")
    near = N.InvertedFile.build(emb, "vec_id", "embedding").nearest(emb.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding", 10)
    return near.select("query", "id", F.round("cosine", 6).alias("cosine"))


_WINDOW = 5


@register("e6_ppmi",
          f"WITH t AS (SELECT {duck.ws_tokens('lower(text)')} AS t FROM documents), "
          "kept AS (SELECT w FROM (SELECT unnest(t) AS w FROM t) GROUP BY w HAVING count(*) >= 2), "
          f"pairs AS (SELECT t[i] AS a, t[i + d] AS b FROM (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM t), range(1, {_WINDOW + 1}) r(d) WHERE i + d <= len(t)), "
          "co AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs) GROUP BY a, b), "
          "kp AS MATERIALIZED (SELECT * FROM co WHERE a IN (SELECT w FROM kept) AND b IN (SELECT w FROM kept)), "
          "mg AS MATERIALIZED (SELECT a AS w, sum(n) AS n FROM kp GROUP BY a), "
          "pm AS (SELECT kp.a, kp.b, ln(kp.n * (SELECT sum(n) FROM mg) / (x.n::DOUBLE * y.n)) AS weight FROM kp JOIN mg x ON x.w = kp.a JOIN mg y ON y.w = kp.b) "
          f"SELECT a AS word, count(*) AS contexts, {_rs('sum(weight)')} AS total, {_rs('max(weight)')} AS best FROM pm WHERE weight > 0 GROUP BY a")
def e6_ppmi(spark, sf):
    """The mutual information of words in a window, summed up for each word."""
    m = E.ppmi_of_words(table(spark, sf, "documents"), window=_WINDOW)
    return m.select("word", "contexts", _r6(F.col("total")).alias("total"), _r6(F.col("best")).alias("best"))


@register("e6_ppmi_vectors")
def e6_ppmi_vectors(spark, sf):
    """Word vectors by factorising that table (its error is tested)."""
    v = E.ppmi_vectors(table(spark, sf, "documents"), window=_WINDOW, dim=32)
    return v.select("word", F.size("vector").cast("long").alias("size"), F.round(F.sqrt(F.aggregate(
        "vector", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


# ------------------------------------------------------------------ R1

def _r1_sql(k: int) -> str:
    a = PAGERANK_ALPHA
    head = ("WITH " + BASE + ", " + _DOC_WV.replace("e.embedding AS vector", "list_transform(e.embedding, lambda z: abs(z)) AS vector")
            + ", " + _sv_sql("sents", "doc_id, i") + ", nrm AS (SELECT doc_id, i, sqrt(sum(v * v)) AS nrm FROM sv GROUP BY ALL), "
            "u AS MATERIALIZED (SELECT sv.doc_id, sv.i, sv.d, sv.v / nrm.nrm AS u FROM sv JOIN nrm USING (doc_id, i) WHERE nrm.nrm > 0), "
            "tv AS (SELECT doc_id, d, sum(u) AS t FROM u GROUP BY ALL), "
            "uu AS (SELECT doc_id, i, sum(u * u) AS uu FROM u GROUP BY ALL), "
            "ut AS (SELECT u.doc_id, u.i, sum(u.u * tv.t) AS ut FROM u JOIN tv USING (doc_id, d) GROUP BY ALL), "
            "nodes AS MATERIALIZED (SELECT s.doc_id, s.i, nd.N, coalesce(ut.ut, 0.0) - coalesce(uu.uu, 0.0) AS S, "
            "coalesce(uu.uu, 0.0) AS uu FROM sents s JOIN nd USING (doc_id) LEFT JOIN ut USING (doc_id, i) LEFT JOIN uu USING (doc_id, i))")

    def step(p: str, r: int) -> str:
        dang = f"abs(n.S) <= {_f(R.DANGLING_EPS)}"
        return (
            f"y{r} AS (SELECT x.doc_id, x.i, x.N, CASE WHEN {dang} THEN 0.0 ELSE x.x / n.S END AS y, "
            f"CASE WHEN {dang} THEN x.x ELSE 0.0 END AS dx, n.uu FROM {p} x JOIN nodes n USING (doc_id, i) WHERE NOT x.done), "
            f"dg{r} AS (SELECT doc_id, sum(dx) AS D FROM y{r} GROUP BY doc_id), "
            f"yv{r} AS (SELECT u.doc_id, u.d, sum(y.y * u.u) AS yv FROM u JOIN y{r} y USING (doc_id, i) GROUP BY ALL), "
            f"ln{r} AS (SELECT u.doc_id, u.i, sum(u.u * yv.yv) AS l FROM u JOIN yv{r} yv USING (doc_id, d) GROUP BY ALL), "
            f"nx{r} AS (SELECT y.doc_id, y.i, {_f(a)} * ((coalesce(l.l, 0.0) - y.y * y.uu) + dg.D / y.N) + {_f(1 - a)} / y.N AS x "
            f"FROM y{r} y JOIN dg{r} dg USING (doc_id) LEFT JOIN ln{r} l USING (doc_id, i))")

    body = _unrolled("nodes", step, k, PAGERANK_TOL, norm="l1", scale_by_n=True)
    return head + ", " + body + f" SELECT doc_id, i, CASE WHEN done THEN {_rs('x')} END AS score, done AS converged FROM x{k}"


@register("r1_embedding_textrank", _r1_sql(ROUNDS))
def r1_embedding_textrank(spark, sf):
    """PageRank over the cosine graph of sentence vectors (no pairs).

    The ``embeddings`` rows are random directions, whose cosines cancel; as a
    stand-in for word vectors their components are taken without sign, so that
    cosines are positive, as those of texts in one language are."""
    sents, wv, dim, chars = _sentences(spark, sf)
    wv = wv._replace(table=wv.table.withColumn("vector", F.transform("vector", lambda c: F.abs(c))))
    s = R.embedding_textrank(sents, wv, dim, chars=chars)
    return s.select("doc_id", F.col("i").cast("long").alias("i"), _r6(F.col("score")).alias("score"), "converged")
