"""Registered ranker queries (R2 to R10, J2, J6) over the sentences of the
whole ``documents`` table, with DuckDB twins.

The oracles restate each ranker in plain relational SQL (iterations are
unrolled, one materialised CTE per round), so they check the Spark plans'
algebra - the factored TextRank, the column-norm LSA, the decomposed KL
divergence - against the direct definitions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import (LEXRANK_THRESHOLD, LSA_SMOOTH, LUHN_MAX_GAP, PAGERANK_ALPHA, PAGERANK_TOL,
                               ROW_NORM_EPS, TEXTRANK_DAMPING, TEXTRANK_EPSILON, LEXRANK_EPSILON)
from ..operators import rank as R
from ..session import cut_lineage, table
from . import duck
from .registry import register

SUMMARY_N = 2
# Rounds that the DuckDB twins unroll: more than any document needs (the twins
# freeze a document when it has settled, and report whether it has).
ROUNDS = 40
CHAIN_ROUNDS = 100
# Scores on a grid (LexRank's are sums of x/deg) often sit exactly on a
# rounding half, where two engines' last-bit differences flip the rounded
# value.  Both sides add the same tiny nudge before rounding to 6 places.
TIE_NUDGE = 1e-12


def _rounded(df):
    more = ["converged"] if "converged" in df.columns else []
    return df.select("doc_id", "i", F.round(F.col("score") + TIE_NUDGE, 6).alias("score"), *more)


def _sents(spark, sf):
    return R.sentence_table(table(spark, sf, "documents"))


def _f(x: float) -> str:
    return f"{x!r}::DOUBLE"


# ------------------------------------------------------------------ SQL parts

BASE = (
    f"sents AS (SELECT doc_id, (k - 1)::BIGINT AS i, s[k] AS sentence FROM "
    f"(SELECT doc_id, {duck.sentences('text')} AS s FROM documents), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS k)), "
    f"rw AS (SELECT doc_id, i, {duck.rank_words('sentence')} AS ws FROM sents), "
    "sw AS (SELECT doc_id, i, len(ws) AS L, unnest(ws) AS w, unnest(range(0, len(ws))) AS pos FROM rw), "
    "wc AS (SELECT doc_id, i, L, w, count(*) AS c FROM sw GROUP BY ALL), "
    "lens AS (SELECT doc_id, i, len(ws) AS L FROM rw), "
    "nd AS (SELECT doc_id, count(*) AS N FROM sents GROUP BY doc_id)"
)


def _unrolled(nodes: str, step, k: int, tol: float, norm: str = "l2", scale_by_n: bool = False) -> str:
    """CTEs x0..xk: per-document iteration with freezing, like ``_iterate``."""
    parts = [f"x0 AS MATERIALIZED (SELECT doc_id, i, N, 1.0 / N AS x, false AS done FROM {nodes})"]
    err = "sqrt(sum((nx - ox) * (nx - ox)))" if norm == "l2" else "sum(abs(nx - ox))"
    stop = f"e.err < {_f(tol)} * e.N" if scale_by_n else f"e.err <= {_f(tol)}"
    for r in range(1, k + 1):
        p = f"x{r - 1}"
        parts.append(step(p, r))
        parts.append(f"u{r} AS (SELECT p.doc_id, p.i, p.N, p.x AS ox, coalesce(n.x, 0.0) AS nx FROM {p} p "
                     f"LEFT JOIN nx{r} n USING (doc_id, i) WHERE NOT p.done)")
        parts.append(f"e{r} AS (SELECT doc_id, {err} AS err, any_value(N) AS N FROM u{r} GROUP BY doc_id)")
        parts.append(f"x{r} AS MATERIALIZED (SELECT doc_id, i, N, x, done FROM {p} WHERE done UNION ALL "
                     f"SELECT u.doc_id, u.i, u.N, u.nx AS x, ({stop}) AS done FROM u{r} u JOIN e{r} e USING (doc_id))")
    return ", ".join(parts)


def _g_sql(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = 1 AND {b} = 1 THEN 1.0 ELSE 1.0 / (ln({a}) + ln({b})) END)"


def _settled_sql(ctes: str, rounds: int) -> str:
    return (f"WITH {ctes} SELECT doc_id, i, CASE WHEN done THEN round(x + {TIE_NUDGE!r}, 6) END AS score, done AS converged "
            f"FROM x{rounds}")


def _scores_sql(ctes: str, final: str) -> str:
    return f"WITH {ctes} SELECT doc_id, i, round(score + {TIE_NUDGE!r}, 6) AS score FROM {final}"


# ------------------------------------------------------------------ R5 Luhn

_LUHN_CTES = (
    BASE + ", sig AS (SELECT doc_id, w FROM sw GROUP BY doc_id, w HAVING count(*) > 1), "
    "sp AS (SELECT sw.* FROM sw SEMI JOIN sig USING (doc_id, w)), "
    "g1 AS (SELECT doc_id, i, pos, pos - lag(pos) OVER (PARTITION BY doc_id, i ORDER BY pos) AS gap FROM sp), "
    f"isl AS (SELECT doc_id, i, pos, sum(CASE WHEN gap > {LUHN_MAX_GAP} THEN 1 ELSE 0 END) OVER "
    "(PARTITION BY doc_id, i ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chunk FROM g1), "
    "ch AS (SELECT doc_id, i, chunk, count(*) AS n, max(pos) - min(pos) + 1 AS span FROM isl GROUP BY ALL), "
    "best AS (SELECT doc_id, i, max(CASE WHEN n > 1 THEN n * n / span ELSE 0.0 END) AS score FROM ch GROUP BY ALL), "
    "luhn AS (SELECT s.doc_id, s.i, coalesce(b.score, 0.0) AS score FROM sents s LEFT JOIN best b USING (doc_id, i))"
)


@register("r5_luhn", _scores_sql(_LUHN_CTES, "luhn"))
def r5_luhn(spark, sf):
    return _rounded(R.luhn_scores(_sents(spark, sf)))


# ------------------------------------------------------------------ R4 LSA

_S = LSA_SMOOTH
_LSA_CTES = (
    BASE + ", vdoc AS (SELECT doc_id, count(DISTINCT w) AS n_doc_words FROM wc GROUP BY doc_id), "
    f"per AS (SELECT doc_id, i, count(*) AS n_words, sum(pow({_f(_S)} + {_f(1 - _S)} * c / mx, 2)) AS sq FROM "
    "(SELECT *, max(c) OVER (PARTITION BY doc_id, i) AS mx FROM wc) GROUP BY doc_id, i), "
    f"lsa AS (SELECT s.doc_id, s.i, coalesce(sqrt({_f(_S * _S)} * (n_doc_words - n_words) + sq), 0.0) AS score FROM sents s "
    "LEFT JOIN per USING (doc_id, i) LEFT JOIN vdoc USING (doc_id))"
)


@register("r4_lsa", _scores_sql(_LSA_CTES, "lsa"))
def r4_lsa(spark, sf):
    return _rounded(R.lsa_scores(_sents(spark, sf)))


# ------------------------------------------------------------------ R6 KL-Sum

def _kl_sql(n: int) -> str:
    parts = [BASE,
             "tot AS (SELECT doc_id, sum(c) AS T FROM wc GROUP BY doc_id)",
             "pw AS (SELECT w1.doc_id, w1.w, w1.tf / tot.T AS p FROM (SELECT doc_id, w, sum(c) AS tf FROM wc GROUP BY ALL) w1 JOIN tot USING (doc_id))",
             "cw AS (SELECT wc.doc_id, wc.i, wc.w, wc.c, pw.p FROM wc JOIN pw USING (doc_id, w))"]
    for r in range(n):
        if r == 0:
            parts.append("rem0 AS (SELECT * FROM lens)")
            parts.append("summ0 AS (SELECT doc_id, w, 0::BIGINT AS s, 0.0 AS p FROM cw WHERE false)")
        else:
            parts.append(f"rem{r} AS (SELECT l.* FROM lens l ANTI JOIN chosen{r - 1} c USING (doc_id, i))")
            parts.append(f"summ{r} AS (SELECT cw.doc_id, cw.w, sum(cw.c) AS s, any_value(cw.p) AS p FROM cw "
                         f"SEMI JOIN chosen{r - 1} c USING (doc_id, i) GROUP BY cw.doc_id, cw.w)")
        parts.append(f"sagg{r} AS (SELECT doc_id, sum(p * ln(p)) AS A, sum(p * ln(s)) AS B, sum(p) AS P, sum(s) AS SL "
                     f"FROM summ{r} GROUP BY doc_id)")
        parts.append(
            f"cand{r} AS (SELECT c.doc_id, c.i, "
            "sum(CASE WHEN m.s IS NULL THEN c.p * ln(c.p) ELSE 0.0 END) AS x1, "
            "sum(CASE WHEN m.s IS NOT NULL THEN c.p * (ln(c.c + m.s) - ln(m.s)) ELSE 0.0 END) AS x2, "
            "sum(CASE WHEN m.s IS NULL THEN c.p * ln(c.c) ELSE 0.0 END) AS x3, "
            "sum(CASE WHEN m.s IS NULL THEN c.p ELSE 0.0 END) AS x4 "
            f"FROM (SELECT cw.* FROM cw SEMI JOIN rem{r} USING (doc_id, i)) c LEFT JOIN summ{r} m USING (doc_id, w) "
            "GROUP BY c.doc_id, c.i)")
        kl = ("(coalesce(A, 0.0) + coalesce(x1, 0.0)) - (coalesce(B, 0.0) + coalesce(x2, 0.0) + coalesce(x3, 0.0)) + "
              "CASE WHEN coalesce(P, 0.0) + coalesce(x4, 0.0) > 0 THEN ln(L + coalesce(SL, 0)) * (coalesce(P, 0.0) + coalesce(x4, 0.0)) ELSE 0.0 END")
        parts.append(f"pick{r} AS (SELECT rem.doc_id, rem.i, {r} AS r FROM rem{r} rem LEFT JOIN cand{r} USING (doc_id, i) "
                     f"LEFT JOIN sagg{r} USING (doc_id) QUALIFY row_number() OVER (PARTITION BY rem.doc_id "
                     f"ORDER BY round({kl}, 9), rem.i) = 1)")
        prev = f"SELECT * FROM chosen{r - 1} UNION ALL " if r > 0 else ""
        parts.append(f"chosen{r} AS MATERIALIZED ({prev}SELECT doc_id, i, r FROM pick{r})")
    parts.append(f"kl AS (SELECT s.doc_id, s.i, coalesce(-c.r, -{n})::DOUBLE AS score FROM sents s "
                 f"LEFT JOIN chosen{n - 1} c USING (doc_id, i))")
    return ", ".join(parts)


@register("r6_kl_sum", _scores_sql(_kl_sql(SUMMARY_N), "kl"))
def r6_kl_sum(spark, sf):
    return _rounded(R.kl_scores(_sents(spark, sf), SUMMARY_N))


# ------------------------------------------------------------------ R2 TextRank

def _textrank_sql(k: int) -> str:
    d = TEXTRANK_DAMPING
    head = (BASE + ", cwl AS (SELECT doc_id, w, L AS Lb, sum(c) AS csum FROM wc GROUP BY ALL), "
            f"rs AS (SELECT wc.doc_id, wc.i, sum(wc.c * {_g_sql('wc.L', 'cwl.Lb')} * cwl.csum) AS rs FROM wc "
            "JOIN cwl USING (doc_id, w) GROUP BY wc.doc_id, wc.i), "
            "nodes AS MATERIALIZED (SELECT s.doc_id, s.i, nd.N, coalesce(rs.rs, 0.0) AS rs FROM sents s "
            "JOIN nd USING (doc_id) LEFT JOIN rs USING (doc_id, i))")

    def step(p: str, r: int) -> str:
        return (
            f"y{r} AS (SELECT x.doc_id, x.i, x.x / (n.rs + {_f(ROW_NORM_EPS)}) AS y FROM {p} x JOIN nodes n USING (doc_id, i) "
            f"WHERE NOT x.done AND n.rs <> 0), "
            f"yw{r} AS (SELECT wc.doc_id, wc.w, wc.L AS Lb, sum(wc.c * y.y) AS Y FROM wc JOIN y{r} y USING (doc_id, i) GROUP BY ALL), "
            f"uu{r} AS (SELECT wc.doc_id, wc.i, sum(wc.c * {_g_sql('wc.L', 'yw.Lb')} * yw.Y) AS u FROM wc "
            f"JOIN yw{r} yw USING (doc_id, w) GROUP BY wc.doc_id, wc.i), "
            f"xs{r} AS (SELECT x.doc_id, sum(x.x) AS X, sum(CASE WHEN n.rs = 0 THEN x.x ELSE 0.0 END) AS D FROM {p} x "
            f"JOIN nodes n USING (doc_id, i) WHERE NOT x.done GROUP BY x.doc_id), "
            f"nx{r} AS (SELECT x.doc_id, x.i, ({_f(1 - d)} * xs.X + {_f(d)} * xs.D) / x.N + {_f(d)} * coalesce(uu.u, 0.0) AS x FROM {p} x "
            f"JOIN xs{r} xs USING (doc_id) LEFT JOIN uu{r} uu USING (doc_id, i) WHERE NOT x.done)")

    return head + ", " + _unrolled("nodes", step, k, TEXTRANK_EPSILON)


@register("r2_textrank", _settled_sql(_textrank_sql(ROUNDS), ROUNDS))
def r2_textrank(spark, sf):
    return _rounded(R.textrank_scores(_sents(spark, sf)))


# ------------------------------------------------------------------ R3 LexRank

def _lexrank_edges_sql() -> str:
    return (
        BASE + ", nw AS (SELECT doc_id, w, count(*) AS nw FROM wc GROUP BY ALL), "
        "idf AS (SELECT nw.doc_id, nw.w, ln(nd.N / (1 + nw.nw)) AS idf FROM nw JOIN nd USING (doc_id)), "
        "tf AS (SELECT wc.doc_id, wc.i, wc.w, wc.c / (max(wc.c) OVER (PARTITION BY wc.doc_id, wc.i)) * idf.idf AS a "
        "FROM wc JOIN idf USING (doc_id, w)), "
        "nrm AS (SELECT doc_id, i, sqrt(sum(a * a)) AS nrm FROM tf GROUP BY ALL), "
        "nz AS (SELECT * FROM tf WHERE a <> 0), "
        "dots AS (SELECT a.doc_id, a.i, b.i AS j, sum(a.a * b.a) AS dot FROM nz a JOIN nz b "
        "ON a.doc_id = b.doc_id AND a.w = b.w AND a.i < b.i GROUP BY ALL), "
        "sim AS (SELECT d.doc_id, d.i, d.j FROM dots d JOIN nrm ni ON ni.doc_id = d.doc_id AND ni.i = d.i "
        "JOIN nrm nj ON nj.doc_id = d.doc_id AND nj.i = d.j WHERE ni.nrm > 0 AND nj.nrm > 0 "
        f"AND d.dot / (ni.nrm * nj.nrm) > {_f(LEXRANK_THRESHOLD)}), "
        "edges AS (SELECT doc_id, i, j FROM sim UNION ALL SELECT doc_id, j, i FROM sim "
        "UNION ALL SELECT doc_id, i, i FROM nrm WHERE nrm > 0)"
    )


def _lexrank_sql(k: int) -> str:
    head = (_lexrank_edges_sql() + ", deg AS (SELECT doc_id, i, count(*) AS deg FROM edges GROUP BY ALL), "
            "we AS MATERIALIZED (SELECT e.doc_id, e.i, e.j, 1.0 / deg.deg AS w FROM edges e JOIN deg USING (doc_id, i)), "
            "nodes AS (SELECT s.doc_id, s.i, nd.N FROM sents s JOIN nd USING (doc_id))")

    def step(p: str, r: int) -> str:
        return (f"nx{r} AS (SELECT x.doc_id, we.j AS i, sum(x.x * we.w) AS x FROM {p} x JOIN we USING (doc_id, i) "
                "WHERE NOT x.done GROUP BY x.doc_id, we.j)")

    return head + ", " + _unrolled("nodes", step, k, LEXRANK_EPSILON)


@register("r3_lexrank", _settled_sql(_lexrank_sql(ROUNDS), ROUNDS))
def r3_lexrank(spark, sf):
    return _rounded(R.lexrank_scores(_sents(spark, sf)))


@register("j2_lexrank_edges",
          "WITH " + _lexrank_edges_sql() + " SELECT doc_id, i::BIGINT AS i, j::BIGINT AS j FROM edges")
def j2_lexrank_edges(spark, sf):
    """The sentence graph (equi-join on document, theta on position),
    built from shared informative words and mirrored."""
    e = R.lexrank_edges(_sents(spark, sf))
    return e.select("doc_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))


# ------------------------------------------------------------------ R7 PageRank

def _chain_sql(k: int) -> str:
    a = PAGERANK_ALPHA
    head = (BASE + ", ce AS (SELECT doc_id, i, i + 1 AS j, 1.0 AS w FROM sents s WHERE EXISTS "
            "(SELECT 1 FROM sents t WHERE t.doc_id = s.doc_id AND t.i = s.i + 1)), "
            "edges AS (SELECT doc_id, i, j, w FROM ce UNION ALL SELECT doc_id, j, i, w FROM ce), "
            "ws AS (SELECT doc_id, i, sum(w) AS ws FROM edges GROUP BY ALL), "
            "nodes AS MATERIALIZED (SELECT s.doc_id, s.i, nd.N, coalesce(ws.ws, 0.0) AS ws FROM sents s JOIN nd USING (doc_id) "
            "LEFT JOIN ws USING (doc_id, i)), "
            "wn AS (SELECT e.doc_id, e.i, e.j, e.w / ws.ws AS p FROM edges e JOIN ws USING (doc_id, i) WHERE ws.ws <> 0)")

    def step(p: str, r: int) -> str:
        return (
            f"dg{r} AS (SELECT x.doc_id, sum(CASE WHEN n.ws = 0 THEN x.x ELSE 0.0 END) AS D FROM {p} x "
            f"JOIN nodes n USING (doc_id, i) WHERE NOT x.done GROUP BY x.doc_id), "
            f"fl{r} AS (SELECT x.doc_id, wn.j AS i, sum(x.x * wn.p) AS f FROM {p} x JOIN wn USING (doc_id, i) "
            f"WHERE NOT x.done GROUP BY x.doc_id, wn.j), "
            f"nx{r} AS (SELECT x.doc_id, x.i, {_f(a)} * (coalesce(fl.f, 0.0) + dg.D / x.N) + {_f(1 - a)} / x.N AS x "
            f"FROM {p} x JOIN dg{r} dg USING (doc_id) LEFT JOIN fl{r} fl USING (doc_id, i) WHERE NOT x.done)")

    return head + ", " + _unrolled("nodes", step, k, PAGERANK_TOL, norm="l1", scale_by_n=True)


@register("r7_pagerank_chain", _settled_sql(_chain_sql(CHAIN_ROUNDS), CHAIN_ROUNDS))
def r7_pagerank_chain(spark, sf):
    """R7 on each document's sentence chain (i -- i+1, weight 1).  The texts are
    split once: the positions of the sentences are written, and all else is made of them."""
    s = cut_lineage(_sents(spark, sf).select("doc_id", "i"), "positions")
    nxt = s.select("doc_id", (F.col("i") - 1).alias("i")).join(s.select("doc_id", "i"), ["doc_id", "i"], "left_semi")
    ce = nxt.select("doc_id", "i", (F.col("i") + 1).alias("j"), F.lit(1.0).alias("w"))
    edges = ce.unionByName(ce.select("doc_id", F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    return _rounded(R.pagerank(edges, s.select("doc_id", "i")))


# ------------------------------------------------------------------ F11 + R8 + R9, J6, R10

@register("r8_assemble_luhn",
          "WITH " + _LUHN_CTES + f", top AS (SELECT doc_id, i FROM luhn QUALIFY row_number() OVER (PARTITION BY doc_id "
          f"ORDER BY round(score, 9) DESC, i) <= {SUMMARY_N}) "
          "SELECT t.doc_id, 'Luhn' AS model, string_agg(s.sentence, ' ' ORDER BY t.i) AS summary FROM top t "
          "JOIN sents s USING (doc_id, i) GROUP BY t.doc_id")
def r8_assemble_luhn(spark, sf):
    """F11 (top n, ties to the earlier sentence) + R8 (document order, ' ')
    + R9 (model name column)."""
    s = cut_lineage(_sents(spark, sf), "sentences")  # counted, ranked and joined back
    return R.assemble(R.luhn_scores(s), s, SUMMARY_N).select("doc_id", F.lit("Luhn").alias("model"), "summary")


@register("j6_rank_clean_emit_raw",
          "WITH " + _LSA_CTES.replace(f"(SELECT doc_id, {duck.sentences('text')} AS s FROM documents)",
                                      f"(SELECT doc_id, list_transform({duck.sentences('text')}, lambda z: {duck.simple('z')}) AS s FROM documents)")
          + f", top AS (SELECT doc_id, i FROM lsa QUALIFY row_number() OVER (PARTITION BY doc_id "
          f"ORDER BY round(score, 9) DESC, i) <= {SUMMARY_N}), "
          f"raw AS (SELECT doc_id, (k - 1)::BIGINT AS i, s[k] AS sentence FROM (SELECT doc_id, {duck.sentences('text')} AS s "
          "FROM documents), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS k)) "
          "SELECT t.doc_id, string_agg(r.sentence, ' ' ORDER BY t.i) AS summary FROM top t JOIN raw r USING (doc_id, i) GROUP BY t.doc_id")
def j6_rank_clean_emit_raw(spark, sf):
    """Rank the cleaned sentences (T13 keeps positions), emit the raw
    ones by joining back on (doc_id, i)."""
    from ..functions.cleaning import simple
    from ..functions.text import map_sentences, split_sentences
    d = table(spark, sf, "documents")
    raw = cut_lineage(R.sentence_table(d), "sentences")
    clean = d.select("doc_id", F.posexplode(map_sentences(split_sentences("text"), simple().column)).alias("i", "sentence"))
    return R.assemble(R.lsa_scores(cut_lineage(clean, "cleaned")), raw, SUMMARY_N)


@register("r10_summary_size",
          f"SELECT ceil(avg(len({duck.sentences('text')})))::BIGINT AS n_sentences FROM conversations WHERE role = 'assistant'")
def r10_summary_size(spark, sf):
    """Sentences of the mean reference summary; the assistant's turns are the references."""
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    return c.agg(R.summary_size(F.col("text")).cast("long").alias("n_sentences"))
