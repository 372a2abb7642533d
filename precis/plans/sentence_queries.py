"""Registered queries on blocks of a text, the trained sentence splitter and the
suffix-stripping stemmer (T7, T11, R4, R5), with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import porter as P
from ..functions.cleaning import normalize_words
from ..functions.text import whitespace_tokens
from ..operators import rank as R
from ..operators import sentences as S
from ..session import cut_lineage, table
from . import duck
from .rank_queries import _LSA_CTES, _LUHN_CTES, BASE, TIE_NUDGE
from .registry import register

# ------------------------------------------------------------------ headings and paragraphs


def _blocks_sql() -> str:
    blanks = "' ' || chr(9) || chr(11) || chr(12)"
    lines = f"list_transform(regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\r]'), lambda x: trim(x, {blanks}))"
    marked = (f"array_to_string(list_transform({lines}, lambda x: CASE WHEN x = '' THEN chr(2) WHEN upper(x) = x AND lower(x) <> x "
              "THEN chr(3) || chr(4) || x || chr(3) ELSE x END), ' ')")
    paragraphs = (f"list_filter(list_transform(string_split({marked}, chr(2)), lambda p: list_filter(list_transform("
                  "string_split(p, chr(3)), lambda b: trim(b)), lambda b: b <> '')), lambda p: len(p) > 0)")
    one = "{'paragraph': k - 1, 'heading': true, 'sentence': b[2:]}"
    each = "{'paragraph': k - 1, 'heading': false, 'sentence': z}"
    bs = (f"flatten(list_transform({paragraphs}, lambda p, k: flatten(list_transform(p, lambda b: CASE WHEN b[1] = chr(4) THEN [{one}] "
          f"ELSE list_transform({duck.sentences('b')}, lambda z: {each}) END))))")
    return (f"bt AS MATERIALIZED (SELECT doc_id, unnest(bs) AS x, unnest(range(len(bs)))::BIGINT AS i FROM (SELECT doc_id, {bs} AS bs FROM documents)), "
            "sents AS (SELECT doc_id, i, x.sentence AS sentence FROM bt WHERE NOT x.heading), ")


_AFTER = BASE[BASE.index("rw AS"):]


@register("rank_blocks",
          "WITH " + _blocks_sql() + _AFTER + _LSA_CTES[len(BASE):] + _LUHN_CTES[len(BASE):]
          + f" SELECT bt.doc_id, bt.i, x.paragraph::INT AS paragraph, x.heading AS heading, round(lsa.score + {TIE_NUDGE!r}, 6) AS lsa, "
          f"round(luhn.score + {TIE_NUDGE!r}, 6) AS luhn FROM bt LEFT JOIN lsa USING (doc_id, i) LEFT JOIN luhn USING (doc_id, i)")
def rank_blocks(spark, sf):
    """Sentences by paragraph; headings are listed and left out of the ranking."""
    blocks = cut_lineage(S.block_table(table(spark, sf, "documents")), "blocks")  # read by both rankers
    sents = blocks.where(~F.col("heading")).select("doc_id", "i", "sentence")
    scores = lambda df, name: df.select("doc_id", "i", F.round(F.col("score") + TIE_NUDGE, 6).alias(name))
    out = blocks.join(scores(R.lsa_scores(sents), "lsa"), ["doc_id", "i"], "left").join(scores(R.luhn_scores(sents), "luhn"), ["doc_id", "i"], "left")
    return out.select("doc_id", F.col("i").cast("long").alias("i"), "paragraph", "heading", "lsa", "luhn")


# ------------------------------------------------------------------ T7

def porter_sql(x: str) -> str:
    """The stemmer over one word as nested list lambdas."""
    marked = lambda w: f"regexp_replace({w}, '{P.CONSONANT_Y[0]}', '\\1{P.CONSONANT_Y[1]}', 'g')"
    measure = lambda w: f"len(regexp_extract_all({marked(w)}, '{P.VOWEL_RUN}'))"
    vowel = lambda w: f"regexp_matches({marked(w)}, '{P.VOWEL}')"
    short = lambda w: f"regexp_matches({marked(w)}, '{P.SHORT_END}')"
    cut = lambda w, n: f"substr({w}, 1, length({w}) - {n})"
    last = lambda w: f"substr({w}, length({w}), 1)"
    double = lambda w: f"(length({w}) > 1 AND {last(w)} = substr({w}, length({w}) - 1, 1) AND NOT regexp_matches({w}, '[aeiou]$'))"

    def longest(rules, met) -> str:
        arms = [f"WHEN ends_with(w, '{s}') THEN CASE WHEN {met(cut('w', len(s)), s)} THEN {cut('w', len(s))} || '{r}' ELSE w END"
                for s, r in sorted(rules, key=lambda r: -len(r[0]))]
        return f"CASE {' '.join(arms)} ELSE w END"

    x1 = cut("w", 1)
    steps = [
        longest(P.STEP_1A, lambda *_: "true"),
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {measure(cut('w', 3))} > 0 THEN {x1} ELSE w END "
        f"WHEN ends_with(w, 'ed') THEN CASE WHEN {vowel(cut('w', 2))} THEN {cut('w', 2)} || '+' ELSE w END "
        f"WHEN ends_with(w, 'ing') THEN CASE WHEN {vowel(cut('w', 3))} THEN {cut('w', 3)} || '+' ELSE w END ELSE w END",
        f"CASE WHEN NOT ends_with(w, '+') THEN w WHEN regexp_matches({x1}, '(at|bl|iz)$') THEN {x1} || 'e' "
        f"WHEN {double(x1)} AND NOT regexp_matches({x1}, '[lsz]$') THEN {cut('w', 2)} "
        f"WHEN {measure(x1)} = 1 AND {short(x1)} THEN {x1} || 'e' ELSE {x1} END",
        f"CASE WHEN ends_with(w, 'y') AND {vowel(x1)} THEN {x1} || 'i' ELSE w END",
        longest(P.STEP_2, lambda s, _: f"{measure(s)} > 0"),
        longest(P.STEP_3, lambda s, _: f"{measure(s)} > 0"),
        longest([(s, "") for s in P.STEP_4], lambda s, e: f"{measure(s)} > 1" + (f" AND regexp_matches({s}, '[st]$')" if e == "ion" else "")),
        f"CASE WHEN ends_with(w, 'e') AND ({measure(x1)} > 1 OR ({measure(x1)} = 1 AND NOT {short(x1)})) THEN {x1} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {measure('w')} > 1 THEN {x1} ELSE w END"]
    out = f"[{x}]"
    for s in steps:
        out = f"list_transform({out}, lambda w: {s})"
    return f"CASE WHEN regexp_full_match({x}, '[a-z]{{3,}}') THEN ({out})[1] ELSE {x} END"


_VOCAB = f"vocab AS (SELECT DISTINCT unnest({duck.ws_tokens('lower(text)')}) AS word FROM documents), stems AS MATERIALIZED (SELECT word, {porter_sql('word')} AS stem FROM vocab)"


@register("t7_porter_stems", f"WITH {_VOCAB} SELECT word, stem FROM stems")
def t7_porter_stems(spark, sf):
    """The stem of every distinct word of the documents."""
    words = table(spark, sf, "documents").select(F.explode(whitespace_tokens(F.lower("text"))).alias("word")).distinct()
    return words.select("word", P.porter_stem(F.col("word")).alias("stem"))


@register("t7_porter_documents",
          f"WITH {_VOCAB}, toks AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS k FROM "
          f"(SELECT doc_id, {duck.ws_tokens('lower(text)')} AS t FROM documents)) "
          "SELECT d.doc_id, coalesce(x.text, '') AS text FROM documents d LEFT JOIN (SELECT doc_id, string_agg(stem, ' ' ORDER BY k) AS text "
          "FROM toks JOIN stems USING (word) GROUP BY doc_id) x USING (doc_id)")
def t7_porter_documents(spark, sf):
    """Every document with its words stemmed, through the dictionary of the vocabulary."""
    docs = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    return normalize_words(docs, ["text"], ["doc_id"], P.porter_dictionary)


# ------------------------------------------------------------------ T11 trained

def _trained_sql() -> str:
    tok = duck.q(S.TOKEN)
    typ = lambda t: f"lower(regexp_extract({t}, {tok}, 1))"
    per = lambda t: f"regexp_extract({t}, {tok}, 2) = '.'"
    lnx = lambda n, p: f"CASE WHEN {n} = 0 THEN 0.0 ELSE {n} * ln({p}) END"
    a = "(with_period + without)"
    p = "greatest(least(np / n, 1 - 1e-9), 1e-9)"
    ratio = f"2 * (with_period * ln(0.99) + without * ln(0.01) - with_period * ln({p}) - without * ln(1 - {p}))"
    periods = "(length(type) - length(replace(type, '.', '')) + 1)"
    others = f"(length(type) - {periods} + 1)"
    rest = "(n - a - total + after_end)"
    s_ratio = (f"-2 * ({lnx('after_end', 'total / n')} + {lnx('(a - after_end)', '(1 - total / n)')} + {lnx('(total - after_end)', 'total / n')} "
               f"+ {lnx(rest, '(1 - total / n)')} - {lnx('after_end', 'after_end / a')} - {lnx('(a - after_end)', '(1 - after_end / a)')} "
               f"- {lnx('(total - after_end)', '((total - after_end) / greatest(n - a, 1))')} "
               f"- {lnx(rest, '(1 - (total - after_end) / greatest(n - a, 1))')})")
    return (
        f"tk AS MATERIALIZED (SELECT doc_id, unnest(t) AS t, generate_subscripts(t, 1) AS k FROM (SELECT doc_id, {duck.ws_tokens('text')} AS t FROM documents)), "
        f"ty AS MATERIALIZED (SELECT doc_id, k, t, {typ('t')} AS type, {per('t')} AS p FROM tk), "
        "cn AS (SELECT type, sum(p::INT)::BIGINT AS with_period, sum(1 - p::INT)::BIGINT AS without FROM ty WHERE type <> '' GROUP BY type), "
        "tt AS (SELECT sum(with_period) AS np, sum(with_period + without) AS n FROM cn), "
        f"ab AS MATERIALIZED (SELECT type, with_period, without, ({ratio}) * exp(-{others}) * {periods} * pow({others}::DOUBLE, -without::DOUBLE) AS score "
        f"FROM cn, tt WHERE with_period > 0 AND regexp_matches(type, '\\p{{L}}')), "
        f"abb AS (SELECT type FROM ab WHERE score >= {S.ABBREVIATION}), "
        "fol AS (SELECT y.type, x.type AS before, x.p, regexp_matches(x.t, '[!?][)\"''\\]]*$') AS mark FROM ty y LEFT JOIN ty x "
        "ON x.doc_id = y.doc_id AND x.k = y.k - 1 WHERE y.type <> ''), "
        "st AS (SELECT type, sum((coalesce(mark, false) OR (coalesce(p, false) AND length(before) > 1 AND before NOT IN (SELECT type FROM abb)))::INT)::BIGINT "
        "AS after_end, count(*) AS total FROM fol GROUP BY type), "
        "sn AS (SELECT sum(after_end) AS a, sum(total) AS n FROM st), "
        f"sta AS (SELECT type FROM (SELECT type, CASE WHEN after_end / a > total / n THEN {s_ratio} ELSE 0.0 END AS ratio FROM st, sn WHERE after_end > 0) "
        f"WHERE ratio >= {S.STARTER}), "
        f"parts AS (SELECT doc_id, unnest(s) AS part, generate_subscripts(s, 1) AS k, len(s) AS n FROM (SELECT doc_id, {duck.sentences('text')} AS s FROM documents)), "
        "cuts AS (SELECT p.doc_id, p.k, p.part, regexp_split_to_array(p.part, '\\s+')[-1] AS last, regexp_split_to_array(q.part, '\\s+')[1] AS first "
        "FROM parts p LEFT JOIN parts q ON q.doc_id = p.doc_id AND q.k = p.k + 1), "
        f"jd AS (SELECT doc_id, k, part, CASE WHEN {per('last')} THEN {typ('last')} END AS before, {typ('first')} AS after, "
        f"coalesce(regexp_matches(regexp_extract(first, {tok}, 1), '^\\p{{Lu}}'), false) AS capital FROM cuts), "
        "jo AS (SELECT doc_id, k, part, coalesce(length(before) = 1 AND regexp_matches(before, '\\p{L}'), false) OR "
        "(coalesce(before IN (SELECT type FROM abb), false) AND NOT (coalesce(after IN (SELECT type FROM sta), false) AND capital)) AS goes_on FROM jd), "
        "gr AS (SELECT doc_id, k, part, coalesce(sum((NOT goes_on)::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS i FROM jo)")


_TRAINED = _trained_sql()


@register("t11_abbreviations", f"WITH {_TRAINED} SELECT type, with_period, without, round(score, 6) AS score FROM ab")
def t11_abbreviations(spark, sf):
    """The scores that the splitter learns abbreviations from."""
    return S.abbreviation_counts(table(spark, sf, "documents")).select("type", "with_period", "without", F.round("score", 6).alias("score"))


@register("t11_trained_sentences", f"WITH {_TRAINED} SELECT doc_id, i, string_agg(part, ' ' ORDER BY k) AS sentence FROM gr GROUP BY doc_id, i")
def t11_trained_sentences(spark, sf):
    docs = table(spark, sf, "documents")
    return S.Splitter.train(docs).sentences(docs)
