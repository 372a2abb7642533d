"""Registered text, cleaning and filter queries (T*, P*, F*, S1, M10 to M13)
over the ``documents`` table.  Every query reads the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import text as T
from ..functions.fixed import CONTRACTIONS, STOP_WORDS
from ..operators.select import (all_keywords, concat_all, drop_empty, first_k_accepted, head_per_split, optional_lower,
                                seeded_order, select_split, tail_per_split, top_n_per_group)
from ..session import ensure_checkpoint_dir, table
from ..sources.corpus import SPLITS, corpus_from_documents, load_corpus, split_of
from . import duck
from .registry import register

DOCS = "documents"


def _docs(spark, sf):
    return table(spark, sf, DOCS)


def _corpus(spark, sf):
    return corpus_from_documents(_docs(spark, sf))


CORPUS_SQL = (f"SELECT {duck.split_of()} AS split, doc_id, text AS document, "
              f"coalesce({duck.sentences('text')}[1], '') AS summary, lang, n_chars FROM documents")


# ---------------------------------------------------------------- T1 .. T13

@register("t1_lower", "SELECT doc_id, lower(text) AS text FROM documents")
def t1_lower(spark, sf):
    return _docs(spark, sf).select("doc_id", T.to_lower("text").alias("text"))


_KEYS = list(CONTRACTIONS)


def _with_contractions(doc_id, text):
    """Documents hold no apostrophes, so two dictionary keys (picked by the
    row id) are appended to every text; T2 then runs over the whole text."""
    keys = F.array(*[F.lit(k) for k in _KEYS])
    k1 = F.element_at(keys, (F.pmod(doc_id, F.lit(len(_KEYS))) + 1).cast("int"))
    k2 = F.element_at(keys, (F.pmod(doc_id * 31 + 7, F.lit(len(_KEYS))) + 1).cast("int"))
    return F.concat(text, F.lit(" "), k1, F.lit(" x"), k2, F.lit("."))


_KEYS_SQL = "[" + ", ".join(duck.q(k) for k in _KEYS) + "]"


@register("t2_expand_contractions",
          f"WITH s AS (SELECT doc_id, text || ' ' || {_KEYS_SQL}[(doc_id % {len(_KEYS)}) + 1] || ' x' || "
          f"{_KEYS_SQL}[((doc_id * 31 + 7) % {len(_KEYS)}) + 1] || '.' AS t FROM documents) "
          f"SELECT doc_id, {duck.expand_contractions('t')} AS text FROM s")
def t2_expand_contractions(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", T.expand_contractions(_with_contractions(F.col("doc_id"), F.col("text"))).alias("text"))


@register("t3_remove_symbols", f"SELECT doc_id, {duck.remove_symbols('text')} AS text FROM documents")
def t3_remove_symbols(spark, sf):
    return _docs(spark, sf).select("doc_id", T.remove_symbols("text").alias("text"))


@register("t4_remove_by_regex", f"SELECT doc_id, {duck.remove_digits('text')} AS text FROM documents")
def t4_remove_by_regex(spark, sf):
    return _docs(spark, sf).select("doc_id", T.remove_by_regex("text", [T.DIGIT]).alias("text"))


@register("t5_replace_by_regex",
          "SELECT doc_id, regexp_replace(regexp_replace(text, '\\n+', ' | ', 'g'), '[|] ([A-Z])', '<\\1', 'g') AS text FROM documents")
def t5_replace_by_regex(spark, sf):
    """Sequential replacement, second rule sees the first one's output."""
    return _docs(spark, sf).select("doc_id", T.replace_by_regex(
        "text", [("\\n+", " | "), ("[|] ([A-Z])", "<$1")]).alias("text"))


@register("t5e_mask_emails", f"SELECT doc_id, {duck.mask_emails('text')} AS text FROM documents")
def t5e_mask_emails(spark, sf):
    return _docs(spark, sf).select("doc_id", T.mask_emails("text").alias("text"))


@register("t6_remove_stop_words", f"SELECT doc_id, {duck.remove_words('lower(text)')} AS text FROM documents")
def t6_remove_stop_words(spark, sf):
    return _docs(spark, sf).select("doc_id", T.remove_words(F.lower("text"), STOP_WORDS).alias("text"))


@register("j4_stop_word_anti_join", f"SELECT doc_id, {duck.remove_words('lower(text)')} AS text FROM documents")
def j4_stop_word_anti_join(spark, sf):
    """T6 with the word list as a table: left anti join on the exploded words."""
    d = _docs(spark, sf).select("doc_id", T.to_lower("text").alias("text"))
    stop = spark.createDataFrame([(w,) for w in STOP_WORDS], "word string")
    return C.remove_words_by_table(d, ["text"], ["doc_id"], stop)


_S_STEM_SQL = ("CASE WHEN regexp_matches(w, '[^ae]ies$') THEN regexp_replace(w, 'ies$', 'y') "
               "WHEN regexp_matches(w, '[^aeo]es$') THEN regexp_replace(w, 'es$', 'e') "
               "WHEN regexp_matches(w, '[^us]s$') THEN regexp_replace(w, 's$', '') ELSE w END")


@register("t7_stem",
          f"SELECT doc_id, array_to_string(list_transform({duck.ws_tokens('lower(text)')}, lambda w: {_S_STEM_SQL}), ' ') AS text FROM documents")
def t7_stem(spark, sf):
    return _docs(spark, sf).select("doc_id", T.stem(F.lower("text")).alias("text"))


def _lemma_sql(src: str, col: str) -> str:
    """DuckDB twin of the noun-plural lemma dictionary step over ``src``."""
    from ..functions.fixed import NOUN_PLURAL_RULES
    rules = " UNION ALL ".join(
        f"SELECT word, left(word, length(word) - {len(s)}) || {duck.q(r)} AS cand, {i} AS rule FROM vocab "
        f"WHERE suffix(word, {duck.q(s)}) AND length(word) > {len(s)}"
        for i, (s, r) in enumerate(NOUN_PLURAL_RULES, start=1))
    return (
        f"toks AS (SELECT doc_id, unnest(t) AS word, unnest(range(1, len(t) + 1)) AS i "
        f"FROM (SELECT doc_id, {duck.ws_tokens(col)} AS t FROM {src})), "
        "vocab AS (SELECT DISTINCT word FROM toks), "
        f"cand AS ({rules}), "
        "known AS (SELECT c.* FROM cand c SEMI JOIN vocab v ON v.word = c.cand), "
        "best AS (SELECT word, arg_min(cand, length(cand) * 100 + rule) AS norm, min(length(cand)) AS len "
        "FROM known GROUP BY word), "
        "dict AS (SELECT word, norm FROM best WHERE len < length(word)), "
        f"lem AS (SELECT d.doc_id, coalesce(string_agg(coalesce(dict.norm, toks.word), ' ' ORDER BY toks.i), '') AS text "
        f"FROM {src} d LEFT JOIN toks ON toks.doc_id = d.doc_id LEFT JOIN dict ON dict.word = toks.word "
        "GROUP BY d.doc_id)"
    )


@register("t8_lemmatize",
          "WITH base AS (SELECT doc_id, lower(text) AS text FROM documents), " + _lemma_sql("base", "text")
          + " SELECT doc_id, text FROM lem")
def t8_lemmatize(spark, sf):
    d = _docs(spark, sf).select("doc_id", T.to_lower("text").alias("text"))
    return C.normalize_words(d, ["text"], ["doc_id"])


@register("t9_non_letters_to_space", "SELECT doc_id, regexp_replace(text, '[^a-zA-Z]', ' ', 'g') AS text FROM documents")
def t9_non_letters_to_space(spark, sf):
    return _docs(spark, sf).select("doc_id", T.non_letters_to_space("text").alias("text"))


@register("t10_whitespace_tokens",
          f"SELECT doc_id, len({duck.ws_tokens('text')})::BIGINT AS n_tokens, "
          f"array_to_string({duck.ws_tokens('text')}, '|') AS tokens FROM documents")
def t10_whitespace_tokens(spark, sf):
    t = T.whitespace_tokens("text")
    return _docs(spark, sf).select("doc_id", F.size(t).cast("long").alias("n_tokens"),
                                   F.array_join(t, "|").alias("tokens"))


@register("t11_sentences",
          f"SELECT doc_id, (i - 1)::BIGINT AS i, s[i] AS sentence FROM "
          f"(SELECT doc_id, {duck.sentences('text')} AS s FROM documents), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)")
def t11_sentences(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", F.posexplode(T.split_sentences("text")).alias("i", "sentence")) \
        .select("doc_id", F.col("i").cast("long").alias("i"), "sentence")


@register("t12_naive_word_count",
          "SELECT doc_id, (length(text) - length(replace(text, ' ', '')))::BIGINT AS n FROM documents")
def t12_naive_word_count(spark, sf):
    return _docs(spark, sf).select("doc_id", T.naive_word_count("text").alias("n"))


@register("t13_map_sentences",
          f"SELECT doc_id, array_to_string(list_transform({duck.sentences('text')}, "
          f"lambda s: {duck.remove_symbols('lower(s)')}), ' || ') AS text FROM documents")
def t13_map_sentences(spark, sf):
    s = T.map_sentences(T.split_sentences("text"), lambda x: T.remove_symbols(T.to_lower(x)))
    return _docs(spark, sf).select("doc_id", F.array_join(s, " || ").alias("text"))


# ---------------------------------------------------------------- P1 .. P7

def _custom_chain():
    return C.Pipeline("custom").add(T.to_lower).add(T.mask_emails).add(
        lambda c: T.remove_by_regex(c, [T.DIGIT])).add(lambda c: T.remove_words(c, ["the", "a", "an"]))


@register("p1_chain",
          f"SELECT doc_id, {duck.remove_words(duck.remove_digits(duck.mask_emails('lower(text)')), ['the', 'a', 'an'])} AS text FROM documents")
def p1_chain(spark, sf):
    """A user-built chain of four column steps -> one projection."""
    d = _docs(spark, sf).select("doc_id", "text")
    return _custom_chain().transform(d, "text")


@register("p2_strong",
          f"WITH base AS (SELECT doc_id, {duck.pre_lemma_strong('text')} AS text FROM documents), "
          + _lemma_sql("base", "text") + f" SELECT doc_id, {duck.remove_words('text')} AS text FROM lem")
def p2_strong(spark, sf):
    return C.strong().transform(_docs(spark, sf).select("doc_id", "text"), "text")


@register("p3_mid", f"SELECT doc_id, {duck.mid('text')} AS text FROM documents")
def p3_mid(spark, sf):
    return C.mid().transform(_docs(spark, sf).select("doc_id", "text"), "text")


@register("p4_simple", f"SELECT doc_id, {duck.simple('text')} AS text FROM documents")
def p4_simple(spark, sf):
    return C.simple().transform(_docs(spark, sf).select("doc_id", "text"), "text")


@register("p5_nothing", "SELECT doc_id, text FROM documents")
def p5_nothing(spark, sf):
    return C.nothing().transform(_docs(spark, sf).select("doc_id", "text"), "text")


@register("p6_scoring", f"SELECT doc_id, {duck.scoring('text')} AS text FROM documents")
def p6_scoring(spark, sf):
    return C.scoring().transform(_docs(spark, sf).select("doc_id", "text"), "text")


@register("p7_embedding",
          f"WITH base AS (SELECT doc_id, {duck.pre_lemma_strong('text', keep_dot=False)} AS text FROM documents), "
          + _lemma_sql("base", "text") + f" SELECT doc_id, {duck.remove_words('text')} AS text FROM lem")
def p7_embedding(spark, sf):
    return C.embedding().transform(_docs(spark, sf).select("doc_id", "text"), "text")


# ---------------------------------------------------------------- S1, F1 .. F13

@register("s1_load_corpus", f"SELECT split, doc_id, document, summary FROM ({CORPUS_SQL})")
def s1_load_corpus(spark, sf):
    """Three split folders with the labels of another source, read as one corpus."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/precis-corpus-{uuid.uuid4().hex}"
    named = _corpus(spark, sf).withColumnsRenamed({"document": "article", "summary": "highlights"})
    paths = {s: f"{base}/{s}" for s in SPLITS}
    for s, path in paths.items():
        select_split(named, s).drop("split").write.parquet(path)
    return load_corpus(spark, paths, "article", "highlights")


@register("f1_split_select", f"SELECT doc_id, document FROM ({CORPUS_SQL}) WHERE split = 'test'")
def f1_split_select(spark, sf):
    return select_split(_corpus(spark, sf), "test").select("doc_id", "document")


@register("f2_drop_empty_pairs",
          f"WITH p AS ({duck.PAIRS}) SELECT conv_id, turn FROM p WHERE length(trim(prediction, ' ')) > 0 "
          f"AND length(regexp_replace(reference, '[^a-z]', '', 'g')) > 0")
def f2_drop_empty_pairs(spark, sf):
    """Pairs whose cleaned texts are both non-empty (empty after cleaning
    happens: the reference keeps only its lower-case ASCII letters)."""
    from ..sources.corpus import conversation_pairs
    p = conversation_pairs(table(spark, sf, "conversations"))
    clean = p.select("conv_id", "turn", F.trim("prediction").alias("document"),
                     F.regexp_replace("reference", "[^a-z]", "").alias("summary"))
    return drop_empty(clean).select("conv_id", "turn")


@register("f4_row_predicate",
          f"SELECT split, doc_id FROM ({CORPUS_SQL}) WHERE split <> 'test' AND lang = 'en' AND n_chars > 1000")
def f4_row_predicate(spark, sf):
    d = _docs(spark, sf).withColumn("split", split_of("doc_id"))
    pred = (F.col("split") != "test") & (F.col("lang") == "en") & (F.col("n_chars") > 1000)
    return d.where(pred).select("split", "doc_id")


@register("f5_all_keywords",
          "SELECT doc_id FROM documents WHERE contains(text, 'the') AND contains(text, 'and') AND contains(text, 'The')")
def f5_all_keywords(spark, sf):
    return all_keywords(_docs(spark, sf), "text", ["the", "and", "The"]).select("doc_id")


@register("f6_optional_lower", f"SELECT doc_id, lower(document) AS document, summary FROM ({CORPUS_SQL})")
def f6_optional_lower(spark, sf):
    return optional_lower(_corpus(spark, sf), ["document"], True).select("doc_id", "document", "summary")


@register("f7_head_clip",
          f"SELECT split, doc_id FROM ({CORPUS_SQL}) QUALIFY row_number() OVER (PARTITION BY split ORDER BY doc_id) <= 25")
def f7_head_clip(spark, sf):
    return head_per_split(_corpus(spark, sf), 25).select("split", "doc_id")


@register("f8_tail_clip",
          f"SELECT split, doc_id FROM ({CORPUS_SQL}) QUALIFY row_number() OVER (PARTITION BY split ORDER BY doc_id DESC) <= 25")
def f8_tail_clip(spark, sf):
    return tail_per_split(_corpus(spark, sf), 25).select("split", "doc_id")


@register("f9_first_k_accepted",
          f"SELECT split, doc_id FROM ({CORPUS_SQL}) WHERE n_chars < 2000 "
          f"QUALIFY row_number() OVER (PARTITION BY split ORDER BY doc_id) <= 40")
def f9_first_k_accepted(spark, sf):
    c = _docs(spark, sf).select(split_of("doc_id").alias("split"), "doc_id", "n_chars")
    return first_k_accepted(c, F.col("n_chars") < 2000, 40).select("split", "doc_id")


@register("f10_seeded_shuffle",
          f"SELECT doc_id, md5(doc_id::VARCHAR || ':42') AS shuffle_key FROM ({CORPUS_SQL}) WHERE split = 'train'")
def f10_seeded_shuffle(spark, sf):
    c = _corpus(spark, sf).where(F.col("split") == "train")
    return seeded_order(c, 42).select("doc_id", "shuffle_key")


@register("f11_top_n_sentences",
          f"SELECT doc_id, (i - 1)::BIGINT AS i FROM (SELECT doc_id, s[i] AS sentence, i FROM "
          f"(SELECT doc_id, {duck.sentences('text')} AS s FROM documents), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)) "
          f"QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(sentence) DESC, i) <= 3")
def f11_top_n_sentences(spark, sf):
    """Top 3 sentences per document by a score (here: length), ties to the
    lower index."""
    from ..sources.corpus import sentences
    s = sentences(_docs(spark, sf)).withColumn("score", F.length("sentence"))
    return top_n_per_group(s, "doc_id", "score", "i", 3).select("doc_id", F.col("i").cast("long").alias("i"))


@register("f12_concat_splits", f"SELECT split, doc_id, document, summary FROM ({CORPUS_SQL})")
def f12_concat_splits(spark, sf):
    c = _corpus(spark, sf)
    return concat_all([select_split(c, s) for s in SPLITS])


# ---------------------------------------------------------------- M10 .. M13

_COUNTS_SQL = (f"SELECT split, doc_id, (length(document) - length(replace(document, ' ', '')) "
               f"+ length(summary) - length(replace(summary, ' ', '')))::BIGINT AS n FROM ({CORPUS_SQL})")


def _counts(spark, sf):
    c = _corpus(spark, sf)
    return c.select("split", "doc_id", (T.naive_word_count("document") + T.naive_word_count("summary")).alias("n"))


@register("m10_token_counts", _COUNTS_SQL)
def m10_token_counts(spark, sf):
    return _counts(spark, sf)


@register("m11_histogram",
          f"WITH c AS ({_COUNTS_SQL}), b AS (SELECT split, min(n) AS lo, max(n) AS hi FROM c GROUP BY split) "
          "SELECT c.split, (CASE WHEN b.hi = b.lo THEN 1 ELSE least(floor((c.n - b.lo) / (b.hi - b.lo) * 10) + 1, 10) END)::BIGINT AS bin, "
          "count(*)::BIGINT AS n_docs FROM c JOIN b USING (split) GROUP BY ALL")
def m11_histogram(spark, sf):
    from ..operators.stats import equal_width_histogram
    return equal_width_histogram(_counts(spark, sf), "n", "split", 10)


@register("m12_within_budget_pct",
          f"SELECT split, round(100 * avg((n <= 1024)::INT), 3) AS pct FROM ({_COUNTS_SQL}) GROUP BY split")
def m12_within_budget_pct(spark, sf):
    c = _counts(spark, sf)
    return c.groupBy("split").agg(F.round(100 * F.avg((F.col("n") <= 1024).cast("int")), 3).alias("pct"))


@register("m13_rows_per_split",
          f"SELECT split, count(*)::BIGINT AS n_rows FROM ({_COUNTS_SQL}) WHERE n <= 1024 GROUP BY split")
def m13_rows_per_split(spark, sf):
    return _counts(spark, sf).where(F.col("n") <= 1024).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
