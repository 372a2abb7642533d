"""Registered encoding and sequence queries.

The corpus is ``documents`` with its first sentence as the summary; text is
lower-cased before encoding (F6) and the vocabulary comes from both columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.text import ngrams, whitespace_tokens
from ..operators.encode import build_vocabulary, decode, encode
from ..operators.select import length_budget
from ..session import ensure_checkpoint_dir, table
from ..sources.corpus import corpus_from_documents, read_split, write_dataset
from . import duck
from .registry import register
from .text_queries import CORPUS_SQL

BUDGET = 512
SAMPLE_SIZE = 512


def _corpus(spark, sf):
    c = corpus_from_documents(table(spark, sf, "documents"))
    return c.select("split", "doc_id", F.lower("document").alias("document"), F.lower("summary").alias("summary"))


def _vocab(spark, sf):
    return build_vocabulary(_corpus(spark, sf), ["document", "summary"])


def _encoded(spark, sf, vocab=None):
    return encode(_corpus(spark, sf), ["document", "summary"], vocab or _vocab(spark, sf), ["split", "doc_id"])


def _ids_str(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


# ------------------------------------------------------------------ SQL twins

_BASE = (f"c AS (SELECT split, doc_id, lower(document) AS document, lower(summary) AS summary FROM ({CORPUS_SQL})), "
         f"tk AS (SELECT split, doc_id, {duck.ws_tokens('document')} AS d, {duck.ws_tokens('summary')} AS s FROM c), "
         "w AS (SELECT unnest(d) AS word FROM tk UNION ALL SELECT unnest(s) AS word FROM tk), "
         "f AS (SELECT word, count(*)::BIGINT AS freq FROM w GROUP BY word), "
         "vocab AS (SELECT word, (row_number() OVER (ORDER BY freq DESC, word) + 2)::BIGINT AS id, freq FROM f), "
         "dp AS (SELECT doc_id, unnest(d) AS word, unnest(range(1, len(d) + 1)) AS i FROM tk), "
         "sp AS (SELECT doc_id, unnest(s) AS word, unnest(range(1, len(s) + 1)) AS i FROM tk), "
         "de AS (SELECT dp.doc_id, list(v.id::INT ORDER BY dp.i) AS ids FROM dp JOIN vocab v USING (word) GROUP BY dp.doc_id), "
         "se AS (SELECT sp.doc_id, list(v.id::INT ORDER BY sp.i) AS ids FROM sp JOIN vocab v USING (word) GROUP BY sp.doc_id), "
         "enc AS (SELECT tk.split, tk.doc_id, coalesce(de.ids, []::INT[]) AS doc_ids, coalesce(se.ids, []::INT[]) AS sum_ids "
         "FROM tk LEFT JOIN de USING (doc_id) LEFT JOIN se USING (doc_id))")


def _s(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda v: v::VARCHAR), ' ')"


def _padded_sql(size: int) -> str:
    body = "list_concat(doc_ids, [1], sum_ids)"
    return f"list_concat({body}, list_transform(range(greatest(0, {size} - len({body}))), lambda z: 0))"


# ------------------------------------------------------------------ queries

@register("a2_vocabulary",
          "WITH " + _BASE + " SELECT word, id, freq FROM vocab UNION ALL "
          "SELECT * FROM (VALUES ('<pad>', 0::BIGINT, 0::BIGINT), ('<sep>', 1, 0), ('<unk>', 2, 0)) t(word, id, freq)")
def a2_vocabulary(spark, sf):
    """A1 + A2: the vocabulary table with the reserved tokens."""
    return _vocab(spark, sf)


@register("a1_encode",
          "WITH " + _BASE + f" SELECT doc_id, len(doc_ids)::BIGINT AS n_doc, len(sum_ids)::BIGINT AS n_sum, "
          f"{_s('doc_ids')} AS doc_ids, {_s('sum_ids')} AS sum_ids FROM enc")
def a1_encode(spark, sf):
    e = _encoded(spark, sf)
    return e.select("doc_id", F.size("document").cast("long").alias("n_doc"), F.size("summary").cast("long").alias("n_sum"),
                    _ids_str(F.col("document")).alias("doc_ids"), _ids_str(F.col("summary")).alias("sum_ids"))


@register("f3_length_budget",
          "WITH " + _BASE + f" SELECT split, doc_id FROM enc WHERE len(doc_ids) + len(sum_ids) + 1 <= {BUDGET}")
def f3_length_budget(spark, sf):
    """Keep pairs whose ids plus one separator fit the budget."""
    return length_budget(_encoded(spark, sf), "document", "summary", BUDGET, sep_len=1).select("split", "doc_id")


@register("f3c_strict_budget",
          "WITH " + _BASE + f" SELECT split, doc_id FROM enc WHERE len(doc_ids) + len(sum_ids) < {BUDGET}")
def f3c_strict_budget(spark, sf):
    return length_budget(_encoded(spark, sf), "document", "summary", BUDGET, sep_len=0, strict=True) \
        .select("split", "doc_id")


@register("a3_a5_padded_sample",
          "WITH " + _BASE + f" SELECT doc_id, len(doc_ids)::INT AS sum_idx, len({_padded_sql(SAMPLE_SIZE)})::BIGINT AS n_tokens, "
          f"{_s(_padded_sql(SAMPLE_SIZE))} AS tokens FROM enc WHERE len(doc_ids) + len(sum_ids) + 1 <= {BUDGET}")
def a3_a5_padded_sample(spark, sf):
    """A3 (concat with separator), A4 (right pad), A5 (boundary index) on
    the rows that pass the budget."""
    e = length_budget(_encoded(spark, sf), "document", "summary", BUDGET)
    s = e.select("doc_id", S.sample_row("document", "summary", SAMPLE_SIZE).alias("x"))
    return s.select("doc_id", F.col("x.sum_idx").alias("sum_idx"),
                    F.size("x.tokens").cast("long").alias("n_tokens"), _ids_str(F.col("x.tokens")).alias("tokens"))


@register("a6_decode",
          "WITH " + _BASE + ", dec AS (SELECT e.doc_id, unnest(e.doc_ids) AS id, unnest(range(1, len(e.doc_ids) + 1)) AS i FROM enc e) "
          "SELECT tk.doc_id, coalesce(string_agg(v.word, ' ' ORDER BY dec.i), '') AS text FROM tk "
          "LEFT JOIN dec ON dec.doc_id = tk.doc_id LEFT JOIN vocab v ON v.id = dec.id GROUP BY tk.doc_id")
def a6_decode(spark, sf):
    """Ids back to text (reserved ids dropped)."""
    vocab = _vocab(spark, sf)
    return decode(_encoded(spark, sf, vocab), "document", vocab)


@register("a7_label_range",
          "WITH " + _BASE + f", p AS (SELECT doc_id, len(doc_ids) AS sum_idx, {_padded_sql(SAMPLE_SIZE)} AS t FROM enc "
          f"WHERE len(doc_ids) + len(sum_ids) + 1 <= {BUDGET}) "
          f"SELECT doc_id, len(t[sum_idx + 2:])::BIGINT AS n_labels, {_s('t[sum_idx + 2:]')} AS labels FROM p")
def a7_label_range(spark, sf):
    e = length_budget(_encoded(spark, sf), "document", "summary", BUDGET)
    s = e.select("doc_id", S.sample_row("document", "summary", SAMPLE_SIZE).alias("x"))
    lab = S.label_range(F.col("x.tokens"), F.col("x.sum_idx"))
    return s.select("doc_id", F.size(lab).cast("long").alias("n_labels"), _ids_str(lab).alias("labels"))


@register("a8_ngrams",
          f"WITH tk AS (SELECT doc_id, {duck.ws_tokens('text')} AS t FROM documents) "
          f"SELECT doc_id, len({duck.ngrams('t', 3)})::BIGINT AS n, "
          f"array_to_string({duck.ngrams('t', 3)}, '|') AS grams FROM tk")
def a8_ngrams(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", whitespace_tokens("text").alias("t"))
    g = ngrams("t", 3)
    return d.select("doc_id", F.size(g).cast("long").alias("n"), F.array_join(g, "|").alias("grams"))


@register("a9_strip_prompt",
          "WITH " + _BASE + f" SELECT doc_id, {_s('list_concat(doc_ids, [1], sum_ids)[len(doc_ids) + 1:]')} AS continuation FROM enc")
def a9_strip_prompt(spark, sf):
    """The 'generated' sequence is prompt + separator + summary; stripping
    the prompt leaves separator + summary."""
    e = _encoded(spark, sf)
    gen = S.join_with_sep("document", "summary")
    return e.select("doc_id", _ids_str(S.strip_prompt(gen, "document")).alias("continuation"))


@register("s5_s6_dataset_roundtrip",
          "WITH " + _BASE + f" SELECT doc_id, {_s('doc_ids')} AS doc_ids, {_s('sum_ids')} AS sum_ids FROM enc "
          f"WHERE split = 'test' AND len(doc_ids) + len(sum_ids) + 1 <= {BUDGET} ORDER BY doc_id LIMIT 30")
def s5_s6_dataset_roundtrip(spark, sf):
    """Write the budget-filtered encoded dataset partitioned by
    split; S6: read one split back (partition pruning) with a head clip."""
    e = length_budget(_encoded(spark, sf), "document", "summary", BUDGET)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/datasets/{uuid.uuid4().hex}"
    write_dataset(e, path)
    back = read_split(spark, path, "test", 30)
    return back.select("doc_id", _ids_str(F.col("document")).alias("doc_ids"), _ids_str(F.col("summary")).alias("sum_ids"))
