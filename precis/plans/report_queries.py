"""Registered grid, reporting and file queries (M8, J5, W1 to W6, F13,
S2, S3, S7 to S11).

M8 registers the four cleanings x six rankers x eleven metrics over the whole
``documents`` table.  The reporting queries (J5, W1 to W6, F13, S8/S9)
use a grid DuckDB can rebuild, so each has an oracle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.fixed import MODEL_NAMES
from ..operators import report as W
from ..operators.metrics import evaluate_metrics
from ..session import ensure_checkpoint_dir, table
from ..sources import results as RS
from ..sources import stories as SS
from ..sources.corpus import conversation_pairs
from ..sources.story_source import load_stories, write_stories, write_story_files
from . import duck
from .flagship import corpus_vectors, grid
from .registry import register

#: The grid's cleanings and rankers: all cells.
PIPELINES = ("strong", "mid", "simple", "nothing")
MODELS = MODEL_NAMES


def _scratch(spark, tag):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/precis-{tag}-{uuid.uuid4().hex}"


@register("m8_grid")
def m8_grid(spark, sf):
    """M8 + J5 + R9 + R10: (pipeline, model, metric) cells, long form."""
    docs = table(spark, sf, "documents")
    g = grid(docs, PIPELINES, MODELS, vectors=corpus_vectors(docs, table(spark, sf, "embeddings")))
    return g.select("pipeline", "model", "metric", F.round("value", 6).alias("value"))


#: Cells that DuckDB can rebuild, and the rounds its KL-Sum is unrolled to (a summary's length at most).
T_PIPES, T_MODELS, T_ROUNDS = ("simple", "nothing"), ("Lsa", "Luhn", "KL"), 8
T_METRICS = tuple(f"BLEU-{n}" for n in range(1, 5)) + tuple(f"ROUGE-{n}-{m}" for m in ("fmeasure", "recall") for n in (1, 2))


def _cells_sql() -> str:
    from .flagship import LEAD, LEAD_SHARE
    from .metric_queries import _bleu_sql, _rouge_sql
    from .rank_queries import _LSA_CTES, _LUHN_CTES, _kl_sql

    raw = f"(SELECT doc_id, {duck.sentences('text')} AS s FROM documents)"
    own = f"(SELECT doc_id, {duck.sentences('text')} AS s FROM corpora)"
    corpora = "corpora AS MATERIALIZED (SELECT {'p': 'simple', 'd': doc_id} AS doc_id, " + duck.simple("text") + (
        " AS text FROM documents UNION ALL SELECT {'p': 'nothing', 'd': doc_id}, text FROM documents)")
    refs = (f"refs AS (SELECT doc_id, array_to_string(s[1:greatest({LEAD}, ceil(len(s) * {LEAD_SHARE})::INT)], ' ') AS reference "
            f"FROM {own}), sizes AS (SELECT doc_id.p AS p, ceil(avg(len({duck.sentences('reference')}))) AS n FROM refs GROUP BY 1)")
    tops = []
    for m, ctes in (("Lsa", _LSA_CTES), ("Luhn", _LUHN_CTES), ("KL", _kl_sql(T_ROUNDS))):
        scores = ("WITH " + ctes.replace(raw, own) + f" SELECT doc_id, i, sentence, '{m}' AS model, score FROM {m.lower()} JOIN sents USING (doc_id, i)")
        tops.append(f"(SELECT doc_id, i, sentence, model FROM ({scores}) JOIN sizes ON p = doc_id.p "
                    "QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, i) <= n)")
    src = ("tops AS (" + " UNION ALL ".join(tops) + "), preds AS (SELECT doc_id, model, string_agg(sentence, ' ' ORDER BY i) AS prediction "
           "FROM tops GROUP BY ALL), src AS (SELECT r.doc_id.p AS pipeline, m.model, r.doc_id.d AS id, r.reference, "
           f"coalesce(p.prediction, '') AS prediction FROM refs r CROSS JOIN (SELECT unnest({list(T_MODELS)!r}) AS model) m "
           "LEFT JOIN preds p ON p.doc_id = r.doc_id AND p.model = m.model)")
    bleu = _bleu_sql("prediction", "reference", "src", ["id"], ["pipeline", "model"])
    rouge = _rouge_sql("prediction", "reference", "src", ["id"], group=["pipeline", "model"])
    out = [f"SELECT pipeline, model, 'BLEU-{n}' AS metric, bleu_{n} AS value FROM b" for n in range(1, 5)]
    out += [f"SELECT pipeline, model, 'ROUGE-{n}-{m}', rouge{n}_{m} FROM r" for m in ("fmeasure", "recall") for n in (1, 2)]
    return f"WITH {corpora}, {refs}, {src}, b AS ({bleu}), r AS ({rouge}) " + " UNION ALL ".join(out)


@register("m8_grid_cells", _cells_sql())
def m8_grid_cells(spark, sf):
    """The grid over the cleanings, rankers and metrics that DuckDB can rebuild."""
    g = grid(table(spark, sf, "documents"), T_PIPES, T_MODELS)
    return g.where(F.col("metric").isin(*T_METRICS)).select("pipeline", "model", "metric", F.round("value", 6).alias("value"))


# ------------------------------------------------------------------ reporting grid
# W1 to W6, F13 and S8/S9 report over a grid that DuckDB can rebuild: the
# conversation pairs under two cleanings ("nothing", "scoring") and two
# "models" (the assistant turn, and its lead sentence), scored by ROUGE-1/2.

R_PIPES = ("nothing", "scoring")
R_MODELS = ("assistant", "lead")
R_METRICS = tuple(f"{t}_{m}" for t in ("rouge1", "rouge2") for m in ("precision", "recall", "fmeasure"))


def _report_grid(spark, sf):
    from ..functions.cleaning import scoring_columns
    from ..functions.text import split_sentences
    from ..operators.metrics import rouge

    pairs = conversation_pairs(table(spark, sf, "conversations"))
    lead = F.coalesce(F.try_element_at(split_sentences("prediction"), F.lit(1)), F.lit(""))
    cells = []
    for pipe in R_PIPES:
        clean = scoring_columns if pipe == "scoring" else (lambda c: c)
        for model in R_MODELS:
            pred = F.col("prediction") if model == "assistant" else lead
            cells.append(F.struct(F.lit(pipe).alias("pipeline"), F.lit(model).alias("model"),
                                  clean(pred).alias("prediction"), clean(F.col("reference")).alias("reference")))
    # one join; each pair becomes a row for each cell
    rows = pairs.select("conv_id", "turn", F.explode(F.array(*cells)).alias("c")).select("conv_id", "turn", "c.*")
    r = rouge(rows, types=("rouge1", "rouge2"), group_cols=["pipeline", "model"])
    r = r.select("pipeline", "model", *[F.round(c, 6).alias(c) for c in R_METRICS])
    return r.unpivot(["pipeline", "model"], list(R_METRICS), "metric", "value")


def _report_grid_sql() -> str:
    from .metric_queries import _rouge_sql
    lead = f"coalesce({duck.sentences('prediction')}[1], '')"
    src = " UNION ALL ".join([
        "SELECT conv_id, turn, 'nothing' AS pipeline, 'assistant' AS model, prediction, reference FROM pairs",
        f"SELECT conv_id, turn, 'nothing', 'lead', {lead}, reference FROM pairs",
        f"SELECT conv_id, turn, 'scoring', 'assistant', {duck.scoring('prediction')}, {duck.scoring('reference')} FROM pairs",
        f"SELECT conv_id, turn, 'scoring', 'lead', {duck.scoring(lead)}, {duck.scoring('reference')} FROM pairs"])
    q = _rouge_sql("prediction", "reference", "src", ["conv_id", "turn"], group=["pipeline", "model"])
    return (f"pairs AS ({duck.PAIRS}), src AS ({src}), gw AS ({q}), "
            "g AS (SELECT pipeline, model, metric, value FROM (UNPIVOT gw ON COLUMNS(* EXCLUDE (pipeline, model)) "
            "INTO NAME metric VALUE value))")


_G = _report_grid_sql()


@register("j5_report_grid", f"WITH {_G} SELECT pipeline, model, metric, value FROM g")
def j5_report_grid(spark, sf):
    """Pipelines x models x metrics, planned as a union of shared
    per-pair rows and one grouped aggregate."""
    return _report_grid(spark, sf)




def _ord(col: str, names) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{n}' THEN {k}" for k, n in enumerate(names)) + f" ELSE {len(names)} END"


@register("w1_sum_over_models",
          f"WITH {_G} SELECT metric, pipeline, round(sum(value), 6) AS avg FROM g GROUP BY metric, pipeline")
def w1_sum_over_models(spark, sf):
    w = W.sum_over_models(_report_grid(spark, sf))
    return w.select("metric", "pipeline", F.round("avg", 6).alias("avg"))


@register("w2_best_pipeline",
          f"WITH {_G}, s AS (SELECT metric, pipeline, round(sum(value), 6) AS avg FROM g GROUP BY metric, pipeline) "
          f"SELECT metric, pipeline, avg FROM s QUALIFY row_number() OVER (PARTITION BY metric ORDER BY avg DESC, "
          f"{_ord('pipeline', R_PIPES)}) = 1")
def w2_best_pipeline(spark, sf):
    w = W.sum_over_models(_report_grid(spark, sf))
    w = w.select("metric", "pipeline", F.round("avg", 6).alias("avg"))
    return W.best_per(w, "metric", "pipeline", "avg", R_PIPES)


@register("w3_metric_by_model",
          f"WITH {_G} SELECT metric, " + ", ".join(f"max(value) FILTER (WHERE model = '{m}') AS {m}" for m in R_MODELS)
          + " FROM g WHERE pipeline = 'scoring' GROUP BY metric")
def w3_metric_by_model(spark, sf):
    return W.metric_by_model(_report_grid(spark, sf), "scoring", R_MODELS)


@register("w4_best_model",
          f"WITH {_G} SELECT metric, model, value FROM g WHERE pipeline = 'scoring' QUALIFY row_number() OVER "
          f"(PARTITION BY metric ORDER BY value DESC, {_ord('model', R_MODELS)}) = 1")
def w4_best_model(spark, sf):
    g = _report_grid(spark, sf).where(F.col("pipeline") == "scoring")
    return W.best_per(g, "metric", "model", "value", R_MODELS)


@register("w5_transpose",
          f"WITH {_G} SELECT metric, " + ", ".join(f"max(value) FILTER (WHERE model = '{m}') AS {m}" for m in R_MODELS)
          + " FROM g WHERE pipeline = 'nothing' GROUP BY metric")
def w5_transpose(spark, sf):
    """Model x metric (one row per model) -> metric x model."""
    g = _report_grid(spark, sf).where(F.col("pipeline") == "nothing")
    wide = g.groupBy("model").pivot("metric", list(R_METRICS)).agg(F.first("value"))
    return W.transpose(wide, "model", list(R_METRICS), "metric", R_MODELS)


@register("w6_names",
          f"WITH {_G} SELECT DISTINCT 'metric' AS kind, metric AS name FROM g UNION ALL "
          "SELECT DISTINCT 'pipeline', pipeline FROM g UNION ALL SELECT DISTINCT 'model', model FROM g")
def w6_names(spark, sf):
    return W.names(_report_grid(spark, sf))


@register("f13_merge_results",
          f"WITH {_G} SELECT * FROM g WHERE pipeline = 'nothing' UNION ALL SELECT * FROM g WHERE pipeline = 'scoring'")
def f13_merge_results(spark, sf):
    """Two result sets (one per pipeline) merged by name."""
    g = _report_grid(spark, sf)
    return g.where(F.col("pipeline") == "nothing").unionByName(g.where(F.col("pipeline") == "scoring"))


@register("s8_s9_grid_json", f"WITH {_G} SELECT pipeline, model, metric, value FROM g")
def s8_s9_grid_json(spark, sf):
    """S8 writes the nested JSON (pipeline keys as stored by the original,
    ``CourpusPreprocessor(name)``), S9 reads it back into the long table."""
    g = _report_grid(spark, sf).withColumn("pipeline", F.concat(F.lit("CourpusPreprocessor("), "pipeline", F.lit(")")))
    path = _scratch(spark, "grid-json")
    RS.write_grid(g, path)
    return RS.read_grid(spark, path).select("pipeline", "model", "metric", F.round("value", 6).alias("value"))


def _runs_sql() -> str:
    from .metric_queries import _m7_sql
    return (f"SELECT 'cleaned' AS model, metric, round(value, 6) AS value FROM ({_m7_sql(True)}) UNION ALL "
            f"SELECT 'raw' AS model, metric, round(value, 6) AS value FROM ({_m7_sql(False)})")


@register("s10_s11_run_metrics", _runs_sql())
def s10_s11_run_metrics(spark, sf):
    """S11 writes one metric file per scored run (two runs over the
    conversation pairs, one with decoder settings), S10 reads them back
    keyed by run."""
    pairs = conversation_pairs(table(spark, sf, "conversations"))
    base = _scratch(spark, "runs")
    RS.write_run_metrics(evaluate_metrics(pairs, clean=True), f"{base}/cleaned",
                         {"comment": "stand-in", "top_p": 0.9, "top_k": 20, "temperature": 0.8})
    RS.write_run_metrics(evaluate_metrics(pairs, clean=False), f"{base}/raw")
    back = RS.read_run_metrics(spark, [f"{base}/cleaned", f"{base}/raw"])
    return back.select("model", "metric", F.round("value", 6).alias("value"))


_STORY_SQL = (
    "WITH d AS (SELECT doc_id, text || chr(10) || chr(10) || '@highlight' || chr(10) || chr(10) || "
    f"coalesce({duck.sentences('text')}[1], '') AS v FROM documents), "
    "l AS (SELECT doc_id, list_filter(list_transform(string_split(v, chr(10)), "
    "lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ls FROM d), "
    "p AS (SELECT doc_id, ls, list_position(ls, '@highlight') AS k FROM l) "
    "SELECT doc_id, array_to_string(list_transform(ls[1:k - 1], lambda x: x || ' '), '') AS article, "
    "array_to_string(list_transform(list_filter(ls[k:], lambda x: x <> '@highlight'), lambda x: x || ' . '), '') AS highlights FROM p"
)


@register("s2_s3_stories", _STORY_SQL)
def s2_s3_stories(spark, sf):
    """S2 over story files derived from ``documents`` (text, a marker, the
    first sentence as highlight; one file per document, written and read by
    tasks of many), then S3 writes the (X, y) rows and reads them back."""
    from ..functions.text import split_sentences
    d = table(spark, sf, "documents")
    story = F.concat("text", F.lit("\n\n@highlight\n\n"), F.coalesce(F.try_element_at(split_sentences("text"), F.lit(1)), F.lit("")))
    src = _scratch(spark, "stories")
    # a file for each id: the stories of rows that share one follow each other
    each = d.select("doc_id", F.struct(F.monotonically_increasing_id().alias("at"), F.coalesce(story, F.lit("")).alias("value")).alias("row"))
    files = each.groupBy("doc_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    write_story_files(files.select(name.alias("name"), F.array_join("rows.value", "\n").alias("value")), src)
    parsed = load_stories(spark, src)
    out = _scratch(spark, "story-json")
    doc = F.nullif("key", F.lit("")).cast("long")
    SS.write_story_arrays(parsed.withColumn("doc_id", doc), out, ["doc_id"])
    return SS.read_story_arrays(spark, out, "doc_id bigint").select("doc_id", "article", "highlights")


@register("s2_story_files", _STORY_SQL)
def s2_story_files(spark, sf):
    """S2 through the data source: a ``.story`` file for each document, written
    by tasks of many and read back with the default glob."""
    from ..functions.text import split_sentences
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("article"), F.array(F.coalesce(
        F.try_element_at(split_sentences("text"), F.lit(1)), F.lit(""))).alias("highlights"))
    path = _scratch(spark, "story-files")
    write_stories(d, path)
    return load_stories(spark, path).select(F.col("key").cast("long").alias("doc_id"), "article", "highlights")


@register("s7_vector_text_file",
          "WITH vocab AS (SELECT DISTINCT unnest(" + duck.ws_tokens("lower(text)") + ") AS word FROM "
          "(SELECT text FROM documents UNION ALL SELECT text FROM benchmark)), "
          "wv AS (SELECT v.word, e.embedding AS vector FROM vocab v JOIN embeddings e ON "
          "e.vec_id = ('0x' || substr(md5(v.word), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings)) "
          "SELECT word, round(sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])), 6) AS norm FROM wv")
def s7_vector_text_file(spark, sf):
    """The vectors of all words of documents and benchmark written as
    ``word v1 ...`` text files (every line twice, so the later-wins rule is
    exercised) and read back."""
    from ..operators.vectors import word_vectors
    texts = table(spark, sf, "documents").select("text").unionByName(table(spark, sf, "benchmark").select("text"))
    wv = word_vectors(texts, "text", table(spark, sf, "embeddings"))
    path = _scratch(spark, "vectors-txt")
    SS.write_word_vectors(wv.unionByName(wv), path)
    back = SS.read_word_vectors(spark, path)
    norm = F.sqrt(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, v: a + v * v))
    return back.select("word", F.round(norm, 6).alias("norm"))
