"""Registered streaming queries (ST1 to ST3): the conversation pairs and
the documents are replayed as Parquet files; the final streaming state
must equal the batch answer, so the batch oracles apply unchanged."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cleaning import simple
from ..operators.text_vectors import VectorTable
from ..session import cut_lineage, table
from ..sources.corpus import conversation_pairs
from ..streaming import metrics as ST
from ..streaming.cosine import streaming_cosine
from .metric_queries import m1_bleu, m2_rouge  # noqa: F401  (oracle reuse)
from .registry import ORACLE, register
from .vector_queries import _pair_vectors, _pairs_sv, _r6, _rs


def _pairs_source(spark, sf):
    pairs = conversation_pairs(table(spark, sf, "conversations"))
    path = ST.stage_files(pairs)
    return path, pairs.schema


def _round(df):
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


@register("st1_streaming_bleu", ORACLE["m1_bleu"])
def st1_streaming_bleu(spark, sf):
    path, schema = _pairs_source(spark, sf)
    return _round(ST.streaming_bleu(spark, path, schema))


@register("st2_streaming_rouge", ORACLE["m2_rouge"])
def st2_streaming_rouge(spark, sf):
    path, schema = _pairs_source(spark, sf)
    return _round(ST.streaming_rouge(spark, path, schema))


@register("st3_streaming_clean", ORACLE["p4_simple"])
def st3_streaming_clean(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    path = ST.stage_files(docs)
    return ST.streaming_clean(spark, path, docs.schema, simple())


def _cosine_events(pairs, epoch):
    """Pairs as events, by the length of the reference, and a reset for each later epoch."""
    key = F.when(F.length("reference") < 200, "short").otherwise("long")
    events = pairs.select(key.alias("key"), epoch.alias("epoch"), F.lit(False).alias("reset"), "conv_id", "turn", "prediction", "reference")
    blank = [F.lit(None).cast(events.schema[c].dataType).alias(c) for c in ("conv_id", "turn", "prediction", "reference")]
    resets = events.where("epoch > 0").select("key", "epoch").distinct().select("key", "epoch", F.lit(True).alias("reset"), *blank)
    return events.unionByName(resets)


def _cosine_stream(spark, sf, epoch):
    pairs, (words, rows), dim = _pair_vectors(spark, sf)
    vectors = VectorTable(cut_lineage(words, "words"), rows)  # each micro-batch reads it
    events = _cosine_events(pairs, epoch)
    return streaming_cosine(spark, ST.stage_files(events), events.schema, vectors, dim, ["conv_id", "turn"])


@register("st_streaming_cosine", ORACLE["m5_glove_cosine"])
def st_streaming_cosine(spark, sf):
    """M5 as a stream: pairs joined with the static word vectors, keyed state; equal to batch M5."""
    by_key = _cosine_stream(spark, sf, F.lit(0).cast("long"))
    return by_key.agg(_r6(F.sum("total") / F.sum("n")).alias("glove_cosine"))


@register("st4_reset_cosine",
          "WITH " + _pairs_sv() + ", e AS (SELECT CASE WHEN length(p.reference) < 200 THEN 'short' ELSE 'long' END AS key, "
          "p.turn // 2 AS epoch, c.c FROM pairs p JOIN cos c USING (conv_id, turn)), "
          "m AS (SELECT key, max(epoch) AS epoch FROM e GROUP BY key) "
          f"SELECT key, epoch, count(*) AS n, {_rs('avg(c)')} AS glove_cosine FROM e JOIN m USING (key, epoch) GROUP BY ALL")
def st4_reset_cosine(spark, sf):
    """ST4 in place: each key starts again with the pairs of the next two
    turns, so its state is the mean over its last ones."""
    by_key = _cosine_stream(spark, sf, F.expr("cast(floor(turn / 2) as long)"))
    return by_key.select("key", "epoch", "n", _r6(F.col("total") / F.col("n")).alias("glove_cosine"))
