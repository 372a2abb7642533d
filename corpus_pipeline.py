"""Training-data pipeline over ``documents``: quality classifier, near
duplicates, benchmark decontamination, secrets, and the mix of sources.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
it kept, and returns the columns of documents; the last one adds, for each time
that a document is taken, its place in the mix.

In every stage null and empty texts are texts without words: they are scored as
any other, have no copies, hits or secrets, and 0 tokens.  Rows with a null id
are rows of their own; of equal rows the join keeps one.  Further columns pass
through, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.llm import decontaminate, mixing, near_dup, quality, secrets
from precis.llm.common import materialise, read


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their texts; n_chars follows."""
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a document is taken, with mix_domain,
    mix_epoch, mix_tokens and mix_budget beside its own columns.  Where a column
    has such a name already, it stays, and the new one ends in "_"."""
    mixed = mixing.mix(docs, mixing.WEIGHTS, with_columns=True)
    # by place: mix() may name a column of its own like one of the documents'
    n, names = len(mixed.columns) - len(docs.columns), list(docs.columns)
    flat = mixed.toDF(*(f"_mix{i}" for i in range(n)), *(f"_own{i}" for i in range(len(docs.columns))))
    facts = {c: f"_mix{i}" for i, c in enumerate(mixed.columns[:n])}
    added = []
    for name, fact in (("mix_domain", "domain"), ("mix_epoch", "epoch"), ("mix_tokens", "n_tokens"), ("mix_budget", "budget")):
        while name in names:
            name += "_"
        names.append(name)
        added.append(F.col(facts[fact]).alias(name))
    return flat.select(*(F.col(f"_own{i}").alias(c) for i, c in enumerate(docs.columns)), *added)


STAGES = [("quality classifier", quality_classifier), ("n-gram Jaccard join", ngram_jaccard_join),
          ("benchmark decontamination", benchmark_decontamination), ("secret scans", secret_scan),
          ("mixing sources", source_mixing)]

#: The classifier's scores are not expressible in SQL; tests/llm compares the
#: other stages with brute force of their own, and the mix with SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = materialise(docs, f"stage-{k}")
    return docs
