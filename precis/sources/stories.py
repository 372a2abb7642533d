"""News story files (S2, S3) and word-vector text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "@highlight"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parse_story(value) -> Column:
    """S2 for one whole file: stripped non-blank lines; before the first
    marker they form the article (each line followed by a space), after it
    the non-marker lines form the highlights (each followed by " . ")."""
    value = F.col(value) if isinstance(value, str) else value
    lines = F.filter(F.transform(F.split(value, "\n", -1), _strip), lambda l: l != "")
    pos = F.array_position(lines, MARKER)
    n = F.size(lines)
    art = F.when(pos > 0, F.slice(lines, 1, F.greatest(pos - 1, F.lit(0)))).otherwise(lines)
    rest = F.when(pos > 0, F.slice(lines, F.greatest(pos, F.lit(1)), F.greatest(n - pos + 1, F.lit(0)))) \
        .otherwise(F.array().cast("array<string>"))
    high = F.filter(rest, lambda l: l != MARKER)
    return F.struct(F.array_join(F.transform(art, lambda l: F.concat(l, F.lit(" "))), "").alias("article"),
                    F.array_join(F.transform(high, lambda l: F.concat(l, F.lit(" . "))), "").alias("highlights"))


def read_stories(spark: SparkSession, path: str, glob: str = "*.story") -> DataFrame:
    """Every matching file under ``path`` (recursively), one row each."""
    raw = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
           .text(path, wholetext=True).withColumn("path", F.input_file_name()))
    return raw.select("path", parse_story("value").alias("s")).select("path", "s.article", "s.highlights")


def write_story_arrays(stories: DataFrame, path: str, keys: list[str] | tuple[str, ...] = ()) -> None:
    """S3: rows ``{"X": article, "y": highlights}`` (and ``keys``) as JSON lines
    (no single object gathered on the driver)."""
    stories.select(*keys, F.col("article").alias("X"), F.col("highlights").alias("y")).write.mode("overwrite").json(path)


def read_story_arrays(spark: SparkSession, path: str, keys: str = "") -> DataFrame:
    """S3 read back: ``(keys, article, highlights)``."""
    schema = ", ".join(filter(None, [keys, "X string, y string"]))
    return spark.read.schema(schema).json(path).withColumnsRenamed({"X": "article", "y": "highlights"})


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``word v1 v2 ...`` lines -> ``(word, vector array<float>)``; when
    a word repeats, the later line wins (file order, then line order)."""
    raw = spark.read.text(path).select(
        F.input_file_name().alias("_f"), F.monotonically_increasing_id().alias("_n"), "value")
    parts = raw.select("_f", "_n", F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") > 1)
    rows = parts.select("_f", "_n", F.element_at("p", 1).alias("word"),
                        F.slice("p", 2, F.size("p") - 1).cast("array<float>").alias("vector"))
    return rows.groupBy("word").agg(F.max_by("vector", F.struct("_f", "_n")).alias("vector"))


def write_word_vectors(vectors: DataFrame, path: str) -> None:
    line = F.concat_ws(" ", F.col("word"), F.array_join(F.transform("vector", lambda v: v.cast("string")), " "))
    vectors.select(line.alias("value")).write.mode("overwrite").text(path)
