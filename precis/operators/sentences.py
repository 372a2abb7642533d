"""T11 beyond the rule: blocks of a text (paragraphs and headings), and a
sentence splitter that learns abbreviations from the corpus.

The trained splitter follows Kiss and Strunk (2006): a word type that mostly
stands before a period, in more cases than chance would bring, is an
abbreviation; a type that follows sentence ends more often than chance is a
sentence starter.  Both are log-likelihood ratios over counts, so training is
a few aggregates over word types; no model is gathered on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_sentences, whitespace_tokens
from ..session import cut_lineage

_PARAGRAPH, _BLOCK, _HEADING = "\u0002", "\u0003", "\u0004"
_BLANKS = " \t\u000b\f"


def block_sentences(c) -> Column:
    """The sentences of a text by blocks: an array of (paragraph, heading, sentence).

    Empty lines part paragraphs.  A line of which all letters are upper case
    is a heading, one sentence of its own; the other lines of a paragraph
    between headings are one text, whose sentences T11 finds.
    """
    c = F.col(c) if isinstance(c, str) else c
    heading = lambda x: (F.upper(x) == x) & (F.lower(x) != x)
    lines = F.transform(F.split(c, "\r\n|[\n\r]", -1), lambda x: F.btrim(x, F.lit(_BLANKS)))
    marked = F.array_join(F.transform(lines, lambda x: F.when(x == "", _PARAGRAPH).when(
        heading(x), F.concat(F.lit(_BLOCK + _HEADING), x, F.lit(_BLOCK))).otherwise(x)), " ")
    blocks = lambda p: F.filter(F.transform(F.split(p, _BLOCK, -1), lambda b: F.trim(b)), lambda b: b != "")
    paragraphs = F.filter(F.transform(F.split(marked, _PARAGRAPH, -1), blocks), lambda p: F.size(p) > 0)
    of_block = lambda k, b: F.when(b.startswith(_HEADING), F.array(F.struct(
        k.cast("int").alias("paragraph"), F.lit(True).alias("heading"), F.substring(b, 2, 1 << 30).alias("sentence")))).otherwise(
        F.transform(split_sentences(b), lambda s: F.struct(k.cast("int").alias("paragraph"), F.lit(False).alias("heading"), s.alias("sentence"))))
    return F.flatten(F.transform(paragraphs, lambda p, k: F.flatten(F.transform(p, lambda b: of_block(k, b)))))


def block_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, i, paragraph, heading, sentence)``; rankers take the rows that
    are no headings, ``i`` counts all."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(block_sentences(F.coalesce(text_col, F.lit("")))).alias("i", "s"))
    return rows.select("doc_id", "i", "s.paragraph", "s.heading", "s.sentence")


# ------------------------------------------------------------------ training

#: Limits of the published method: for an abbreviation's score and a starter's ratio.
ABBREVIATION, STARTER = 0.3, 30.0
#: A token: opening marks, the word (periods may stand inside), perhaps a period, closing marks.
TOKEN = r"""^[("'\[]*([\p{L}\p{N}][\p{L}\p{N}.'-]*?)(\.?)([!?]*)[)"'\],;:]*$"""


def word_type(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, TOKEN, 1))


def _has_period(token: Column) -> Column:
    return token.contains(".") & (F.regexp_extract(token, TOKEN, 2) == ".")


def _typed(token: Column) -> Column:
    """Type and period of a token, to come out of a generator: a filter on them is not
    pushed through it, so each expression runs once (and for distinct tokens only, where these are counted)."""
    return F.struct(word_type(token).alias("type"), _has_period(token).alias("period"))


def abbreviation_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(type, with_period, without, score)`` of the word types that stand before a period."""
    toks = docs.select(F.explode(whitespace_tokens(F.coalesce(text_col, F.lit("")))).alias("t"))
    toks = toks.groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    types = toks.select("c", F.explode(F.array(_typed(F.col("t")))).alias("x")).where("x.type <> ''")
    counts = types.groupBy("x.type").agg(F.sum(F.when(F.col("x.period"), F.col("c")).otherwise(0)).alias("with_period"),
                                         F.sum(F.when(F.col("x.period"), 0).otherwise(F.col("c"))).alias("without"))
    counts = cut_lineage(counts, "types")
    total = counts.agg(F.sum("with_period").alias("np"), (F.sum("with_period") + F.sum("without")).alias("n"))  # one row
    a, ab = F.col("with_period") + F.col("without"), F.col("with_period")
    p = F.greatest(F.least(F.col("np") / F.col("n"), F.lit(1 - 1e-9)), F.lit(1e-9))
    ratio = 2 * (ab * F.log(F.lit(0.99)) + (a - ab) * F.log(F.lit(0.01)) - ab * F.log(p) - (a - ab) * F.log(1 - p))
    periods = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit(""))) + 1
    others = F.length("type") - periods + 1
    score = ratio * F.exp(-others) * periods * F.pow(others.cast("double"), -F.col("without").cast("double"))
    return counts.where((ab > 0) & F.col("type").rlike(r"\p{L}")).crossJoin(F.broadcast(total)).select(
        "type", "with_period", "without", score.alias("score"))


def _ln(n: Column, p: Column) -> Column:
    """n ln p, 0 if n is."""
    return F.when(n == 0, 0.0).otherwise(n * F.log(p))


def starter_counts(docs: DataFrame, abbreviations: DataFrame, text_col: str = "text") -> DataFrame:
    """``(type, after_end, total, ratio)`` of the types that follow sentence ends;
    an end is !, ? or the period of a type that is no abbreviation."""
    toks = whitespace_tokens(F.coalesce(text_col, F.lit("")))
    mark = lambda t: (t.contains("!") | t.contains("?")) & t.rlike(r"[!?][)\"'\]]*$")
    pairs = docs.select(toks.alias("t")).select(F.explode(F.zip_with(
        F.concat(F.array(F.lit("")), F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0)))), "t",
        lambda a, b: F.struct(b.isNotNull().alias("some"), word_type(b).alias("type"), F.when(_has_period(a), word_type(a)).alias("before"),
                              mark(a).alias("mark")))).alias("x")).where("x.some")
    rows = pairs.select("x.type", "x.before", "x.mark").where("type <> ''")
    known = abbreviations.select(F.col("type").alias("before"), F.lit(True).alias("abbreviated"))
    ends = F.col("mark") | (F.col("before").isNotNull() & (F.length("before") > 1) & F.col("abbreviated").isNull())
    counts = rows.groupBy("type", "before", "mark").agg(F.count(F.lit(1)).alias("c")).join(known, "before", "left") \
        .groupBy("type").agg(F.sum(F.when(ends, F.col("c")).otherwise(0)).alias("after_end"), F.sum("c").alias("total"))
    counts = cut_lineage(counts, "starters")
    totals = counts.agg(F.sum("after_end").alias("a"), F.sum("total").alias("n"))  # one row
    a, b, ab, n = F.col("a"), F.col("total"), F.col("after_end"), F.col("n")
    p, p1 = b / n, ab / a
    p2 = (b - ab) / F.greatest(n - a, F.lit(1))
    rest = n - a - b + ab
    ratio = -2 * (_ln(ab, p) + _ln(a - ab, 1 - p) + _ln(b - ab, p) + _ln(rest, 1 - p)
                  - _ln(ab, p1) - _ln(a - ab, 1 - p1) - _ln(b - ab, p2) - _ln(rest, 1 - p2))
    return counts.crossJoin(F.broadcast(totals)).where(ab > 0).select(
        "type", "after_end", "total", F.when(p1 > p, ratio).otherwise(0.0).alias("ratio"))


@dataclass(frozen=True)
class Splitter:
    """What was learnt: two tables of word types."""

    abbreviations: DataFrame  #: (type)
    starters: DataFrame  #: (type)

    @classmethod
    def train(cls, docs: DataFrame, text_col: str = "text") -> Splitter:
        abbreviations = cut_lineage(abbreviation_counts(docs, text_col).where(F.col("score") >= ABBREVIATION).select("type"), "abbreviations")
        starters = cut_lineage(starter_counts(docs, abbreviations, text_col).where(F.col("ratio") >= STARTER).select("type"), "starters")
        return cls(abbreviations, starters)

    def sentences(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(doc_id, i, sentence)``: the rule's sentences, joined again (by a
        space) where the mark between them is not an end: the period of a single
        letter, or of an abbreviation that no capitalised starter follows."""
        parts = docs.select(F.col(id_col).alias("doc_id"), split_sentences(F.coalesce(text_col, F.lit(""))).alias("s"))
        parts = parts.select("doc_id", F.posexplode(F.zip_with("s", F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0))),
                                                               lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("k", "x"))
        last = F.element_at(F.split("x.a", r"\s+"), -1)
        first = F.split("x.b", r"\s+")[0]
        cut = parts.select("doc_id", "k", F.col("x.a").alias("part"), F.when(_has_period(last), word_type(last)).alias("before"),
                           F.when(F.col("x.b").isNotNull(), word_type(first)).alias("after"),
                           F.coalesce(F.regexp_extract(first, TOKEN, 1).rlike(r"^\p{Lu}"), F.lit(False)).alias("capital"))
        known = self.abbreviations.select(F.col("type").alias("before"), F.lit(True).alias("abbreviated"))
        starts = self.starters.select(F.col("type").alias("after"), F.lit(True).alias("starts"))
        marked = cut.join(known, "before", "left").join(starts, "after", "left")
        single = F.coalesce((F.length("before") == 1) & F.col("before").rlike(r"\p{L}"), F.lit(False))
        goes_on = single | (F.col("abbreviated").isNotNull() & ~(F.col("starts").isNotNull() & F.col("capital")))
        order = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        grouped = marked.withColumn("i", F.coalesce(F.sum((~goes_on).cast("int")).over(order), F.lit(0)).cast("int"))
        lines = F.array_sort(F.collect_list(F.struct("k", "part")))
        return grouped.groupBy("doc_id", "i").agg(lines.alias("lines")).select(
            "doc_id", "i", F.array_join(F.transform("lines", lambda x: x["part"]), " ").alias("sentence"))
