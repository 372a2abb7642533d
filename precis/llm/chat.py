"""Chat formatting: collapse of cumulative snapshots, then rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precis.llm.common import materialise

#: Turns of a conversation that are rendered as one row.
PART = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _joined(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """``left`` with the rows of ``right`` of the same conversation (null is one)
    and equal ``keys``.  ``ck`` alone, a hash of the id, may be that of two."""
    right = right.withColumnsRenamed({c: f"_{c}" for c in ("conv", *keys)})
    match = F.col("conv").eqNullSafe(F.col("_conv"))
    for k in keys:
        match &= F.col(k) == F.col(f"_{k}")
    return left.join(right, match).drop("_conv", *(f"_{k}" for k in keys))


def _facts(convs: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The turns in order, written in ranges: ``part`` is the range and ``at`` the place of a row.

    Ranges are cut by a row's own number too, so that the rows of one
    conversation, one turn number or one text are dealt to several; rows that
    are equal but for that number may stand in any order.
    """
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = convs.select(
        F.col(conv).alias("conv"), F.xxhash64(F.lit(0), conv).alias("ck"), F.col(turn).cast("long").alias("turn"),
        r.alias("role"), F.xxhash64(F.lit(1), r, t).alias("h1"), F.xxhash64(F.lit(2), r, t).alias("h2"), t.alias("text"),
        F.xxhash64(F.monotonically_increasing_id()).alias("own"))
    order = ["ck", "conv", "turn", "role", "h1", "h2", "own"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(rows.select("conv", "ck", "role", "h1", "h2", "text", F.spark_partition_id().alias("part"),
                                   F.monotonically_increasing_id().alias("at")), "ordered-turns")


def _sizes(facts: DataFrame) -> DataFrame:
    """(conv, ck, part, shift, total): of each part of a conversation what makes a place a
    position (pos = at + shift), and the number of turns of the conversation."""
    so_far = Window.partitionBy("conv", "ck").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = facts.groupBy("conv", "ck", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    return materialise(sizes.select(
        "conv", "ck", "part", (F.coalesce(F.sum("n").over(so_far), F.lit(0)) - F.col("first") + 1).alias("shift"),
        F.sum("n").over(Window.partitionBy("conv", "ck")).alias("total")), "turn-counts")


def prefixes(facts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(conv, ck, pos, total, p1, p2): of each turn its position, the number of
    turns of its conversation, and the rolling hash of the turns up to it.

    The hash of a turn includes its position, and hashes are joined by
    exclusive or, so that parts of a conversation roll on their own and a
    running total over parts, one row each, does the rest.
    """
    so_far = Window.partitionBy("conv", "ck").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = _joined(facts.drop("text"), sizes, "ck", "part").withColumn("pos", F.col("at") + F.col("shift"))
    rows = rows.withColumn("e1", F.xxhash64("pos", "h1")).withColumn("e2", F.xxhash64("pos", "h2", "h1"))
    rows = materialise(rows.select("conv", "ck", "part", "pos", "total", "e1", "e2"), "turns")
    sums = (rows.groupBy("conv", "ck", "part").agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
            .withColumn("b1", F.coalesce(F.bit_xor("x1").over(so_far), F.lit(0)))
            .withColumn("b2", F.coalesce(F.bit_xor("x2").over(so_far), F.lit(0))).select("conv", "ck", "part", "b1", "b2"))
    rolling = Window.partitionBy("conv", "ck", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("r1", F.bit_xor("e1").over(rolling)).withColumn("r2", F.bit_xor("e2").over(rolling))
    return _joined(rows, sums, "ck", "part").select(
        "conv", "ck", "pos", "total", F.col("r1").bitwiseXOR(F.col("b1")).alias("p1"),
        F.col("r2").bitwiseXOR(F.col("b2")).alias("p2"))


def maximal(rolled: DataFrame) -> DataFrame:
    """(conv, ck, n_turns, n_same): conversations that are no proper prefix of another;
    of equal ones that with the least id, with their number."""
    ends = rolled.where("pos = total").groupBy("pos", "p1", "p2").agg(
        F.min(F.struct(F.col("conv").isNull().alias("none"), "conv", "ck")).alias("first"), F.count("*").alias("n_same"))
    inner = rolled.where("pos < total").select("pos", "p1", "p2").distinct()
    return ends.join(inner, ["pos", "p1", "p2"], "left_anti").select(
        F.col("first.conv").alias("conv"), F.col("first.ck").alias("ck"), F.col("pos").alias("n_turns"), "n_same")


def _safe(c: Column) -> Column:
    """Template marks inside the data are broken by a space, so that they end no turn."""
    for mark in (OPEN, CLOSE):
        c = F.replace(c, F.lit(mark), F.lit(mark.replace("|>", " |>")))
    return c


def render(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """(conv, part, n_turns, n_same, text): the maximal conversations, rendered.

    Logs hold a conversation again each time that it grows.  A conversation
    whose turns (role and text, in order) are the first turns of a longer one
    is dropped; of equal ones the least id stays.  ``text`` holds 256 turns by
    position; a longer conversation has several parts, to be joined in order.
    Turns are numbered in ranges of rows, so neither null or equal ids nor
    null or equal turn numbers bring more to one task or one text.

    Null roles and texts are empty; a null turn number comes first; turns of
    equal number are ordered by role and hash; rows with a null id are one
    conversation; equal rows are turns of their own.  An empty table gives an
    empty one; other columns are not read.
    """
    facts = _facts(convs, conv_col, turn_col, role_col, text_col)
    sizes = _sizes(facts)
    kept = materialise(_joined(sizes, maximal(prefixes(facts, sizes)), "ck"), "maximal")
    line = F.concat(F.lit(OPEN), _safe(F.col("role")), F.lit("\n"), _safe(F.col("text")), F.lit(CLOSE + "\n"))
    pos = F.col("at") + F.col("shift")
    rows = _joined(facts, kept, "ck", "part").select(
        "conv", "ck", F.floor((pos - 1) / PART).cast("long").alias("part"), "n_turns", "n_same", pos.alias("pos"), line.alias("line"))
    parts = rows.groupBy("conv", "ck", "part", "n_turns", "n_same").agg(
        F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("turns"))
    return parts.select(F.col("conv").alias(conv_col), "part", "n_turns", "n_same",
                        F.array_join(F.transform("turns", lambda x: x["line"]), "").alias("text"))
