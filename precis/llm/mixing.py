"""Mixing sources to target weights by hierarchical budgeting, with DataFrame
functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precis.llm.common import ASCII_SPACE, broadcast_if_small, materialise

#: Target weights of the production mix; a name that is not listed weighs 1.
WEIGHTS = {"domain": {"web": 3, "books": 1}, "lang": {"en": 4, "fr": 2, "de": 2, "es": 1}}

_SPACES = "[" + "".join(f"\\x{ord(c):02x}" for c in ASCII_SPACE) + "]+"
LEVELS = ("domain", "lang", "source")
#: Hexadecimal digits of a document's seeded key that name its bin.
_BIN_DIGITS = 3


def word_count(text: Column) -> Column:
    """Words between spaces of the byte range, as the token measure."""
    t = F.trim(F.coalesce(text.cast("string"), F.lit("")), F.lit(ASCII_SPACE))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, _SPACES))).cast("long")


def domain_of(source: Column) -> Column:
    """The top level of the tree: sources numbered 0 to 9 are ``web``, others
    ``books``, and those without a number ``other``."""
    n = F.regexp_extract(F.coalesce(source.cast("string"), F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(n == "", "other").when(n.cast("long") < 10, "web").otherwise("books")


def _share_out(nodes: DataFrame, parent: list[str], name: str, weights: dict[str, int]) -> DataFrame:
    """Split each parent's ``budget`` among its children by weight, none above
    its ``supply``; what some cannot take goes to their siblings by weight.

    In order of supply per weight, a child is full if its supply is at most its
    share of what those before it left.  Whole numbers throughout (decimals, as
    products pass 64 bits); fractions are dropped.  Weight 0 takes nothing.
    """
    w = F.lit(1).cast("long")
    for k, v in weights.items():
        w = F.when(F.col(name) == k, F.lit(v).cast("long")).otherwise(w)
    big = lambda c: F.col(c).cast("decimal(19,0)")
    order = [(F.col("supply") / F.col("w")).asc(), F.col(name).asc_nulls_first()]
    by = Window.partitionBy(*parent).orderBy(*order)
    rows = nodes.withColumn("w", w).withColumn("w", F.when(F.col("supply") > 0, F.col("w")).otherwise(F.lit(0)))
    live = rows.where("w > 0")
    live = live.withColumn("before", F.coalesce(F.sum("supply").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    live = live.withColumn("weight_left", F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    live = live.withColumn("left", F.col("budget") - F.col("before"))
    full = big("supply") * big("weight_left") <= big("left") * big("w")
    live = live.withColumn("full", full)
    # those that are not full share what the full ones left, by weight
    rest = Window.partitionBy(*parent)
    live = live.withColumn("taken", F.coalesce(F.sum(F.when(F.col("full"), F.col("supply"))).over(rest), F.lit(0)))
    live = live.withColumn("open", F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(rest), F.lit(0)))
    part = F.expr("cast((cast(budget - taken as decimal(19,0)) * cast(w as decimal(18,0))) div "
                  "cast(greatest(open, 1L) as decimal(19,0)) as bigint)")
    return live.withColumn("budget", F.when(F.col("full"), F.col("supply")).otherwise(part)).drop(
        "w", "before", "weight_left", "left", "full", "taken", "open")


def _same(*names: str) -> Column:
    """Equality, null included, of columns with those that carry a leading underscore."""
    match = F.lit(True)
    for c in names:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return match


def _named(df: DataFrame, keys: list[str], *others: str | Column) -> DataFrame:
    return df.select(*(F.col(c).alias(f"_{c}") for c in keys), *others)


def budgets(leaves: DataFrame, total: Column, weights: dict[str, dict[str, int]], epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, budget) of each leaf that gets tokens.

    ``leaves`` has the leaves' tokens; a leaf can give them ``epochs`` times.
    Weights go down the tree level by level: a node's budget is split among its
    children, and a shortage stays among siblings as long as one can take more.
    Only what a whole node cannot take is left to the node's own siblings,
    because its supply is the sum of its leaves'.
    """
    leaves = leaves.select(F.lit(0).alias("root"), *LEVELS, "tokens", (F.col("tokens") * epochs).alias("supply"))
    nodes = leaves.groupBy("root").agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("all"))
    nodes = nodes.select("root", F.least("supply", total).cast("long").alias("budget"))
    path = ["root"]
    for level in LEVELS:
        children = leaves.groupBy(*path, level).agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens"))
        joined = children.join(_named(nodes, path, "budget"), _same(*path)).drop(*(f"_{c}" for c in path))
        nodes = _share_out(joined, path, level, weights.get(level, {}))
        path = [*path, level]
    return nodes.select(*LEVELS, "tokens", "budget")


def mix(docs: DataFrame, weights: dict[str, dict[str, int]], fraction: float = 0.5, epochs: int = 2, seed: int = 1,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
        with_columns: bool = False) -> DataFrame:
    """One row for each time that a document is taken: (id, domain, lang, source,
    epoch, n_tokens, budget); if asked for, with all columns of ``docs``, in
    their order, as _own0, _own1 and so on.

    The target is ``fraction`` of all tokens (words), split by ``budgets``.  A
    leaf gives whole epochs while they fit, then the prefix of the next epoch's
    seeded order whose tokens stay within the budget; a document that would
    pass it ends the prefix.  The order is by md5 of seed, epoch, id and text.

    A leaf is never sorted as a whole: tokens are summed by the first digits of
    the order's key, the running sums of these bins name the bin in which the
    budget ends, and only that bin's documents are put in order.

    Null and empty texts have 0 tokens: they go with a whole epoch, or the
    prefix.  Null ids, languages and sources are values of their own; repeated
    rows count as often as they occur; empty tables give no rows.  Leaves of
    weight 0 and leaves without tokens give nothing.
    """
    own = [f"_own{i}" for i in range(len(docs.columns))] if with_columns else []
    rows = docs.select(
        F.col(id_col).alias("id"), domain_of(F.col(source_col)).alias("domain"),
        F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("n_tokens"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("th"),
        *(F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own)))
    # what the budgets need, computed once; texts are read again only to be returned
    facts = materialise(rows.drop(*own), "mix-facts")
    leaves = facts.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    target = F.floor(F.col("all") * F.lit(fraction)).cast("long")
    given = budgets(leaves, target, weights, epochs)
    given = materialise(given.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)))
                        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")), "mix-budgets")

    path = list(LEVELS)

    def with_budget(df: DataFrame) -> DataFrame:
        own = _named(given, path, "budget", "whole", "rest")
        df = df.join(broadcast_if_small(own, 100_000), _same(*path)).drop(*(f"_{c}" for c in path))
        key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole") + 1, F.coalesce(F.col("id").cast("string"), F.lit("")),
                                "th").cast("binary"))
        return df.withColumn("key", key).withColumn("bin", F.substring("key", 1, _BIN_DIGITS))

    keyed = with_budget(facts)
    bins = keyed.groupBy(*path, "bin").agg(F.sum("n_tokens").alias("bin_tokens"), F.first("rest").alias("bin_rest"))
    order = Window.partitionBy(*path).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("bin_tokens").over(order), F.lit(0)))
    ends = bins.where((F.col("before") <= F.col("bin_rest")) & (F.col("before") + F.col("bin_tokens") > F.col("bin_rest")))
    ends = materialise(_named(ends, path, F.col("bin").alias("end_bin"), "before"), "mix-bins")
    in_end = keyed.join(broadcast_if_small(ends, 100_000), _same(*path) & (F.col("bin") == F.col("end_bin")))
    run = Window.partitionBy(*path, "bin").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    passes = in_end.withColumn("sum", F.col("before") + F.sum("n_tokens").over(run)).where("sum > rest")
    # the first document that passes the budget
    cuts = materialise(_named(passes.groupBy(*path).agg(F.min("key").alias("end_key")), path, "end_key"), "mix-cuts")
    taken = with_budget(rows if own else facts).join(broadcast_if_small(cuts, 100_000), _same(*path), "left")
    partial = (F.col("rest") > 0) & F.coalesce(F.col("key") < F.col("end_key"), F.lit(True))
    out = taken.withColumn("times", (F.col("whole") + partial.cast("long")).cast("int")).where("times > 0")
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select(F.col("id").alias(id_col), *path, "epoch", "n_tokens", "budget", *own)
