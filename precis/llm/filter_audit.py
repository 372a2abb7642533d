"""Audit of how filters act on one another: what each removes at each place of
each order, from count-weighted decision diagrams of failure masks.

Every document gives one bit for each filter that it fails.  Spark counts the
documents of each mask and part; a part then has 2 ** filters counts at most,
whatever the number of documents.  A part's counts become a decision diagram:
a level for each filter in the order of their use, a low branch for documents
that pass and a high one for those that fail, and weights (documents, good
ones, toxic ones) at the ends.  All orders are visited by swapping adjacent
levels, one swap an order; the path of low branches gives an order's steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.llm.common import broadcast_if_small, materialise, stage

#: Names of the five filters, in the order of their bits.
FILTERS = "ABCDE"

Weight = tuple[int, ...]


class Diagram:
    """A zero-suppressed decision diagram whose ends are weights.

    Nodes are (level, low, high), each kept once; a node whose high branch is
    empty is left out.  ``order`` names the filter of each level.
    """

    def __init__(self, counts: Mapping[int, Weight], n: int):
        self.order = list(range(n))
        self._nodes: list[tuple] = []
        self._known: dict[tuple, int] = {}
        self._sums: dict[int, Weight] = {}
        self._zero = (0,) * (len(next(iter(counts.values()))) if counts else 1)
        self.empty = self._keep(("end", self._zero))
        self.root = self._build(0, dict(counts), n)

    def _keep(self, node: tuple) -> int:
        if node not in self._known:
            self._known[node] = len(self._nodes)
            self._nodes.append(node)
        return self._known[node]

    def _node(self, level: int, low: int, high: int) -> int:
        return low if high == self.empty else self._keep((level, low, high))

    def _build(self, level: int, counts: dict[int, Weight], n: int) -> int:
        if not counts:
            return self.empty
        if level == n:
            return self._keep(("end", counts[0]))
        parts: tuple[dict, dict] = ({}, {})
        for mask, w in counts.items():
            parts[mask & 1][mask >> 1] = w
        return self._node(level, *(self._build(level + 1, p, n) for p in parts))

    def branches(self, node: int, level: int) -> tuple[int, int]:
        """Low and high branch at ``level``; a node of a later level has no high one."""
        kept = self._nodes[node]
        return (kept[1], kept[2]) if kept[0] == level else (node, self.empty)

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next one."""
        done: dict[int, int] = {}

        def over(node: int) -> int:
            at = self._nodes[node][0]
            if at == "end" or at > level + 1:
                return node
            if node not in done:
                if at < level:
                    done[node] = self._node(at, *map(over, self._nodes[node][1:]))
                else:
                    grid = [self.branches(x, level + 1) for x in self.branches(node, level)]
                    done[node] = self._node(level, *(self._node(level + 1, grid[0][k], grid[1][k]) for k in (0, 1)))
            return done[node]

        self.root = over(self.root)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def weight(self, node: int) -> Weight:
        """The sum over all ends below ``node``."""
        if node not in self._sums:
            kept = self._nodes[node]
            self._sums[node] = kept[1] if kept[0] == "end" else tuple(
                a + b for a, b in zip(self.weight(kept[1]), self.weight(kept[2])))
        return self._sums[node]

    def all_pass(self, node: int) -> Weight:
        """The weight at the end of the path of low branches."""
        while self._nodes[node][0] != "end":
            node = self._nodes[node][1]
        return self._nodes[node][1]

    def steps(self) -> Iterator[tuple[int, Weight, Weight, int]]:
        """(filter, kept, removed, failing it alone) of each level of the present order."""
        node = self.root
        for level, name in enumerate(self.order):
            low, high = self.branches(node, level)
            yield name, self.weight(low), self.weight(high), self.all_pass(high)[0]
            node = low


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places of the swaps that lead through all orders of n things, each once
    (the plain changes of Steinhaus, Johnson and Trotter)."""
    if n < 2:
        return
    inner, down = adjacent_swaps(n - 1), True
    while True:
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        at = next(inner, None)
        if at is None:
            return
        yield at + 1 if down else at
        down = not down


def all_orders(counts: Mapping[int, Weight], names: str) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)
    for every order of the filters ``names``."""
    d = Diagram(counts, len(names))
    rows: list[tuple[str, list]] = []
    fails, shares = [0] * len(names), [0] * len(names)
    swaps = adjacent_swaps(len(names))
    while True:
        steps = list(d.steps())
        fails[steps[0][0]] = steps[0][2][0]  # the first filter meets all that fail it
        for name, _, removed, _ in steps:
            shares[name] += removed[0]
        rows.append(("".join(names[x] for x in d.order), steps))
        at = next(swaps, None)
        if at is None:
            break
        d.swap(at)
    return [(order, k, kept[0], gone[0], fails[x] - gone[0], alone, gone[1], gone[2], shares[x])
            for order, steps in rows for k, (x, kept, gone, alone) in enumerate(steps, 1)]


_AUDIT = [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in (
    "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))]
_AUDIT_SQL = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c, _ in _AUDIT[3:])


def _audit_part(names: str) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        counts = {m: w for m, *w in zip(*(table.column(c).to_pylist() for c in ("mask", "docs", "good", "toxic")))}
        rows = all_orders({m: tuple(w) for m, w in counts.items()}, names)
        part = table.column("part")[0].as_py()
        return pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*((part, *r) for r in rows)), _AUDIT)], [c for c, _ in _AUDIT])

    return run


def audit(masked: DataFrame, names: str = FILTERS) -> DataFrame:
    """The steps of every order of the filters, for each part.

    ``masked`` has a row for each document: part (string), mask (bit k: fails
    filter k of ``names``), good and toxic (0 or 1).  Counts are added up
    inside tasks first; a part's counts, 2 ** filters rows at most, go to one
    task.
    """
    counts = masked.groupBy("part", "mask").agg(F.count("*").alias("docs"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return counts.groupBy("part").applyInArrow(_audit_part(names), _AUDIT_SQL)


def failure_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic) of every document under the five filters.

    A: under 200 words; B: under half of the words are distinct; C: more than
    3 capitals A-Z in 100 characters; D: a symbol of ``#$%&*|``; E: the same
    text as a document with a smaller id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = stage(rows, words=F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    n, chars = F.size("words"), F.length("text")
    capitals = chars - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [n < 200, 100 * F.size(F.array_distinct("words")) < 50 * n, 100 * capitals > 3 * chars, F.col("text").rlike(r"[#$%&*|]")]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    rows = rows.select("id", "part", mask.alias("mask"), F.xxhash64(F.lit(1), "text").alias("h1"), F.xxhash64(F.lit(2), "text").alias("h2"))
    rows = materialise(rows, "masks")
    first = rows.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    # written first, so that the joins' sides are plain exchanges and a common text can be split
    first = materialise(first, "first-copies")
    rows = rows.join(broadcast_if_small(first, 200_000), ["h1", "h2"], "left")
    late = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(*(
        F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    rows = rows.select("id", "part", (F.col("mask") + F.when(late, 1 << 4).otherwise(0)).alias("mask")).join(marks, "id", "left")
    return rows.select("part", "mask", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley): the five filters of :func:`failure_masks`
    in all 120 orders, for each language.

    A null part is the empty string; null texts are empty.  A null id neither
    fails E nor makes another document fail it, and has no label; rows with
    equal ids and texts do not fail E for one another.  A document is good or
    toxic if any label of its id says so; without a label it is neither.  An
    empty table gives an empty one; other columns are not read.  Texts are
    compared by 128-bit hashes.
    """
    return audit(failure_masks(docs, labels, id_col, text_col, part_col))
