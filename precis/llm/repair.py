"""Repair of conversation structure: the cheapest edits that make the roles of
a conversation alternate, by dynamic programming over a grammar.

Every turn becomes a letter of a small alphabet (its role's initial and its
fault).  Pieces of conversations with equal letters are one string.  Re-Pair
replaces the most frequent pairs of neighbouring symbols by rules, over all
strings at once.  A rule has one min-plus transfer matrix over the states of
the target's automaton, the product of the matrices of its two symbols; an
entry holds the least cost and the rope of the edits that reach it.  Rules are
evaluated bottom-up once and shared by all strings; strings by all
conversations.

A long conversation is several pieces.  Two passes in order, each with one
state at hand, pick the pieces' entries: from the last piece back the least
cost to go, then forward the states of the cheapest edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precis.llm.common import ASCII_SPACE, broadcast_if_small, materialise

#: Turns of a piece.
PIECE = 256
#: Rounds of Re-Pair, and rules a round.  More rules only share more work:
#: costs and edits do not depend on the grammar.
ROUNDS = 4
RULES = 24

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED = 3  # for a truncated turn that is not deleted

# States of the automaton of s?(ua)+ or nothing: what was put out last.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_STATES, _FINAL = 4, (_START, _ASSISTANT)
#: State after the role that alternation asks for, from each state.
_NEXT = {_START: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}

#: Letters: a turn to be deleted, then initial x (sound, truncated).
_INITIALS = "sua?"  # ?: any other
LETTERS = 1 + 2 * len(_INITIALS)


@dataclass(frozen=True)
class Rope:
    """A string as a tree of shared parts."""

    left: Rope | str
    right: Rope | None
    size: int

    @classmethod
    def of(cls, text: str) -> Rope:
        return cls(text, None, len(text))

    def __add__(self, other: Rope) -> Rope:
        if not self.size or not other.size:
            return self if self.size else other
        return Rope(self, other, self.size + other.size)

    def leaves(self) -> Iterator[str]:
        todo = [self]
        while todo:
            r = todo.pop()
            if r.right is None:
                yield r.left
            else:
                todo += [r.right, r.left]

    def __str__(self) -> str:
        return "".join(self.leaves())

    def __lt__(self, other: Rope) -> bool:
        """By ASCII; reads both ropes only up to where they differ."""
        if self is other:
            return False
        a, b, x, y = self.leaves(), other.leaves(), "", ""
        while True:
            x, y = x or next(a, ""), y or next(b, "")
            if not x or not y:
                return bool(y)
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x[:n] < y[:n]
            x, y = x[n:], y[n:]


#: (cost, edits) or None for each pair of states (before, after).
Matrix = list[list[tuple[int, Rope] | None]]


def _less(a: tuple[int, Rope], b: tuple[int, Rope] | None) -> bool:
    return b is None or a[0] < b[0] or (a[0] == b[0] and a[1] < b[1])


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product; among equal costs the least edits.  Of two cheapest
    edits of the same turns none is the beginning of the other (they would
    differ in insertions, which cost), so what is least in parts is least in
    the whole."""
    out: Matrix = [[None] * _STATES for _ in range(_STATES)]
    for i in range(_STATES):
        for k, first in enumerate(a[i]):
            if first is None:
                continue
            for j, second in enumerate(b[k]):
                if second is not None:
                    entry = (first[0] + second[0], first[1] + second[1])
                    if _less(entry, out[i][j]):
                        out[i][j] = entry
    return out


def insertions() -> Matrix:
    """Between two turns: nothing, or inserted turns (two or more states away
    cost that many)."""
    out: Matrix = [[None] * _STATES for _ in range(_STATES)]
    for i in range(_STATES):
        state, n = i, 0
        while out[i][state] is None:
            out[i][state] = (n * COST[INSERT], Rope.of(INSERT * n))
            state, n = _NEXT[state], n + 1
    return out


def letter_matrix(letter: int) -> Matrix:
    """Insertions before a turn, then the turn's own edit."""
    own: Matrix = [[None] * _STATES for _ in range(_STATES)]
    extra = TRUNCATED if letter and (letter - 1) % 2 else 0
    initial = _INITIALS[(letter - 1) // 2] if letter else ""
    for i in range(_STATES):
        moves = [(i, DELETE, COST[DELETE])]
        if letter:
            moves.append((_NEXT[i], REROLE, COST[REROLE] + extra))
            if (initial == "s" and i == _START) or (initial and initial == "ua"[_NEXT[i] == _ASSISTANT]):
                moves.append((_SYSTEM if initial == "s" else _NEXT[i], KEEP, COST[KEEP] + extra))
        for j, edit, cost in moves:
            if _less((cost, Rope.of(edit)), own[i][j]):
                own[i][j] = (cost, Rope.of(edit))
    return product(insertions(), own)


# ------------------------------------------------------------------ Re-Pair

def _replace(symbols: np.ndarray, a: int, b: int, rule: int) -> np.ndarray:
    """Each pair (a, b) by ``rule``, from the left."""
    at = np.flatnonzero((symbols[:-1] == a) & (symbols[1:] == b))
    if not len(at):
        return symbols
    if a == b and len(at) > 1:  # of a run's pairs every other one
        start = np.concatenate([[True], np.diff(at) > 1])
        first = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - first) % 2 == 0]
    out = symbols.copy()
    out[at] = rule
    return np.delete(out, at + 1)


Rules = list[tuple[int, int]]  # rule k makes symbol LETTERS + k


def _decode(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint16)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often pairs occur, for each batch: a row for each pair of symbols."""
    for b in batches:
        count: dict[int, int] = {}
        for data, n in zip(b.column("symbols").to_pylist(), b.column("n").to_pylist()):
            s = _decode(data).astype(np.int64)
            for p in (s[:-1] << 16 | s[1:]).tolist():
                count[p] = count.get(p, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.int64()), pa.array(count.values(), pa.int64())], names=["pair", "n"])


def _shortened(rules: list[tuple[int, int, int]]):
    """``symbols`` with each of the rules' pairs replaced."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b.column("symbols").to_pylist():
                s = _decode(data)
                for rule in rules:
                    s = _replace(s, *rule)
                out.append(s.tobytes())
            yield b.set_column(b.schema.get_field_index("symbols"), "symbols", pa.array(out, pa.binary()))

    return run


def learn_rules(strings: DataFrame, rounds: int = ROUNDS, rules: int = RULES) -> tuple[DataFrame, Rules]:
    """``strings`` (symbols, n) with their most frequent pairs replaced, and the rules.

    A round counts all pairs, weighted by how many pieces share a string, and
    replaces the most frequent ones that have no symbol in common; ties go to
    the least pair.  The driver sees the first few hundred pairs of a count.
    """
    learnt: Rules = []
    for _ in range(rounds):
        counts = strings.select("symbols", "n").mapInArrow(_pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
        top = counts.where("n > 1").orderBy(F.desc("n"), "pair").limit(16 * rules).collect()
        used: set[int] = set()
        fresh: list[tuple[int, int, int]] = []
        for row in top:
            a, b = row.pair >> 16, row.pair & 0xFFFF
            if not {a, b} & used and len(fresh) < rules:
                used |= {a, b}
                fresh.append((a, b, LETTERS + len(learnt) + len(fresh)))
        if not fresh:
            break
        learnt += [(a, b) for a, b, _ in fresh]

        strings = materialise(strings.mapInArrow(_shortened(fresh), strings.schema), "paired")
    return strings, learnt


def rule_matrices(rules: Rules) -> list[Matrix]:
    """The matrices of all letters and rules, bottom-up."""
    out = [letter_matrix(x) for x in range(LETTERS)]
    for a, b in rules:
        out.append(product(out[a], out[b]))
    return out


_MATRIX_SQL = "sid bigint, costs array<int>, ranks array<int>, audits array<string>"
_FAR = 1 << 30


def string_matrices(strings: DataFrame, rules: Rules) -> DataFrame:
    """(sid, costs, ranks, audits): of each string the matrix row by row, with
    the place of each entry's edits among those from the same state."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = rule_matrices(rules)
        for b in batches:
            costs, ranks, audits = [], [], []
            for data in b.column("symbols").to_pylist():
                m: Matrix | None = None
                for s in _decode(data).tolist():
                    m = known[s] if m is None else product(m, known[s])
                costs.append([e[0] if e else _FAR for row in m for e in row])
                texts = [[str(e[1]) if e else None for e in row] for row in m]
                audits.append([t for row in texts for t in row])
                ranks.append([sorted(x for x in row if x is not None).index(t) if t is not None else _STATES for row in texts for t in row])
            yield pa.RecordBatch.from_arrays(
                [b.column("sid"), pa.array(costs, pa.list_(pa.int32())), pa.array(ranks, pa.list_(pa.int32())),
                 pa.array(audits, pa.list_(pa.string()))], names=["sid", "costs", "ranks", "audits"])

    return strings.mapInArrow(run, _MATRIX_SQL)


# ------------------------------------------------------------------ the passes over pieces

def _in_order(pieces: DataFrame, *order: Column) -> DataFrame:
    """Whole conversations to tasks, sorted; rows stream, none is gathered."""
    return pieces.repartition("ck").sortWithinPartitions("ck", "own", *order)


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each piece the least cost from each state after it to the end."""
    end = [COST[INSERT] * n for n in (0, 2, 1, 0)]  # insertions that complete the last pair
    conv, togo = None, end
    for b in batches:
        out = []
        for own, costs in zip(zip(b.column("ck").to_pylist(), b.column("own").to_pylist()), b.column("costs").to_pylist()):
            if own != conv:
                conv, togo = own, end
            out.append(togo)
            togo = [min(costs[i * _STATES + j] + togo[j] for j in range(_STATES)) for i in range(_STATES)]
        yield b.append_column("togo", pa.array(out, pa.list_(pa.int64())))


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the states before and after each piece on the cheapest path whose
    edits are least.  A piece's edits end with a turn's, so those of different
    entries differ within the piece, which decides."""
    conv, state = None, _START
    for b in batches:
        before, after, cost = [], [], []
        for own, costs, ranks, togo in zip(zip(b.column("ck").to_pylist(), b.column("own").to_pylist()),
                                           *(b.column(c).to_pylist() for c in ("costs", "ranks", "togo"))):
            if own != conv:
                conv, state = own, _START
            row = range(state * _STATES, (state + 1) * _STATES)
            best = min((costs[e] + togo[e % _STATES], ranks[e], e % _STATES) for e in row)
            before.append(state)
            cost.append(costs[state * _STATES + best[2]])
            state = best[2]
            after.append(state)
        names = ["ck", "own", "piece", "sid", "is_last"]
        yield pa.RecordBatch.from_arrays([*map(b.column, names), *(pa.array(x, pa.int64()) for x in (before, after, cost))],
                                         names=[*names, "before", "after", "cost"])


_TOKENS_SQL = "ck bigint, own bigint, piece bigint, audit string, cost bigint, tail string, turn_edits array<struct<inserted:string,role:string>>"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece's edits: for each turn the inserted turns before it and its
    new role ('' deleted, null kept as it is); ``tail`` what follows the last piece."""
    names = {_USER: "user", _ASSISTANT: "assistant"}
    types = pa.list_(pa.struct([("inserted", pa.string()), ("role", pa.string())]))
    for b in batches:
        audits, costs, tails, edits = [], [], [], []
        for audit, letters, state, last, c in zip(*(b.column(n).to_pylist() for n in ("audit", "letters", "before", "is_last", "cost"))):
            out, inserted, at, letters = [], "", 0, _decode(letters)
            for e in audit:
                if e == INSERT:
                    state = _NEXT[state]
                    inserted += f"{names[state]}:\n"
                    continue
                role = "" if e == DELETE else None
                if e == KEEP and _INITIALS[(letters[at] - 1) // 2] == "s":
                    state = _SYSTEM
                elif e != DELETE:
                    state = _NEXT[state]
                    role = names[state] if e == REROLE else None
                out.append({"inserted": inserted, "role": role})
                inserted, at = "", at + 1
            more = ""
            while last and state not in _FINAL:
                state = _NEXT[state]
                more += f"{names[state]}:\n"
                audit += INSERT
                c += COST[INSERT]
            audits.append(audit)
            costs.append(c)
            tails.append(more)
            edits.append(out)
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in ("ck", "own", "piece")), pa.array(audits, pa.string()), pa.array(costs, pa.int64()),
             pa.array(tails, pa.string()), pa.array(edits, types)],
            names=["ck", "own", "piece", "audit", "cost", "tail", "turn_edits"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces in order: a conversation's edits, cost and the hash of its
    repaired text.  The hash runs along; no text is gathered."""
    conv, sha, audit, cost, begun = None, None, [], 0, False
    out: list[tuple] = []
    for b in batches:
        for own, a, c, text in zip(zip(b.column("ck").to_pylist(), b.column("own").to_pylist()),
                                   *(b.column(n).to_pylist() for n in ("audit", "cost", "text"))):
            if own != conv:
                if conv is not None:
                    out.append((*conv, "".join(audit), cost, sha.hexdigest()))
                conv, sha, audit, cost, begun = own, hashlib.sha256(), [], 0, False
            audit.append(a)
            cost += c
            if text:  # ends with a line feed that only another line keeps
                sha.update(("\n" if begun else "").encode() + text[:-1].encode())
                begun = True
        if out:
            yield _digests(out)
            out = []
    if conv is not None:
        yield _digests([(*conv, "".join(audit), cost, sha.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      names=["ck", "own", "audit", "cost", "repaired_sha256"])


# ------------------------------------------------------------------ turns

def damage(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) with faults put in, by crc32 of ``conv:turn``
    modulo 20: 0 drops the turn, 1 empties its text, 2 takes its marks .!? out,
    3 repeats it, 4 makes it the user's.  Null ids and turns count as a space
    there; null roles and texts become one."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = convs.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"),
                        text(text_col).alias("text"),
                        (F.crc32(F.concat(text(conv_col), F.lit(":"), text(turn_col))) % 20).alias("kind"))
    rows = rows.where("kind <> 0").withColumns({
        "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    return rows.select("conv", "turn", "role", "text", F.explode(F.sequence(F.lit(0), (F.col("kind") == 3).cast("int")))).drop("col")


def _ordered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns in order, written in ranges, and what makes a row's place (at) its
    position: (conv, ck, own, range, shift, total).

    Ranges are cut by a row's own number too, so that one conversation, turn
    number or text is dealt to several.  ``own`` tells conversations apart
    whose ids have equal hashes.
    """
    rows = turns.select(
        "conv", F.xxhash64(F.lit(0), "conv").alias("ck"), F.xxhash64(F.lit(1), "conv").alias("own"), "turn", "role", "text",
        F.xxhash64(F.lit(2), "role", "text").alias("h1"), F.xxhash64(F.lit(3), "role", "text").alias("h2"),
        F.xxhash64(F.monotonically_increasing_id()).alias("number"))
    order = ["ck", "own", "turn", "role", "h1", "h2", "number"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    facts = materialise(rows.select("conv", "ck", "own", "turn", "role", "text", "h1", "h2", F.spark_partition_id().alias("range"),
                                    F.monotonically_increasing_id().alias("at")), "ordered-turns")
    so_far = Window.partitionBy("ck", "own").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = facts.groupBy("ck", "own", "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    sizes = sizes.select("ck", "own", "range", (F.coalesce(F.sum("n").over(so_far), F.lit(0)) - F.col("first")).alias("shift"),
                         F.sum("n").over(Window.partitionBy("ck", "own")).alias("total"))
    return facts, materialise(sizes, "turn-counts")


def _lettered(facts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(ck, own, pos, total, turn, initial, blank, duplicate, truncated, letter) of each turn."""
    end = F.rtrim(F.col("text"), F.lit(ASCII_SPACE))
    initial = F.coalesce(
        *(F.when(F.substring("role", 1, 1) == x, k) for k, x in enumerate(_INITIALS[:-1])), F.lit(len(_INITIALS) - 1))
    rows = facts.select("ck", "own", "range", "at", "turn", "h1", "h2", initial.alias("initial"), (end == "").alias("blank"),
                        (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("open"))
    rows = rows.join(sizes, ["ck", "own", "range"]).withColumn("pos", F.col("at") + F.col("shift")).drop("range", "at", "shift")
    # written first, so that the join's sides are plain exchanges and a text said often can be split
    rows = materialise(rows, "faults")
    again = rows.groupBy("ck", "own", "h1", "h2").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = materialise(again, "said-again")
    rows = rows.join(broadcast_if_small(again, 200_000), ["ck", "own", "h1", "h2"], "left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    rows = rows.withColumn("duplicate", duplicate).withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("open"))
    letter = F.when(F.col("blank") | F.col("duplicate"), 0).otherwise(1 + 2 * F.col("initial") + F.col("truncated").cast("int"))
    return rows.select("ck", "own", "pos", "total", "turn", "initial", "blank", "duplicate", "truncated", letter.alias("letter"))


def _pieces(rows: DataFrame) -> DataFrame:
    """A row for each 256 turns by position: their letters, counts of faults and
    of role pairs out of order, and the initials at both ends."""
    pieces = rows.groupBy("ck", "own", F.floor(F.col("pos") / PIECE).cast("long").alias("piece"), "total").agg(
        F.sort_array(F.collect_list(F.struct("pos", "initial", "letter"))).alias("turns"),  # PIECE at most
        *(F.count(F.when(F.col(c), 1)).alias(c) for c in ("blank", "duplicate", "truncated")))
    in_order = lambda a, b: F.array_contains(F.array(*map(F.lit, (1, 12, 21))), 10 * a + b)  # noqa: E731  su, ua, au
    inner = F.aggregate(F.sequence(F.lit(1), F.size("turns")), F.lit(0).cast("long"), lambda n, i: n + F.when(
        (i < F.size("turns")) & ~in_order(F.get("turns", i - 1)["initial"], F.get("turns", i)["initial"]), 1).otherwise(0))
    code = F.array_join(F.transform("turns", lambda x: F.concat(F.lpad(F.hex(x["letter"].cast("long")), 2, "0"), F.lit("00"))), "")
    before = F.lag(F.col("last_initial")).over(Window.partitionBy("ck", "own").orderBy("piece"))
    pieces = pieces.select(
        "ck", "own", "piece", "total", "blank", "duplicate", "truncated", inner.alias("inner"),
        F.get("turns", F.lit(0))["initial"].alias("first_initial"), F.element_at("turns", -1)["initial"].alias("last_initial"),
        F.to_binary(code, F.lit("hex")).alias("symbols"), ((F.col("piece") + 1) * PIECE >= F.col("total")).alias("is_last"))
    return pieces.withColumn("_before", before).withColumn(
        "illegal", F.col("inner") + F.when(F.col("_before").isNotNull() & ~in_order(F.col("_before"), F.col("first_initial")), 1).otherwise(0)
    ).drop("_before", "inner", "first_initial", "last_initial", "total")


def _chosen(pieces: DataFrame) -> DataFrame:
    """(ck, own, piece, audit, cost, tail, turn_edits) of each piece."""
    strings = materialise(pieces.groupBy("symbols").agg(F.count("*").alias("n"))
                          .withColumn("sid", F.monotonically_increasing_id()).select("sid", "symbols", "n"), "strings")
    shorter, rules = learn_rules(strings)
    matrices = materialise(string_matrices(shorter, rules), "matrices")
    known = materialise(strings.join(matrices, "sid").select("symbols", "sid", "costs", "ranks"), "known")
    steps = pieces.select("ck", "own", "piece", "is_last", "symbols").join(broadcast_if_small(known, 50_000), "symbols").drop("symbols")
    back = _in_order(steps, F.desc("piece")).mapInArrow(_backward, steps.withColumn("togo", F.lit(None).cast("array<bigint>")).schema)
    paths = _in_order(materialise(back, "to-go"), F.asc("piece")).mapInArrow(
        _forward, "ck bigint, own bigint, piece bigint, sid bigint, is_last boolean, before bigint, after bigint, cost bigint")
    paths = materialise(paths, "paths")
    texts = strings.join(matrices, "sid").select("sid", "symbols", "audits")
    picked = paths.join(texts, "sid").select("ck", "own", "piece", "cost", "before", "is_last", F.col("symbols").alias("letters"),
                                             F.get("audits", (F.col("before") * _STATES + F.col("after")).cast("int")).alias("audit"))
    return picked.mapInArrow(_tokens, _TOKENS_SQL)


def repair(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           damaged: bool = True) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256) of every conversation: faults of its turns, and the
    cheapest edits that make its roles ``(s?(ua)+)?``.

    With ``damaged`` the faults of :func:`damage` are put in first.  Turns are
    taken by number, nulls first; those of equal number by role and a hash of
    their text.  A turn's first fault counts: blank (nothing but space
    characters), duplicate (role and text as in an earlier turn), truncated
    (the last other character is not one of .!?).  To keep costs 0, another
    role 3, to delete 4 (blank and duplicate turns must go), an empty turn
    put in 3; a truncated turn that stays costs 3 more.  Of equally cheap
    edits the least by ASCII count (D, I, K, R).

    Null roles and texts are one space (a blank turn); a role that begins with
    none of s, u, a can only be changed or deleted; rows with a null id are one
    conversation; equal rows are turns of their own.  A conversation without
    turns after the damage has zeros, no edits and the hash of the empty text.
    An empty table gives an empty one; other columns are not read.  Texts are
    compared by 128-bit hashes.  SHA-256 runs over a text in order, so the
    pieces of one conversation stream through one task at the end.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    turns = damage(convs, conv_col, turn_col, role_col, text_col) if damaged else convs.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    facts, sizes = _ordered(turns)
    rows = materialise(_lettered(facts, sizes), "letters")
    pieces = materialise(_pieces(rows), "pieces")
    chosen = materialise(_chosen(pieces), "edits")
    # the repaired text of each piece, then the hash along the pieces
    said = facts.join(sizes, ["ck", "own", "range"]).withColumn("pos", F.col("at") + F.col("shift"))
    said = said.groupBy("ck", "own", F.floor(F.col("pos") / PIECE).cast("long").alias("piece")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    line = lambda t, e: F.concat(e["inserted"], F.when(e["role"] == "", "").otherwise(
        F.concat(F.coalesce(e["role"], t["role"]), F.lit(":"), t["text"], F.lit("\n"))))
    texts = said.join(chosen, ["ck", "own", "piece"]).select(
        "ck", "own", "piece", "audit", "cost", F.concat(F.array_join(F.zip_with("turns", "turn_edits", line), ""), "tail").alias("text"))
    done = _in_order(texts, F.asc("piece")).mapInArrow(
        _digest, "ck bigint, own bigint, audit string, cost bigint, repaired_sha256 string")
    spread = (rows.where("turn IS NOT NULL").groupBy("ck", "own", "turn").agg(F.lit(1).alias("one")).groupBy("ck", "own").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps")))
    faults = pieces.groupBy("ck", "own").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    every = convs.select(F.col(conv_col).alias("conv")).distinct().select(
        "conv", F.xxhash64(F.lit(0), "conv").alias("ck"), F.xxhash64(F.lit(1), "conv").alias("own"))
    out = every.join(done, ["ck", "own"], "left").join(faults, ["ck", "own"], "left").join(spread, ["ck", "own"], "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).cast("long").alias(c)
    return out.select(F.col("conv").alias(conv_col), *map(number, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
