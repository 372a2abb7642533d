"""Secret scans with DataFrame functions only: patterns, and sliding-window
entropy of candidate strings by incremental counts, with an allow list."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.llm.common import let, running_sums, stage

#: Base kinds in their listed order: pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    # a maximal run under 32 characters holds no longer one, so the length can be in the pattern
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)

#: Character classes for entropy: pattern of a candidate, window, least bits.
#: Random text has about 3.4 bits in 20 hexadecimal characters, 3.8 in 20 of 32
#: or 36 symbols, 4.0 in 20 and 4.2 in 24 of 64.  Of random keys of 20
#: characters that hold a digit, the limits find 99 % (32, 36 or 62 symbols) and
#: 97 % (64 symbols: among separators, words have as many bits); longer keys
#: have more windows.  The last three end at word boundaries, so that they are
#: no piece of a longer identifier.
ENTROPY = (
    ("hex", r"[0-9A-Fa-f]{20,}", 20, 3.0),
    ("base64", r"[A-Za-z0-9+/_-]{24,}", 24, 4.0),
    ("short", r"[A-Za-z0-9+/_-]{20,}", 20, 3.8),
    ("base62", r"\b[A-Za-z0-9]{20,}\b", 20, 3.6),
    ("lower", r"\b[a-z0-9]{20,}\b", 20, 3.2),
    ("upper", r"\b[A-Z0-9]{20,}\b", 20, 3.2),
)

#: Candidates that are no secrets: words and identifiers without digits, numbers,
#: UUIDs, and strings that say they are examples.
ALLOWED = (r"^[A-Za-z/_+-]+$|^[0-9_+-]+$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
           r"|(?i:example|placeholder|changeme|dummy|xxxxxxxx|0123456789|abcdefghij)")
#: What stands before a checksum that is meant to be public.
ALLOWED_BEFORE = r"(?i:sha-?(?:1|224|256|384|512)|md5|crc32|checksum|etag|commit)[\x20:=\"'-]{0,4}$"

KINDS = ("assign", "access", "hex", "entropy")
_SPAN = "array<struct<s:int,k:int,e:int>>"
_FIRST, _CODES = 43, 80  # codes of '+' to 'z'


def _ascii_bounds(pattern: str) -> str:
    """Word boundaries of ASCII characters only; Java's may count letters of any script."""
    if not pattern.startswith(r"\b"):
        return pattern
    return "(?<![A-Za-z0-9_])" + pattern.removeprefix(r"\b").removesuffix(r"\b") + "(?![A-Za-z0-9_])"


def _none() -> Column:
    return F.array().cast(_SPAN)


def _span(start: Column, kind: int, length: Column) -> Column:
    return F.struct(start.alias("s"), F.lit(kind).alias("k"), (start + length).alias("e"))


def _log_weight(c: Column) -> Column:
    """c * log2(c), 0 for 0."""
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def _reaches(text: Column, window: int, least: float) -> Column:
    """Whether some window of ``window`` characters has ``least`` bits a character.

    One pass with the counts of the window's characters: each step adds the
    character that enters and takes off the one that leaves, and moves the sum
    of c * log2(c) by what changed.  Entropy is log2(window) - sum / window.
    """
    def scan(codes: Column) -> Column:
        zero = F.struct(F.array_repeat(F.lit(0), _CODES).alias("n"), F.lit(0.0).cast("double").alias("sum"),
                        F.lit(False).alias("hit"))

        def step(acc: Column, i: Column) -> Column:
            enter = codes[i]
            leave = F.when(i >= window, codes[i - window]).otherwise(-1)
            grown = acc["sum"] + _log_weight(F.get(acc["n"], enter) + 1) - _log_weight(F.get(acc["n"], enter))
            left = F.get(acc["n"], leave) + F.when(leave == enter, 1).otherwise(0)
            total = F.when(leave >= 0, grown - _log_weight(left) + _log_weight(left - 1)).otherwise(grown)
            counts = F.transform(acc["n"], lambda c, j: c + (j == enter).cast("int") - (j == leave).cast("int"))
            full = (i >= window - 1) & (math.log2(window) - total / window >= least)
            return F.struct(counts.alias("n"), total.alias("sum"), (acc["hit"] | full).alias("hit"))

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, lambda acc: acc["hit"])

    return let(F.transform(F.split(text, ""), lambda c: F.ascii(c) - _FIRST), scan)


def _matches(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """For each named pattern the matches (h_), the gaps around them (g_) and the
    matches' starts in code points (s_); empty arrays where nothing matches."""
    t, nothing = F.col(text), F.array().cast("array<string>")
    df = stage(df, **{f"h_{n}": F.when(t.rlike(p), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(nothing)
                      for n, p in patterns.items()})
    df = stage(df, **{f"g_{n}": F.when(F.size(f"h_{n}") > 0, F.split(t, p, -1)).otherwise(nothing)
                      for n, p in patterns.items()})

    def step(n: str) -> Column:
        return F.transform(f"h_{n}", lambda _, i: (
            F.length(F.col(f"g_{n}")[i]) + F.coalesce(F.length(F.get(f"h_{n}", i - 1)), F.lit(0))).cast("long"))

    df = stage(df, **{f"s_{n}": step(n) for n in patterns})
    return running_sums(df, *(f"s_{n}" for n in patterns))


def _base(k: int) -> Column:
    kind, _, _, least = BASE[k]
    spans = F.transform(f"h_{kind}", lambda x, i: _span(F.col(f"s_{kind}")[i].cast("int"), k, F.length(x)))
    return F.filter(spans, lambda _, i: F.length(F.col(f"c_{kind}")[i]) >= least).cast(_SPAN)


def _added(kind: str, _: str, window: int, least: float) -> Column:
    h, g, s = (F.col(f"{x}_e_{kind}") for x in "hgs")
    covered = lambda x, i: F.exists("_spans", lambda b: (b["s"] < s[i] + F.length(x)) & (b["e"] > s[i]))
    spans = F.transform(h, lambda x, i: F.when(
        ~x.rlike(ALLOWED) & ~g[i].rlike(ALLOWED_BEFORE) & ~covered(x, i) & _reaches(x, window, least),
        _span(s[i].cast("int"), 3, F.length(x))))
    return F.filter(spans, lambda x: x.isNotNull()).cast(_SPAN)


def with_spans(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with _text (null as empty), _base and _spans: sorted (s, k, e) spans."""
    patterns = {k: p for k, p, _, _ in BASE} | {f"e_{k}": _ascii_bounds(p) for k, p, _, _ in ENTROPY}
    df = stage(df, _text=F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    keep = [*df.columns]
    df = _matches(df, "_text", patterns)
    df = stage(df, **{f"c_{kind}": F.when(F.size(f"h_{kind}") > 0, F.regexp_extract_all(
        "_text", F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>")) if group else F.col(f"h_{kind}")
        for kind, pattern, group, _ in BASE})
    df = stage(df, _base=F.sort_array(F.concat(*(_base(k) for k in range(len(BASE))))))
    df = stage(df, _spans=F.col("_base"))
    for of in ENTROPY:
        df = stage(df, _spans=F.concat("_spans", _added(*of)))
    return stage(df.select(*keep, "_base", "_spans"), _spans=F.sort_array("_spans"))


def _listed(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", kinds[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans) of every row.

    Base kinds are leftmost, non-overlapping matches; those that are too short
    are dropped after matching.  ``entropy`` spans are whole candidates of a
    character class with a window of high entropy, unless the allow list or
    another span covers them.  Positions count code points, ends exclusive.
    Null and empty texts have no spans; a null id stays null; repeated rows
    give repeated results; other columns are not read.
    """
    rows = with_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    n = lambda k: F.size(F.filter("_spans", lambda x: x["k"] == k)).cast("long")
    return rows.select(F.col("id").alias(id_col), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                       n(3).alias("n_entropy"), F.sha2(_listed("_base").cast("binary"), 256).alias("base_sha256"),
                       _listed("_spans").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of the text, overlapping ones joined, replaced by
    ``mark``; null stays null; rows and other columns stay as they are."""
    empty = F.array().cast("array<struct<s:int,e:int>>")
    last = lambda acc: F.get(acc, F.size(acc) - 1)
    own = [f"_own{i}" for i in range(len(docs.columns))]  # no name of theirs can clash with one made here
    text = own[docs.columns.index(text_col)]
    rows = with_spans(docs.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own))), text)
    rows = stage(rows, _runs=F.aggregate("_spans", empty, lambda acc, x: F.when(
        (F.size(acc) > 0) & (x["s"] < last(acc)["e"]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
            last(acc)["s"].alias("s"), F.greatest(last(acc)["e"], x["e"]).alias("e")))))
        .otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))))))
    t, runs = F.col("_text"), F.col("_runs")
    end = lambda i: F.coalesce(F.get(runs, i - 1)["e"], F.lit(0))
    kept = F.transform(runs, lambda x, i: F.concat(t.substr(end(i) + 1, x["s"] - end(i)), F.lit(mark)))
    clean = F.when(F.size(runs) == 0, F.col(text)).otherwise(
        F.concat(F.array_join(kept, ""), t.substr(last(runs)["e"] + 1, F.length(t))))
    rows = stage(rows, _clean=clean)
    return rows.select(*(F.col("_clean" if o == text else o).alias(c) for c, o in zip(docs.columns, own)))
