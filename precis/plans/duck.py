"""DuckDB SQL fragments used by the oracle queries.

They restate the text rules of ``precis.functions.text`` in DuckDB syntax
(RE2 regular expressions, 1-based inclusive list slices, ``lambda x:``).
"""

from __future__ import annotations

from ..functions.fixed import CONTRACTIONS, EMAIL_PATTERN, PUNCTUATION, STOP_WORDS
from ..functions.text import contraction_pattern


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


PAIRS = (
    "SELECT u.conv_id, u.turn, u.text AS reference, a.text AS prediction "
    "FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 "
    "WHERE u.role = 'user' AND a.role = 'assistant'"
)


def split_of(doc_id: str = "doc_id") -> str:
    return f"CASE WHEN {doc_id} % 10 = 0 THEN 'test' WHEN {doc_id} % 10 = 1 THEN 'val' ELSE 'train' END"


def ws_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def sentences(x: str) -> str:
    return (f"list_filter(string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), "
            f"lambda s: s <> '')")


def rouge_tokens(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


def rank_words(x: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_''-]+'), "
            f"lambda w: regexp_full_match(w, '\\p{{L}}[\\p{{L}}''-]*'))")


def ngrams(t: str, n: int) -> str:
    if n == 1:
        return t
    return f"list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i + {n - 1}], ' '))"


def remove_symbols(x: str, chars: str = PUNCTUATION) -> str:
    return f"translate({x}, {q(chars)}, '')"


def mask_emails(x: str) -> str:
    return f"regexp_replace({x}, {q(EMAIL_PATTERN)}, 'EMAIL', 'g')"


def remove_digits(x: str) -> str:
    return f"regexp_replace({x}, '(\\p{{Nd}})', '', 'g')"


def stop_list() -> str:
    return "[" + ", ".join(q(w) for w in STOP_WORDS) + "]"


def remove_words(x: str, words: list[str] | None = None) -> str:
    lst = stop_list() if words is None else "[" + ", ".join(q(w) for w in words) + "]"
    return f"array_to_string(list_filter({ws_tokens(x)}, lambda w: NOT list_contains({lst}, w)), ' ')"


def expand_contractions(x: str) -> str:
    pat = q(contraction_pattern(guard=False))
    m = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in CONTRACTIONS.items()) + "}"
    return (f"(SELECT parts[1] || array_to_string(list_transform(range(1, len(found) + 1), "
            f"lambda k: {m}[found[k]] || parts[k + 1]), '') "
            f"FROM (SELECT regexp_split_to_array({x}, {pat}) AS parts, regexp_extract_all({x}, {pat}) AS found))")


def symbols_except_dot(x: str) -> str:
    return remove_symbols(x, PUNCTUATION.replace(".", ""))


def pre_lemma_strong(x: str, keep_dot: bool = True) -> str:
    """Column steps of ``strong`` before the dictionary step."""
    y = remove_digits(mask_emails(expand_contractions(f"lower({x})")))
    return symbols_except_dot(y) if keep_dot else remove_symbols(y)


def mid(x: str) -> str:
    return pre_lemma_strong(x)


def simple(x: str) -> str:
    return symbols_except_dot(mask_emails(f"lower({x})"))


def scoring(x: str) -> str:
    return remove_symbols(f"lower({x})")


def overlap_ctes(prefix: str, src: str, keys: list[str], p: str, r: str) -> str:
    """CTEs computing ``{prefix}_ov(keys..., o)``: clipped overlap of two
    gram lists per key (an explode + group + min, the relational form)."""
    k = ", ".join(keys)
    return (
        f"{prefix}_g AS (SELECT {k}, unnest({p}) AS g, 0 AS side FROM {src} "
        f"UNION ALL SELECT {k}, unnest({r}) AS g, 1 AS side FROM {src}), "
        f"{prefix}_c AS (SELECT {k}, g, sum(1 - side) AS cp, sum(side) AS cr FROM {prefix}_g GROUP BY {k}, g), "
        f"{prefix}_ov AS (SELECT {k}, sum(least(cp, cr)) AS o FROM {prefix}_c GROUP BY {k})"
    )
