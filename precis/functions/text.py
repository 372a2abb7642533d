"""Scalar text functions (T1 to T13) as Column -> Column expressions.

All of them stay JVM-side (built-in string, regex and higher-order array
functions), so a chain of them compiles into one narrow projection.
Regular expressions use Java syntax; replacement groups are ``$1``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import CONTRACTIONS, EMAIL_PATTERN_LINEAR, EMAIL_TOKEN, PUNCTUATION

SENTENCE_MARK = "\u0001"
# A sentence ends at '.', '!' or '?' followed by whitespace.
SENTENCE_END = r"([.!?])\s+"
WHITESPACE = r"(?U)\s+"
# A ranker word starts with a letter and goes on with letters, "'" or "-".
WORD_CHARS = r"[\p{L}\p{N}_'-]+"
WORD_RULE = r"\p{L}[\p{L}'-]*"
# The same as one pattern: a run of word characters is a word (group 1) or passed over whole.
WORD_OR_RUN = rf"({WORD_RULE}+)(?![\p{{N}}_])|{WORD_CHARS}"
DIGIT = r"\p{Nd}"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_lower(c) -> Column:
    """T1."""
    return F.lower(_col(c))


def contraction_pattern(mapping: Mapping[str, str] | None = None, guard: bool = True) -> str:
    """Ordered alternation of the keys.

    When every key is letters followed by an apostrophe, a lookahead for
    that shape is put in front: it is implied by every key, so matches are
    unchanged, but most positions are rejected before the 117 branches run.
    """
    mapping = CONTRACTIONS if mapping is None else mapping
    alt = "(" + "|".join(re.escape(k) for k in mapping) + ")"
    heads = [k.split("'", 1)[0] for k in mapping if "'" in k]
    if guard and len(heads) == len(mapping) and all(h.isalpha() or h == "" for h in heads):
        longest = max(len(h) for h in heads)
        return f"(?=[A-Za-z]{{0,{longest}}}')" + alt
    return alt


def expand_contractions(c, mapping: Mapping[str, str] | None = None) -> Column:
    """One left-to-right pass of the alternation of all keys.

    The alternation is leftmost and first-listed (not longest), exactly as a
    single ``re.sub`` over ``(k1|k2|...)``.  The text is cut at the matches
    (``split``), the matches are listed (``regexp_extract_all``) and the two
    are zipped back together through a literal map.
    """
    mapping = CONTRACTIONS if mapping is None else mapping
    if not mapping:
        return _col(c)
    c = _col(c)
    pattern = contraction_pattern(mapping)
    lookup = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    # Both lists are made once, and only of texts that can hold a key.
    made = F.array(F.struct(F.split(c, pattern, -1).alias("parts"), F.regexp_extract_all(c, F.lit(pattern), 0).alias("found")))
    joined = F.element_at(F.transform(made, lambda x: F.concat(F.element_at(x["parts"], 1), F.array_join(F.zip_with(
        x["found"], F.slice(x["parts"], 2, F.size(x["parts"])), lambda m, p: F.concat(F.element_at(lookup, m), p)), ""))), 1)
    return F.when(c.contains("'"), joined).otherwise(c) if all("'" in k for k in mapping) else joined


def remove_symbols(c, chars: str = PUNCTUATION) -> Column:
    """Delete every character of ``chars``; whitespace is untouched."""
    return F.translate(_col(c), chars, "")


def remove_by_regex(c, regexes: Sequence[str]) -> Column:
    """T4: delete all matches of the alternation of ``regexes``."""
    if not regexes:
        return _col(c)
    return F.regexp_replace(_col(c), "(" + "|".join(regexes) + ")", "")


def replace_by_regex(c, pairs: Sequence[tuple[str, str]]) -> Column:
    """T5: sequential replacement, in list order."""
    out = _col(c)
    for pattern, rep in pairs:
        out = F.regexp_replace(out, pattern, rep)
    return out


def mask_emails(c, token: str = EMAIL_TOKEN) -> Column:
    """T5e."""
    return replace_by_regex(c, [(EMAIL_PATTERN_LINEAR, token)])


def whitespace_tokens(c) -> Column:
    """``str.split()``; no empty tokens."""
    return F.filter(F.split(_col(c), WHITESPACE), lambda w: w != "")


def remove_words(c, words: Iterable[str]) -> Column:
    """Drop listed words; the rest is joined by single spaces.

    The literal list becomes a hash-set membership test (``InSet``).
    """
    words = list(dict.fromkeys(words))
    toks = whitespace_tokens(c)
    if words:
        toks = F.filter(toks, lambda w: ~w.isin(*words))
    return F.array_join(toks, " ")


def s_stem_word(w: Column) -> Column:
    """Harman's S-stemmer for one lower-case word (default for T7)."""
    return (
        F.when(w.rlike("[^ae]ies$"), F.regexp_replace(w, "ies$", "y"))
        .when(w.rlike("[^aeo]es$"), F.regexp_replace(w, "es$", "e"))
        .when(w.rlike("[^us]s$"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def stem(c, word_fn=s_stem_word) -> Column:
    """T7 as a narrow expression: apply a Column rule to every word."""
    return F.array_join(F.transform(whitespace_tokens(c), word_fn), " ")


def non_letters_to_space(c) -> Column:
    """T9 (as the comment in the original intends, not as its typo)."""
    return F.regexp_replace(_col(c), "[^a-zA-Z]", " ")


def split_sentences(c) -> Column:
    """Rule-based sentence split; the end mark stays on the sentence."""
    marked = F.regexp_replace(_col(c), SENTENCE_END, "$1" + SENTENCE_MARK)
    return F.filter(F.split(marked, SENTENCE_MARK, -1), lambda s: s != "")


def naive_word_count(c) -> Column:
    """Number of spaces."""
    c = _col(c)
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def map_sentences(sentences, fn) -> Column:
    """Apply a Column function to every sentence of an array."""
    return F.transform(_col(sentences), fn)


def rank_words(c) -> Column:
    """Lower-case words as the rankers see them (letter first)."""
    return F.array_remove(F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD_OR_RUN), 1), "")


def rouge_tokens(c) -> Column:
    """Lower-case, anything but [a-z0-9] separates."""
    spaced = F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", " ")
    return F.filter(F.split(spaced, " ", -1), lambda w: w != "")


def ngrams(tokens, n: int) -> Column:
    """N-grams of a token array as space-joined strings (empty if short).

    Built from ``n`` shifted slices zipped together, so no lambda refers
    back to the source array (it is evaluated once per row).
    """
    t = _col(tokens)
    if n == 1:
        return t
    k = F.size(t) - n + 1
    out = F.slice(t, 1, F.greatest(k, F.lit(1)))
    for j in range(1, n):
        out = F.zip_with(out, F.slice(t, j + 1, F.greatest(k, F.lit(1))),
                         lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(k > 0, out).otherwise(F.array().cast("array<string>"))
