"""The suffix-stripping stemmer published by M. F. Porter in 1980, as
Column expressions over one lower-case word.

A word is a run of consonants and vowels, ``[C](VC)^m[V]``; ``m`` is its
measure.  Each step looks for its longest suffix and replaces it if what is
left (the stem) meets the step's condition.  Words of other characters than
a-z, and words of one or two letters, stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the published algorithm: suffix and replacement of each step.
STEP_1A = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
          ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
          ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

#: A y that begins a word or follows a vowel is a consonant: it becomes Y.
CONSONANT_Y = ("(^|[aeiouy])y", "Y")
VOWEL, VOWEL_RUN = "[aeiouy]", "[aeiouy]+[^aeiouy]+"
#: Consonant, vowel, consonant other than w, x and y at the end.
SHORT_END = "[^aeiouy][aeiouy][^aeiouywxY]$"


def _marked(w: Column) -> Column:
    return F.regexp_replace(w, CONSONANT_Y[0], "$1" + CONSONANT_Y[1])


def _measure(w: Column) -> Column:
    return F.size(F.regexp_extract_all(_marked(w), F.lit(VOWEL_RUN), 0))


def _has_vowel(w: Column) -> Column:
    return _marked(w).rlike(VOWEL)


def _double(w: Column) -> Column:
    last = F.substring(w, -1, 1)
    return (F.length(w) > 1) & (last == F.substring(w, -2, 1)) & ~last.isin(*"aeiou")


def _short(w: Column) -> Column:
    return _marked(w).rlike(SHORT_END)


def _cut(w: Column, n: int) -> Column:
    return w.substr(F.lit(1), F.length(w) - n)


def _longest(w: Column, rules: Sequence[tuple[str, str]], met: Callable[[Column, str], Column]) -> Column:
    out = w
    for suffix, by in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        stem = _cut(w, len(suffix))
        out = F.when(w.endswith(suffix), F.when(met(stem, suffix), F.concat(stem, F.lit(by))).otherwise(w)).otherwise(out)
    return out


def _step_1b(w: Column) -> Column:
    """The word, with a mark at its end if ed or ing was taken off."""
    return (F.when(w.endswith("eed"), F.when(_measure(_cut(w, 3)) > 0, _cut(w, 1)).otherwise(w))
            .when(w.endswith("ed"), F.when(_has_vowel(_cut(w, 2)), F.concat(_cut(w, 2), F.lit("+"))).otherwise(w))
            .when(w.endswith("ing"), F.when(_has_vowel(_cut(w, 3)), F.concat(_cut(w, 3), F.lit("+"))).otherwise(w))
            .otherwise(w))


def _step_1b_end(w: Column) -> Column:
    x = _cut(w, 1)
    mended = (F.when(x.endswith("at") | x.endswith("bl") | x.endswith("iz"), F.concat(x, F.lit("e")))
              .when(_double(x) & ~F.substring(x, -1, 1).isin("l", "s", "z"), _cut(x, 1))
              .when((_measure(x) == 1) & _short(x), F.concat(x, F.lit("e"))).otherwise(x))
    return F.when(w.endswith("+"), mended).otherwise(w)


def _step_5a(w: Column) -> Column:
    x = _cut(w, 1)
    return F.when(w.endswith("e") & ((_measure(x) > 1) | ((_measure(x) == 1) & ~_short(x))), x).otherwise(w)


_STEPS = (
    lambda w: _longest(w, STEP_1A, lambda stem, _: F.lit(True)),
    _step_1b,
    _step_1b_end,
    lambda w: F.when(w.endswith("y") & _has_vowel(_cut(w, 1)), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w),
    lambda w: _longest(w, STEP_2, lambda stem, _: _measure(stem) > 0),
    lambda w: _longest(w, STEP_3, lambda stem, _: _measure(stem) > 0),
    lambda w: _longest(w, [(s, "") for s in STEP_4], lambda stem, s: (_measure(stem) > 1) & (
        stem.rlike("[st]$") if s == "ion" else F.lit(True))),
    _step_5a,
    lambda w: F.when(w.endswith("ll") & (_measure(w) > 1), _cut(w, 1)).otherwise(w),
)


def porter_stem(word: Column) -> Column:
    """The stem of one lower-case word.  Steps are lambdas over an array of one,
    so that each result is computed once, however often the next step names it."""
    out = F.array(word)
    for step in _STEPS:
        out = F.transform(out, step)
    return F.when(word.rlike("^[a-z]{3,}$"), out[0]).otherwise(word)


def porter_dictionary(words: DataFrame, word_col: str = "word") -> DataFrame:
    """(word, norm) of the distinct words that change: the stemmer runs once for
    each word of the vocabulary, and the dictionary step joins the result back.

    The stems come out of a generator of one row, through which a filter is not
    pushed: it would run the stemmer for every word of the texts, on both sides
    of a join with the dictionary."""
    vocab = words.select(F.col(word_col).alias("word")).where(F.col("word").isNotNull()).distinct()
    stems = vocab.select(F.explode(F.array(F.struct("word", porter_stem(F.col("word")).alias("norm")))).alias("x"))
    return stems.select("x.word", "x.norm").where("norm <> word")
