"""Named cleaning pipelines.

A pipeline is an ordered list of steps.  A column step is a
``Column -> Column`` function, so consecutive column steps fold into one
narrow projection (one codegen stage, no shuffle).  A dictionary step (word
normalisation through a lemma/stem table, T7/T8) is a DataFrame operator:
the distinct words of blocks of texts are joined to the dictionary, whose words
then take their places.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed import NOUN_PLURAL_RULES, PUNCTUATION, STOP_WORDS
from .regroup import STAYS, replace_words
from .text import (DIGIT, expand_contractions, mask_emails, remove_by_regex, remove_symbols,
                   remove_words, to_lower, whitespace_tokens)


class DictionaryStep:
    """Replace every word by its normal form from a ``(word, norm)`` table.

    ``dictionary`` may be a DataFrame, or a function ``words -> DataFrame``
    that builds one from the distinct words being cleaned (the default
    builds a noun-plural lemma table, see :func:`plural_lemma_dictionary`).
    Like splitting on whitespace and re-joining, the output has single
    spaces between words.
    """

    def __init__(self, dictionary=None, name: str = "lemmatize"):
        self.dictionary = dictionary
        self.__name__ = name

    def apply(self, df: DataFrame, cols: Sequence[str], key_cols: Sequence[str]) -> DataFrame:
        return normalize_words(df, cols, key_cols, self.dictionary)


def plural_lemma_dictionary(words: DataFrame, word_col: str = "word") -> DataFrame:
    """Noun lemma table built from the vocabulary itself.

    The distinct words act as the lexicon: a word maps to the shortest form
    obtained by one detachment rule that is itself a known word (the word
    itself wins ties, then rule order).  Only words that change are kept.
    All work is on distinct words (vocabulary-sized), never on the corpus.
    """
    vocab = words.select(F.col(word_col).alias("word")).where(F.col("word").isNotNull()).distinct()
    cands = []
    for idx, (suffix, rep) in enumerate(NOUN_PLURAL_RULES, start=1):
        stem = F.expr(f"substring(word, 1, length(word) - {len(suffix)})")
        cands.append(F.when(F.col("word").endswith(suffix) & (F.length("word") > len(suffix)),
                            F.struct(F.concat(stem, F.lit(rep)).alias("cand"), F.lit(idx).alias("rule"))))
    cand = vocab.select("word", F.explode(F.filter(F.array(*cands), lambda x: x.isNotNull())).alias("c")) \
        .select("word", F.col("c.cand").alias("cand"), F.col("c.rule").alias("rule"))
    known = cand.join(vocab.withColumnRenamed("word", "cand"), "cand", "left_semi")
    best = known.groupBy("word").agg(
        F.min_by(F.col("cand"), F.struct(F.length("cand"), F.col("rule"))).alias("norm"),
        F.min(F.length("cand")).alias("len"))
    return best.where(F.col("len") < F.length("word")).select("word", "norm")


def normalize_words(df: DataFrame, cols: Sequence[str], key_cols: Sequence[str],
                    dictionary=None) -> DataFrame:
    """Apply a word dictionary to ``cols`` of ``df``; rows with equal
    ``key_cols`` stay rows of their own, a null text stays null.

    The distinct words of blocks of texts meet the dictionary in one join (a
    broadcast when AQE measures it small, else a shuffle join), and its words
    come to the blocks (:func:`~.regroup.replace_words`).
    """
    if dictionary is None:
        dictionary = plural_lemma_dictionary

    def norms(words: DataFrame) -> DataFrame:
        table = dictionary(words) if callable(dictionary) else dictionary
        return table.select("word", F.coalesce("norm", "word").alias("value"))

    return replace_words(df, {c: whitespace_tokens(c) for c in cols}, norms, STAYS)


Step = Callable[[Column], Column] | DictionaryStep


class Pipeline:
    """An ordered, named chain of cleaning steps (fluent ``add``)."""

    def __init__(self, name: str = "preprocessor"):
        self.name = name
        self.steps: list[Step] = []

    def add(self, step: Step) -> "Pipeline":
        self.steps.append(step)
        return self

    def reset(self) -> "Pipeline":
        self.steps.clear()
        return self

    @property
    def is_narrow(self) -> bool:
        return not any(isinstance(s, DictionaryStep) for s in self.steps)

    def column(self, c) -> Column:
        """The whole pipeline as one Column expression (column steps only)."""
        if not self.is_narrow:
            raise ValueError(f"pipeline {self.name!r} has a dictionary step; use transform()")
        c = F.col(c) if isinstance(c, str) else c
        return functools.reduce(lambda acc, f: f(acc), self.steps, c)

    def transform(self, df: DataFrame, cols: Sequence[str] | str, key_cols: Sequence[str] = ("doc_id",)) -> DataFrame:
        """Clean ``cols`` of ``df``; other columns pass through."""
        cols = [cols] if isinstance(cols, str) else list(cols)
        pending: list = []

        def flush(frame: DataFrame) -> DataFrame:
            if not pending:
                return frame
            fns = list(pending)
            pending.clear()
            return frame.withColumns({c: functools.reduce(lambda acc, f: f(acc), fns, F.col(c)) for c in cols})

        for step in self.steps:
            if isinstance(step, DictionaryStep):
                df = flush(df)
                df = step.apply(df, cols, key_cols)
            else:
                pending.append(step)
        return flush(df)

    def __str__(self) -> str:
        return self.name


# ------------------------------------------------------------------ presets

def _symbols_except_dot(c):
    return remove_symbols(c, PUNCTUATION.replace(".", ""))


def _digits(c):
    return remove_by_regex(c, [DIGIT])


def _stop_words(c):
    return remove_words(c, STOP_WORDS)


def strong(dictionary=None) -> Pipeline:
    """P2."""
    return (Pipeline("strong").add(to_lower).add(expand_contractions).add(mask_emails).add(_digits)
            .add(_symbols_except_dot).add(DictionaryStep(dictionary)).add(_stop_words))


def mid() -> Pipeline:
    """P3."""
    return (Pipeline("mid").add(to_lower).add(expand_contractions).add(mask_emails).add(_digits)
            .add(_symbols_except_dot))


def simple() -> Pipeline:
    """P4."""
    return Pipeline("simple").add(to_lower).add(mask_emails).add(_symbols_except_dot)


def nothing() -> Pipeline:
    """P5."""
    return Pipeline("nothing")


def scoring() -> Pipeline:
    """What generated summaries go through before scoring."""
    return Pipeline("scoring").add(to_lower).add(remove_symbols)


def embedding(dictionary=None) -> Pipeline:
    """As ``strong`` but every punctuation mark goes."""
    return (Pipeline("embedding").add(to_lower).add(expand_contractions).add(mask_emails).add(_digits)
            .add(remove_symbols).add(DictionaryStep(dictionary)).add(_stop_words))


PRESETS = {"strong": strong, "mid": mid, "simple": simple, "nothing": nothing,
           "scoring": scoring, "embedding": embedding}


def scoring_columns(c) -> Column:
    return scoring().column(c)


def remove_words_by_table(df: DataFrame, cols: Sequence[str] | str, key_cols: Sequence[str],
                          words: DataFrame, word_col: str = "word") -> DataFrame:
    """J4 / T6 for a word list held as a table (too large for a literal
    set): the distinct words of blocks of texts are matched against the list by
    a join (a broadcast when AQE measures the list small); the words left of a
    text are joined in order with single spaces."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    # A listed word has no value, so a text made only of listed words becomes "".
    listed = words.select(F.col(word_col).alias("word"), F.lit(None).cast("string").alias("value")).distinct()
    return replace_words(df, {c: whitespace_tokens(c) for c in cols}, listed, STAYS)
