"""Array functions on id sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.encode import PAD_ID, SEP_ID
from .text import ngrams  # noqa: F401  (A8 lives with the text functions)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def join_with_sep(doc, summ, sep: int = SEP_ID) -> Column:
    """A3: document + [sep] + summary."""
    return F.concat(_c(doc), F.array(F.lit(sep)), _c(summ))


def pad_right(x, size: int, pad: int = PAD_ID, truncate: bool = False) -> Column:
    """A4: right-pad to ``size``; longer content is kept unless ``truncate``."""
    x = _c(x)
    padded = F.concat(x, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(size) - F.size(x))))
    return F.slice(padded, 1, size) if truncate else padded


def boundary_index(doc) -> Column:
    """A5: the summary starts after the document (and the separator)."""
    return F.size(_c(doc))


def label_range(tokens, sum_idx) -> Column:
    """The targets after the boundary, shifted by one (1-based slice)."""
    t = _c(tokens)
    start = _c(sum_idx) + 2
    return F.when(start <= F.size(t), F.slice(t, start, F.size(t))).otherwise(F.array().cast("array<int>"))


def strip_prompt(generated, context) -> Column:
    """Drop the prompt prefix from a generated sequence."""
    g = _c(generated)
    start = F.size(_c(context)) + 1
    return F.when(start <= F.size(g), F.slice(g, start, F.size(g))).otherwise(F.array().cast("array<int>"))


def sample_row(doc_ids, sum_ids, size: int, sep: int = SEP_ID, pad: int = PAD_ID) -> Column:
    """The model sample struct (tokens, sum_idx)."""
    return F.struct(pad_right(join_with_sep(doc_ids, sum_ids, sep), size, pad).alias("tokens"),
                    boundary_index(doc_ids).cast("int").alias("sum_idx"))
