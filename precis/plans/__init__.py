"""Query plans: registered queries, the flagship and the larger flows."""

import importlib

_MODULES = (
    "metric_queries",
    "text_queries",
    "sequence_queries",
    "rank_queries",
    "sentence_queries",
    "vector_queries",
    "sampling_queries",
    "stream_queries",
    "report_queries",
    "flagship",
)


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(f"{__name__}.{m}")
