"""Registry of the queries exposed through ``__spark_entry__``.

Each query is a function ``(spark, sf_dir) -> DataFrame`` over the driver
tables; its oracle, when one exists, is DuckDB SQL over the same tables.
Floats are rounded to 6 places on both sides so the comparison does not
depend on summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def round_all(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column to 6 places."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float") and f.name not in keep:
            out.append(F.round(F.col(f.name).cast("double"), 6).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
