"""Registry of named queries and their DuckDB oracle SQL.

Each registered query is ``(spark, sf_dir) -> DataFrame`` and reads the given
tables (through the fixture views) in full. Floating outputs are rounded to
six places on both sides so that summation order cannot flip a value hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

DIGITS = 6


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with an optional oracle SQL string."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double/float column; cast int/short columns to bigint."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            cols.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def r(expr: str, digits: int = DIGITS) -> str:
    """SQL twin of ``rounded`` for one expression."""
    return f"round(CAST({expr} AS DOUBLE), {digits})"
