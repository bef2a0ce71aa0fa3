"""Small helpers for the registered queries: comparable output columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.expr import micros


def us(col: str, name: str | None = None) -> Column:
    """Timestamps leave a query as epoch microseconds."""
    return micros(F.col(col)).alias(name or col)


def r6(col: str | Column, name: str | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, 6).alias(name or col)


def i64(col: str | Column, name: str | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("bigint").alias(name or col)


def joined(col: str | Column, name: str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(c, ",").alias(name)


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])
