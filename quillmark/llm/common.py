"""Column expressions and small helpers the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space; ``bytes.split()`` cuts UTF-8 the same way.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint only for a table counted to have at most ``rows`` rows; else Spark picks the join."""
    return F.broadcast(df) if df.count() <= rows else df


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Drop what an operator is about to add, so that clashing input columns are replaced."""
    return df.drop(*[c for c in df.columns if c in names])
