"""The corpus pipeline: filter by quality, drop near copies, decontaminate, mix sources, shard.

Every stage works on all rows of the one before. Null texts count as empty; rows without a doc_id pass the near-copy
stage untouched and are otherwise treated as single documents; rows repeated under one doc_id share its fate in the
near-copy stage, and elsewhere are judged one by one; very long texts are read whole; ties fall to the smallest doc_id;
an empty table passes through as an empty one. Columns other than doc_id, text and source are carried along under names
of their own, so none can clash with what an operator adds; the last stage replaces size, text_crc32, shard and slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.shared import materialise
from quillmark.llm import classifier, decontaminate, mixing, near_copies, sharding
from quillmark.llm.common import documents, text_of, word_count

SHARDS = 16
READ = ("doc_id", "text", "source")


def carried(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``work`` keeps of ``docs``, with the columns of ``docs``; those that no operator reads are set aside."""
    aside = {c: f"aside {i}" for i, c in enumerate(docs.columns) if c not in READ}
    kept = work(docs.withColumnsRenamed(aside))
    return kept.select(*[F.col(f"`{aside[c]}`").alias(c) if c in aside else F.col(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good."""
    model = classifier.fit(docs, documents(spark, sf_dir, "labels"))
    return carried(docs, lambda rows: classifier.score(rows, model).filter("score >= 0.5"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    gone = near_copies.groups(docs, 5, 80).filter("not kept").select("doc_id").distinct()
    return docs.join(materialise(gone, "near-copies"), "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = documents(spark, sf_dir, "benchmark")
    return carried(docs, lambda rows: decontaminate.remove(rows, benchmark))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate takes them."""
    sized = materialise(docs.select("doc_id", "source", word_count(text_of()).alias("size")), "mix-sizes")
    plan = materialise(mixing.rates(sized, mixing.targets(sized)), "mix-plan")
    return carried(docs, lambda rows: mixing.mix(rows, plan))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every taken copy with its shard and slot."""
    return sharding.text_shards(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("mixed", mixed),
    ("shards", shards),
]

#: The classifier is trained and near copies are connected step by step, so no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
