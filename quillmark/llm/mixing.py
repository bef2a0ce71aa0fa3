"""Mix sources to target weights by repetition rates.

Words are summed for each source; weights share a total, no source is repeated more than ``most`` times, and what
a capped source leaves over goes to the others by weight. A document is then taken floor(rate) times, and once
more if its hash falls below the rate's fraction. Each document has eight hash draws; every source uses the one
whose realised sum lies closest to its target, so that long documents do not throw a small source off.

Cases: null texts have no words; a null source is a source of its own, last in order; documents without words are
taken 0 words; repeated rows share their draw; a null doc_id draws as the word "null"; an empty table gives an
empty result; input columns called like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import hinted, plain

DRAWS, RANGE = 8, 4294967296.0
_OWN = ("copies", "copy", "source_size", "target", "_rate", "_base", "_part", "_draw", "_key", "_hash")


def _digest() -> Column:
    """Eight 32-bit draws as 64 hex digits, from the document's id alone."""
    return F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":mix")), 256)


def _draw(digest: Column, k: int | Column) -> Column:
    at = F.lit(k * 8 + 1) if isinstance(k, int) else k * 8 + 1
    return F.conv(F.substr(digest, at, F.lit(8)), 16, 10).cast("double")


def targets(sized: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row for each source: source, source_size, target. The number of sources is taken to be small next to the
    number of documents; only this table is ordered as a whole."""
    sums = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sums.withColumns({"_at": F.row_number().over(order), "_w": weight.cast("long")})
    full = ranked.withColumn("_cap", F.col("source_size") * most)
    by_need = Window.orderBy(F.col("_cap") / F.col("_w"), "_at")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(every) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    ) / F.sum("_w").over(onwards)
    filled = full.withColumn("_level", level)
    open_level = F.min(F.when(F.col("_cap") > F.col("_level") * F.col("_w"), F.struct(
        F.col("_cap") / F.col("_w"), F.col("_at"), F.col("_level").alias("level")))).over(every)["level"]
    return filled.withColumn("_open", open_level).select(
        "source", "source_size",
        F.when(F.col("_open").isNull(), F.col("_cap")).otherwise(
            F.least("_cap", F.col("_open") * F.col("_w"))).alias("target"))


def rates(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Each source's whole copies, fraction and chosen draw."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    split = goals.withColumn("_rate", rate).withColumns(
        {"_base": F.floor("_rate").cast("int"), "_part": (F.col("_rate") - F.floor("_rate")) * RANGE})
    slim = split.select(F.col("source").alias("_key"), "_part")
    drawn = sized.withColumn("_hash", _digest()).join(
        hinted(slim, 100_000), F.col("source").eqNullSafe(F.col("_key")))
    sums = drawn.groupBy("_key").agg(*[
        F.sum(F.when(_draw(F.col("_hash"), k) < F.col("_part"), F.col("size")).otherwise(0)).alias(f"_s{k}")
        for k in range(DRAWS)])
    off = F.array(*[
        F.abs(F.col("_base") * F.col("source_size") + F.col(f"_s{k}") - F.col("target")) for k in range(DRAWS)])
    return (
        split.join(sums, F.col("source").eqNullSafe(F.col("_key")), "left")
        .withColumn("_off", off)
        .withColumn("_draw", F.coalesce(F.array_position("_off", F.array_min("_off")).cast("int") - 1, F.lit(0)))
        .select("source", "source_size", "target", "_base", "_part", "_draw")
    )


def copies(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Add source_size, target and copies to every document; no document moves when the sources are few."""
    rows = plain(docs, *_OWN)
    side = hinted(plan.withColumnRenamed("source", "_key"), 100_000)
    extra = (_draw(_digest(), F.col("_draw")) < F.col("_part")).cast("int")
    return (
        rows.join(side, F.col("source").eqNullSafe(F.col("_key")))
        .withColumn("copies", F.col("_base") + extra)
        .select(*rows.columns, "source_size", "target", "copies")
    )


def mix(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mixed corpus itself: every document as many times as it is taken, with its number ``copy`` from 0."""
    taken = copies(docs, plan)
    return (
        taken.filter("copies > 0")
        .select(*[c for c in taken.columns if c not in ("source_size", "target", "copies")],
                F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    )
