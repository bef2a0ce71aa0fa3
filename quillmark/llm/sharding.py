"""Balanced contiguous shards by global prefix sums of sizes.

Rows are range-partitioned along an order; each partition contributes one total, the totals are summed up along
the partitions, and a running sum inside each partition then gives every row the number of bytes before it in the
whole table. Equal targets cut that line. A group of equal keys that a cut would part stays whole if it is no
larger than the largest row, which is the error a cut has anyway; larger groups are cut.

Cases: null texts have no bytes (size 1); ties are ordered by an arrival number, so repeated rows are placed one
by one; an empty table gives an empty result; input columns called like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.shared import materialise
from quillmark.llm.common import plain, text_of

_OWN = ("shard", "slot", "_seq", "_part", "_before", "_rank", "_bytes", "_rows", "_all", "_most", "_to")


def text_size() -> Column:
    return F.octet_length(text_of()).cast("long") + 1


def assign(rows: DataFrame, shards: int, size: str, group: str, *order: str) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless in each shard) to rows in the order (group, *order)."""
    keys = [group, *order, "_seq"]
    placed = materialise(
        plain(rows, *_OWN)
        .withColumn("_seq", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .withColumn("_part", F.spark_partition_id()),
        "shard-order",
    )
    totals = placed.groupBy("_part").agg(F.sum(size).alias("_b"), F.count("*").alias("_n"), F.max(size).alias("_m"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = totals.select(  # one row for each partition
        "_part",
        F.coalesce(F.sum("_b").over(earlier), F.lit(0)).alias("_bytes"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows"),
        F.sum("_b").over(every).alias("_all"),
        F.max("_m").over(every).alias("_most"),
    )
    inside = Window.partitionBy("_part").orderBy(*keys)
    running = inside.rowsBetween(Window.unboundedPreceding, -1)
    cut = materialise(
        placed.join(F.broadcast(base), "_part")
        .withColumn("_before", F.col("_bytes") + F.coalesce(F.sum(size).over(running), F.lit(0)))
        .withColumn("_rank", F.col("_rows") + F.row_number().over(inside) - 1)
        .withColumn("shard", _shard(F.col("_before"), shards)),
        "shard-cuts",
    )
    whole = _whole_groups(cut, shards, size, group)
    moved = (
        cut.join(F.broadcast(whole), F.col(group).eqNullSafe(F.col("_group")), "left")
        .withColumn("shard", F.coalesce("_to", "shard").cast("int"))
    )
    first = moved.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row for each shard
    return (
        moved.join(F.broadcast(first), "shard")
        .withColumn("slot", F.col("_rank") - F.col("_first"))
        .select(*[c for c in rows.columns if c not in _OWN], "shard", "slot")
    )


def _shard(position: Column, shards: int) -> Column:
    at = F.floor(position / F.col("_all") * shards)
    return F.greatest(F.lit(0), F.least(at, F.lit(shards - 1))).cast("int")


def _whole_groups(cut: DataFrame, shards: int, size: str, group: str) -> DataFrame:
    """Where the groups go that cuts part but that are small enough to stay whole: at most shards - 1 rows."""
    ends = cut.groupBy("shard").agg(
        F.min_by(group, "_rank").alias("_low"), F.max_by(group, "_rank").alias("_high"))
    edge = ends.select(F.col("_low").alias("_group")).intersect(ends.select(F.col("_high").alias("_group")))
    span = (
        cut.join(F.broadcast(edge), F.col(group).eqNullSafe(F.col("_group")))
        .groupBy("_group")
        .agg(
            F.min("_before").alias("_start"), F.max(F.col("_before") + F.col(size)).alias("_end"),
            F.min("shard").alias("_from"), F.max("shard").alias("_last"),
            F.first("_all").alias("_all"), F.first("_most").alias("_most"))
    )
    middle = F.floor((F.col("_start") + F.col("_end")) / 2)
    return span.filter(
        (F.col("_from") < F.col("_last")) & (F.col("_end") - F.col("_start") <= F.col("_most"))
    ).select("_group", _shard(middle, shards).alias("_to"))


def text_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every row of ``docs`` with size, shard and slot; texts stay behind, copies of a text lie side by side."""
    rows = plain(docs, "size", "text_crc32", "_text").select(
        *[c for c in docs.columns if c not in ("text", "size", "text_crc32", "_text", *_OWN)],
        text_size().alias("size"), F.crc32(text_of()).alias("text_crc32"), F.xxhash64(text_of()).alias("_text"))
    return assign(rows, shards, "size", "_text", "doc_id").drop("_text")


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write whole rows as one folder for each shard, in slot order within each file."""
    rows = docs.withColumns({"_size": text_size(), "_text": F.xxhash64(text_of())})
    placed = assign(rows, shards, "_size", "_text", "doc_id").drop("_size", "_text")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard").parquet(path)
