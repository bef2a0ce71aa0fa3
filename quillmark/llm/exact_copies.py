"""Exact copies by an extendible-hash index kept in shared files.

A key is the 64-bit hash of a text in which every run of white space is one space. The directory maps the first bits
of a key to a bucket; a bucket that would hold more than ``capacity`` bytes doubles its part of the directory and is
split by the next bit, until it fits or has ``DEEPEST`` bits, where it simply grows. Each bucket, a range of keys, is
owned by one task, which reads its keys in order. Under one key the owner keeps a chain: texts are compared byte by
byte, equal ones become one entry with the smallest id and the number of rows, different ones follow each other.

``insert`` leaves an index as it is and returns a new one: buckets that no new key falls into stay in the files they
are in, the others are written again with the new rows. So an insert that fails midway, or loses executors, can be
repeated. ``report`` looks rows up; their place in a chain is told by the SHA-256 of the text.

A key with very many rows (counted before any text moves) is pre-aggregated on the map side; only one row a task
and text goes on to the owner, which never holds more than the distinct texts of one key.

Cases: null texts are empty; white space at the ends counts as one space, so it is not trimmed; very long texts make
a bucket of their own; rows without an id come after all others and report a null keep_id only among themselves;
rows repeated under one id are copies of each other, and only one of them stays; an empty table gives an empty index
and an empty report; input columns called like a result column are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.shared import materialise, store
from quillmark.llm.common import hinted, plain, text_of

RESULT = ("keep_id", "group_size", "kept", "text_sha256")
LEAST = 8 << 20  # bytes of text in a bucket, or more where this would give over MOST buckets
MOST = 100_000
SPARE = 2
HOT = 200  # rows of one key that may travel one by one
SMALL = 2_000_000  # narrow rows up to which a table is sent to every task
LAST = 9223372036854775807
_ENTRY = "bucket long, h long, chain int, low long, n long, size long, sha binary, text binary"
_FLUSH = 8 << 20


class Index(NamedTuple):
    """``directory``: path of a table (bucket, depth, size, home), one row for each bucket. ``bits`` of a key count."""

    directory: str
    bits: int = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def key_of(text: Column, bits: int) -> Column:
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 64 - bits), 64 - bits)


def leaf_of(h: Column, depth: int) -> Column:
    """The node of the tree of key bits that holds a key at a depth: its first bits behind a 1, so that the children
    of a node are twice its number and one more."""
    return (F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0)).cast("long") + F.lit(1 << depth)


def read_rows(docs: DataFrame, bits: int) -> DataFrame:
    """(low, h, t) of each row: its id, key and normalised text."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("low"), normalised(text_of()).alias("t")).select(
        "low", key_of(F.col("t"), bits).alias("h"), "t")


def split(sizes: DataFrame, old: DataFrame | None, capacity: int | None = None) -> DataFrame:
    """(bucket, depth, size) after all doublings. ``sizes`` has (h, size) of the entries of the buckets concerned,
    ``old`` the directory so far. A node becomes a bucket if it fits, or cannot be split, and its parent had to be."""
    total = sizes.agg(F.sum("size")).first()[0] or 0
    deep = 0
    if old is not None:
        had = old.agg(F.sum("size"), F.max("depth")).first()
        total, deep = max(total, had[0] or 0), had[1] or 0
    capacity = capacity or max(LEAST, total // MOST)
    deep = max(deep, math.ceil(math.log2(max(1, total / capacity))) + SPARE)
    leaves = sizes.groupBy(leaf_of(F.col("h"), deep).alias("leaf")).agg(F.sum("size").alias("size"))
    nodes = (
        leaves.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(deep))))
        .groupBy("depth", F.expr(f"shiftright(leaf, {deep} - depth)").alias("bucket")).agg(F.sum("size").alias("size")))
    above = None
    if old is not None:  # buckets are never put together again
        above = old.withColumn("up", F.explode(F.sequence(F.lit(0), F.col("depth")))).filter("up > 0").select(
            F.expr("shiftright(bucket, up)").alias("bucket")).distinct()
        nodes = nodes.join(above, "bucket", "left_anti")
    fits = (F.col("size") <= capacity) | (F.col("depth") == deep)
    parents = nodes.filter(~fits).select("bucket")
    parents = parents if above is None else parents.union(above)
    open_nodes = parents.select(F.explode(F.array(F.col("bucket") * 2, F.col("bucket") * 2 + 1)).alias("bucket")).union(
        parents.sparkSession.range(1, 2).select(F.col("id").alias("bucket")))
    return nodes.filter(fits).join(open_nodes.distinct(), "bucket", "left_semi").select("bucket", "depth", "size")


def slots(directory: DataFrame) -> tuple[DataFrame, int]:
    """The directory as (leaf, bucket) with a row for each value of the first ``depth`` bits that has a bucket."""
    depth = directory.agg(F.max("depth")).first()[0] or 0
    lower = F.expr(f"shiftleft(bucket, {depth} - depth)")
    upper = F.expr(f"shiftleft(bucket + 1, {depth} - depth) - 1")
    return directory.select(F.explode(F.sequence(lower, upper)).alias("leaf"), "bucket"), depth


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    names = ("bucket", "h", "chain", "low", "n", "size", "sha", "text")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of rows (bucket, h, chain, low, n, text) sorted by key; a chain holds the distinct texts of one key."""
    at, chain, out, held = None, {}, [], 0

    def close() -> int:
        ordered = sorted(chain.items(), key=lambda e: (e[1][2], e[0]))  # entries there already keep their places
        out.extend((*at, place, low, n, len(text), hashlib.sha256(text).digest(), text)
                   for place, (text, (low, n, _)) in enumerate(ordered))
        return sum(map(len, chain))

    for batch in batches:
        for bucket, h, place, low, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (bucket, h) != at:
                if chain:
                    held += close()
                    if held >= _FLUSH or len(out) >= 20_000:
                        yield _pack(out)
                        out, held = [], 0
                at, chain = (bucket, h), {}
            entry = chain.get(text)
            place = LAST if place is None else place
            if entry is None:
                chain[text] = [low, n, place]
            else:
                entry[:] = min(entry[0], low), entry[1] + n, min(entry[2], place)
    if chain:
        close()
        yield _pack(out)


def entries(spark: SparkSession, directory: DataFrame) -> DataFrame:
    """All entries of the buckets of a directory, from whichever files they are in."""
    found = None
    for home in [r[0] for r in directory.select("home").distinct().collect()]:  # one for each insert
        here = hinted(directory.filter(F.col("home") == home).select("bucket"), SMALL)
        part = spark.read.schema(_ENTRY).parquet(home).join(here, "bucket", "left_semi")
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], _ENTRY) if found is None else found


def insert(docs: DataFrame, index: Index | None = None, bits: int = 64, capacity: int | None = None) -> Index:
    """A new index with the rows of ``docs`` added to ``index``."""
    spark, bits = docs.sparkSession, index.bits if index else bits
    rows = read_rows(docs, bits)
    keys = materialise(rows.select(
        "h", F.unhex(F.sha2("t", 256)).alias("sha"), F.octet_length("t").cast("long").alias("size")), "copy-keys")
    sized = keys
    old = stay = moved = None
    if index:
        old = spark.read.parquet(index.directory)
        places, depth = slots(old)
        touched = keys.select(leaf_of(F.col("h"), depth).alias("leaf")).distinct().join(places, "leaf").select("bucket").distinct()
        touched = materialise(old.join(touched, "bucket", "left_semi"), "touched-buckets")
        stay, moved = old.join(touched, "bucket", "left_anti"), entries(spark, touched)
        sized = keys.union(moved.select("h", "sha", "size"))
    sizes = sized.groupBy("h", "sha").agg(F.first("size").alias("size")).select("h", "size")
    fresh = materialise(split(sizes, old, capacity), "buckets")
    places, depth = slots(fresh)

    many = materialise(keys.groupBy("h").count().filter(F.col("count") > HOT).select("h"), "hot-keys")
    single = F.col("t").cast("binary").alias("text")
    if many.isEmpty():
        packed = rows.select("h", F.lit(None).cast("int").alias("chain"), "low", F.lit(1).cast("long").alias("n"), single)
    else:  # combined by task before they travel
        hot = hinted(many, SMALL)
        one = rows.join(hot, "h", "left_anti").select("h", "low", F.lit(1).cast("long").alias("n"), "t")
        several = rows.join(hot, "h", "left_semi").groupBy("h", "t").agg(F.min("low").alias("low"), F.count("*").alias("n"))
        packed = one.unionByName(several).select("h", F.lit(None).cast("int").alias("chain"), "low", "n", single)
    if moved is not None:
        packed = packed.unionByName(moved.select("h", "chain", "low", "n", "text"))
    dealt = packed.withColumn("leaf", leaf_of(F.col("h"), depth)).join(hinted(places, SMALL), "leaf")
    done = (
        dealt.select("bucket", "h", "chain", "low", "n", "text").repartition("bucket")
        .sortWithinPartitions("bucket", "h").mapInArrow(own, _ENTRY))
    home = store(done, "copy-entries")
    now = spark.read.schema(_ENTRY).parquet(home).groupBy("bucket").agg(F.sum("size").alias("size")).join(
        fresh.select("bucket", "depth"), "bucket").select("bucket", "depth", "size", F.lit(home).alias("home"))
    return Index(store(now if stay is None else now.unionByName(stay.select(*now.columns)), "directory"), bits)


def report(docs: DataFrame, index: Index, texts: bool = False) -> DataFrame:
    """Inserted rows with keep_id, group_size, kept and text_sha256; their texts stay behind unless asked for."""
    spark = docs.sparkSession
    named = plain(docs, *RESULT)
    names = [c for c in named.columns if texts or c != "text"]
    text = normalised(text_of())
    rows = materialise(named.withColumn("_t", text).select(
        *names, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_low"), key_of(F.col("_t"), index.bits).alias("_h"),
        F.unhex(F.sha2("_t", 256)).alias("_sha"), F.monotonically_increasing_id().alias("_seq")), "copy-rows")
    groups = entries(spark, spark.read.parquet(index.directory)).filter("n > 1").select(
        F.col("h").alias("_h"), F.col("sha").alias("_sha"), F.col("low").alias("_keep"), "n").withColumnRenamed("n", "_n")
    again = rows.groupBy("_low", "_h", "_sha").agg(F.count("*").alias("_times"), F.min("_seq").alias("_first")).filter(
        "_times > 1").drop("_times")
    found = rows.join(hinted(materialise(groups, "copy-groups"), SMALL), ["_h", "_sha"], "left").join(
        hinted(materialise(again, "repeated-rows"), SMALL), ["_low", "_h", "_sha"], "left")
    keep = F.coalesce("_keep", "_low")
    return found.select(
        *names, F.when(keep < LAST, keep).alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        ((keep == F.col("_low")) & (F.coalesce("_first", "_seq") == F.col("_seq"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"))
