"""Connected components of a link table by large-star and small-star steps, all in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.shared import materialise


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of a batch by one link from each node to its smallest, by union-find."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(x, root(x)) for x in list(parent)]
        pairs = [p for p in pairs if p[0] != p[1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges u > v. Minima are combined before the shuffle, and a node
    with very many neighbours joins one row of minima, so adaptive execution can split it."""
    both = edges.union(edges.select("v", "u"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link (a, b); the component is its smallest node."""
    start = links.filter("a != b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    edges, before = materialise(start.mapInArrow(_forest, "u long, v long").distinct(), "links"), None
    while True:
        edges = materialise(_stars(edges), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.sum("v")).first()
        if now == before:  # every node points at its smallest
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select("v", "v").distinct())
        before = now
