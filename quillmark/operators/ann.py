"""Unscoped search over a stored index that widens until every query has its rows (section C, C9 and C10).

A coarse quantiser (k-means by cosine, fitted on a bounded sample) gives every chunk a cell. Chunks are stored by
cell, and cells lie on shelves of a bounded number of rows; a cell with very many rows has several shelves. A query
is compared with the chunks of its nearest cells only. How many cells that takes is measured when the index is built:
the fewest with which sample queries find ``target`` of their exact neighbours. A query whose filter leaves it fewer
than ``k`` rows goes on to twice as many cells, and so on; in the end it has seen all of them and its answer is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.shared import materialise, store
from quillmark.functions.shelves import SHELF, lay, meet, shelf_of, units
from quillmark.operators.retrieval import best, exact_top_k

MAX_CELLS = 4096
PER_CELL = 64  # sample rows for each cell that the quantiser is fitted on
TRIALS = 512  # sample queries the number of probes is measured with
TARGET = 0.95
SHELVES = 16  # the items lie on so many shelves at least, of SHELF rows or more, so that the work is spread
LARGE_SHELF = QUERIES = 32768  # rows of a shelf at most, and of a block of queries: both travel a few times only
ROUNDS_AT = 2  # each round looks into so many times the cells of the one before


class Index(NamedTuple):
    """``items``: (shelf, cell, chunk_id, tag, unit) rows; ``cells``: (cell, centre, first, shelves)."""

    items: str
    cells: str
    cell_count: int
    probes: int


class _Cells:
    """What a task needs to send a query on its way: bounded by MAX_CELLS centres."""

    def __init__(self, spark: SparkSession, path: str):
        rows = spark.read.parquet(path).agg(F.array_sort(F.collect_list(
            F.struct("cell", "centre", "first", "shelves")))).first()[0]
        self.names = np.array([r["cell"] for r in rows], np.int32)
        self.centres = np.array([r["centre"] for r in rows])
        self.first = np.array([r["first"] for r in rows])
        self.shelves = np.array([r["shelves"] for r in rows])

    def order(self, scaled: np.ndarray) -> np.ndarray:
        """All cells of each vector, nearest first."""
        return np.argsort(-(scaled @ self.centres.T), axis=1, kind="stable")


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1] or 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def _vectors(df: DataFrame, ident: str, vector: str, tag: Column | None) -> DataFrame:
    """(ident, tag, vec) of rows with a vector that has a direction."""
    vec = F.col(vector).cast("array<double>")
    some = F.exists(vec, lambda x: x != 0)
    tag = F.lit(None).cast("string") if tag is None else tag.cast("string")
    return df.filter(F.col(vector).isNotNull() & some).select(F.col(ident), tag.alias("tag"), vec.alias("vec"))


def build(chunks: DataFrame, k: int = 8, tag: Column | None = None, cells: int | None = None,
          target: float = TARGET, seed: int = 7) -> Index | None:
    """Fit, assign and store. ``tag`` is what a query may filter by; no chunk with a vector gives no index."""
    spark = chunks.sparkSession
    items = materialise(_vectors(chunks, "chunk_id", "embedding", tag), "ann-vectors")
    total = items.count()
    if not total:
        return None
    cells = min(cells or min(MAX_CELLS, max(2, round(math.sqrt(total)))), total)
    by_chance = F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(1 << 30))
    sample = materialise(items.filter(by_chance <= PER_CELL * cells / total * (1 << 30)), "ann-sample")
    model = KMeans(
        k=cells, seed=seed, maxIter=8, initMode="random", distanceMeasure="cosine", featuresCol="v").fit(
        sample.select(array_to_vector("vec").alias("v")))
    centres = np.array(model.clusterCenters())
    centres /= np.sqrt((centres * centres).sum(axis=1, keepdims=True))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scaled = units(batch.column(2))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array((scaled @ centres.T).argmax(axis=1).astype(np.int32)),
                     _lists(scaled)], ["chunk_id", "tag", "cell", "unit"])

    kind = items.schema["chunk_id"].dataType.simpleString()
    placed = materialise(items.mapInArrow(assign, f"chunk_id {kind}, tag string, cell int, unit array<double>"), "ann-cells")
    shelf = max(SHELF, min(LARGE_SHELF, -(-total // SHELVES)))
    laid = lay(placed.groupBy("cell").agg(F.count("*").alias("rows")), shelf)
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    cells_path = store(known.join(laid, "cell"), "ann-index-cells")
    table = spark.read.parquet(cells_path)
    items_path = store(
        placed.join(F.broadcast(table.drop("centre")), "cell").select(
            shelf_of("chunk_id").alias("shelf"), "cell", "chunk_id", "tag", "unit")
        .repartitionByRange("shelf").sortWithinPartitions("shelf", "cell"), "ann-index-items")
    index = Index(items_path, cells_path, table.count(), 1)
    trials = materialise(sample.orderBy(by_chance).limit(TRIALS), "ann-trials")
    return index._replace(probes=_measured(spark, index, trials, k, target))


def _measured(spark: SparkSession, index: Index, trials: DataFrame, k: int, target: float) -> int:
    """The fewest cells with which chunks, taken as queries, find ``target`` of their exact neighbours."""
    cells = _Cells(spark, index.cells)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order = cells.names[cells.order(units(batch.column(1)))]
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(order)], ["query_id", "order"])

    items = spark.read.parquet(index.items).select("chunk_id", "cell", F.col("unit").alias("embedding"))
    asked = trials.select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("query_vector"))
    kind = asked.schema["query_id"].dataType.simpleString()
    near = best(exact_top_k(asked, items, k + 1).drop("rank_no").filter("query_id != chunk_id"), k)
    order = asked.mapInArrow(ranked, f"query_id {kind}, order array<int>")
    depth = near.join(items.select("chunk_id", "cell"), "chunk_id").join(order, "query_id").select(
        F.array_position("order", F.col("cell")).alias("depth"))
    return max(1, math.ceil(depth.agg(F.percentile("depth", F.lit(target))).first()[0] or 1))


def _round(spark: SparkSession, index: Index, cells: _Cells, asked: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """Best ``k`` of the cells number ``low`` to ``high`` (exclusive) of each query."""
    kind = asked.schema["query_id"].dataType.simpleString()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = cells.order(units(batch.column(2)))[:, low:high]
            spread = cells.shelves[order]
            row = np.repeat(np.arange(len(order)), order.shape[1])
            flat, many = order.ravel(), spread.ravel()
            each = np.repeat(np.arange(len(flat)), many)
            step = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
            pairs = np.column_stack((row[each], cells.first[flat[each]] + step, flat[each]))
            pairs = pairs[np.lexsort((pairs[:, 2], pairs[:, 1], pairs[:, 0]))]
            starts = np.flatnonzero(np.concatenate(([True], (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1))))
            at, shelf, probe = pairs[starts, 0], pairs[starts, 1], pairs[:, 2].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(pairs)).astype(np.int32)), pa.array(cells.names[probe]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shelf.astype(np.int32)), *(c.take(pa.array(at)) for c in batch.columns), lists],
                ["shelf", "query_key", "tag", "vec", "probe"])

    sent = asked.mapInArrow(send, f"shelf int, query_key {kind}, tag string, vec array<double>, probe array<int>")
    items = spark.read.parquet(index.items).withColumnRenamed("chunk_id", "item_key")
    near = meet(sent, items, k, QUERIES).withColumnsRenamed({"query_key": "query_id", "item_key": "chunk_id"})
    return best(near, k)


def search(queries: DataFrame, index: Index | None, k: int, tag: Column | None = None) -> DataFrame:
    """(query_id, chunk_id, similarity, rank_no): up to ``k`` for each query, fewer only if no more pass its filter."""
    spark = queries.sparkSession
    asked = _vectors(queries, "query_id", "query_vector", tag)
    if index is None:
        kind = asked.schema["query_id"].dataType.simpleString()
        return spark.createDataFrame([], f"query_id {kind}, chunk_id long, similarity double, rank_no int")
    cells = _Cells(spark, index.cells)
    low, high, done = 0, index.probes, None
    while True:
        found = _round(spark, index, cells, asked, k, low, high)
        if done is not None:  # what earlier rounds found stays in the running
            mine = done.join(asked.select("query_id"), "query_id", "left_semi")
            found = best(found.drop("rank_no").unionByName(mine.drop("rank_no")), k)
            found = found.unionByName(done.join(asked.select("query_id"), "query_id", "left_anti"))
        done = materialise(found, "ann-near")
        if high >= index.cell_count:
            return done
        full = done.filter(F.col("rank_no") == k).select("query_id")
        short = asked.join(full, "query_id", "left_anti")
        if short.isEmpty():
            return done
        asked = materialise(short, "ann-short")
        low, high = high, min(index.cell_count, high * ROUNDS_AT)
