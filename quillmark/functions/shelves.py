"""Vectors stored on shelves, and the best of the shelves a query looks at.

Vectors belong to cells (a paper, a cluster). Neighbouring cells share a shelf until it is full, and a cell with very
many rows has several shelves, so a shelf holds a bounded number of rows. A query is sent once to each shelf with the
cells it may look into there. Only the best ``k`` of a shelf leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.running import running
from quillmark.functions.similarity import Best, tag_codes, tiles

SHELF = 1024  # rows of vectors that meet a block of queries in one task call
QUERIES = 512
SMALL_CELL = 64


def units(column: pa.Array) -> np.ndarray:
    """Vectors of one length scaled to length 1."""
    m = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def lay(sizes: DataFrame, shelf: int) -> DataFrame:
    """(cell, first, shelves) of (cell, rows): where each cell's rows lie. A carried sum, so cells may be many."""
    line = running(sizes.withColumn("_all", F.lit(0)), ["_all"], ["cell"], {"stop": ("sum", F.col("rows"))})
    start = F.col("stop") - F.col("rows")
    first = F.floor(start / shelf)
    return line.select(
        "cell", first.cast("int").alias("first"),
        (F.floor((F.col("stop") - 1) / shelf) - first + 1).cast("int").alias("shelves"))


def shelf_of(ident: str):
    """The shelf of a row whose cell has been laid."""
    return (F.col("first") + F.pmod(F.xxhash64(ident), F.col("shelves"))).cast("int")


def compare(k: int):
    """Best ``k`` of one shelf (cell, item_key, tag, unit) for a block of queries (query_key, tag, vec, probe)."""
    names = ["query_key", "item_key", "similarity"]

    def score(queries: pa.Table, items: pa.Table) -> pa.Table:
        if not (queries.num_rows and items.num_rows):
            return pa.table([queries.column("query_key").slice(0, 0), items.column("item_key").slice(0, 0),
                             pa.array([], pa.float64())], names=names)
        items = items.sort_by("item_key")  # an item's place settles ties
        q = units(queries.column("vec").combine_chunks())
        x = items.column("unit").combine_chunks().flatten().to_numpy().reshape(items.num_rows, -1)
        own = queries.column("probe").combine_chunks()
        row = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy())
        probe = own.flatten().to_numpy()
        wanted, held = tag_codes(queries.column("tag").to_numpy(zero_copy_only=False), items.column("tag").to_numpy(zero_copy_only=False))
        tagged = (wanted >= 0).any()
        # the pairs of (query, cell) over the cells of the shelf
        known, place = np.unique(items.column("cell").to_numpy(), return_inverse=True)
        at = np.searchsorted(known, probe)
        real = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == probe)
        row, at = row[real], at[real]
        best = Best(len(q), k)

        def meets(rows: np.ndarray, cols: np.ndarray, may: np.ndarray | None = None) -> None:
            for r, c in tiles(rows, cols):
                sims = q[r] @ x[c].T
                if may is not None:
                    sims[~may[r][:, place[c]]] = -np.inf
                if tagged:
                    sims[(wanted[r] >= 0)[:, None] & (wanted[r][:, None] != held[c][None, :])] = -np.inf
                best.add(r, c, sims)

        if len(x) < SMALL_CELL * len(known):  # many small cells: all at once, and what may not meet is left out
            may = np.zeros((len(q), len(known)), np.bool_)
            may[row, at] = True
            meets(np.arange(len(q)), np.arange(len(x)), may)
        else:  # each cell with the queries that look into it
            row, at = row[order := np.argsort(at, kind="stable")], at[order]
            inside = np.argsort(place, kind="stable")
            for cell in np.unique(at):
                mine = row[np.searchsorted(at, cell):np.searchsorted(at, cell, "right")]
                first, end = np.searchsorted(place[inside], [cell, cell + 1])
                meets(np.unique(mine), inside[first:end])
        rows, cols, sims = best.settle()
        return pa.table([queries.column("query_key").take(pa.array(rows)), items.column("item_key").take(pa.array(cols)),
                         pa.array(sims)], names=names)

    return score


def meet(sent: DataFrame, items: DataFrame, k: int, block: int) -> DataFrame:
    """(query_key, item_key, similarity): the best of each shelf and block of queries.

    ``sent``: shelf, query_key, tag, vec, probe. ``items``: shelf, cell, item_key, tag, unit. The vectors of a table
    bucketed by shelf stay where they are; a shelf that many queries look at meets them in several blocks.
    """
    blocks = sent.groupBy("shelf").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("query_key"), F.col("blocks")).cast("int")
    left = sent.join(blocks, "shelf").select(
        F.col("shelf").alias("q_shelf"), own.alias("q_block"), "query_key", "tag", "vec", "probe")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    right = items.join(blocks, "shelf").select(
        F.col("shelf").alias("c_shelf"), every.alias("c_block"), "cell", "item_key", "tag", "unit")
    kinds = (f"query_key {sent.schema['query_key'].dataType.simpleString()}, "
             f"item_key {items.schema['item_key'].dataType.simpleString()}, similarity double")
    return left.groupBy("q_shelf", "q_block").cogroup(right.groupBy("c_shelf", "c_block")).applyInArrow(compare(k), kinds)
