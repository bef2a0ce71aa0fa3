"""Exact top-k by cosine similarity inside groups, in bounded blocks.

Rows of a group meet as blocks: a block of query vectors and a block of item
vectors form one matrix product inside one task, and only the best ``k`` items
per query leave it. A hot group simply has more blocks; small groups share a
task call and are scored one by one inside it. No pair is emitted and no group
is gathered whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM_BLOCK = 4096
QUERY_BLOCK = 1024
LARGE_BLOCK = 65536  # rows of a block where all of both sides meet: so few blocks that rows travel a few times only
SPREAD = 8  # and so many blocks a side at least, of ITEM_BLOCK or QUERY_BLOCK rows or more, so that the work is spread
TILE_ITEMS, TILE_PAIRS = 4096, 1 << 22  # of a block pair, so much is compared at once
CELL_ROWS = 2048
ORDER_DIGITS = 9


def order_key(similarity: Column) -> Column:
    """Similarities are compared at nine digits so equal vectors tie exactly."""
    return F.round(similarity, ORDER_DIGITS)


def _unit(vectors: np.ndarray) -> np.ndarray:
    m = np.stack(vectors).astype(np.float64)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


class Best:
    """The ``k`` best items of each of ``n`` queries, by similarity at nine digits, then by the item's place.

    Similarities come tile by tile; of a tile only what reaches a query's k-th best so far is looked at again.
    """

    def __init__(self, n: int, k: int):
        self.n, self.k, self.edge, self.kept = n, k, np.full(n, -np.inf), 0
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [
            (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def add(self, rows: np.ndarray, cols: np.ndarray, sims: np.ndarray) -> None:
        """``sims`` of the queries ``rows`` and the items ``cols``; -inf for pairs that may not meet."""
        fresh = np.flatnonzero(np.isneginf(self.edge[rows]))
        if len(fresh) and len(cols) > self.k:
            self.edge[rows[fresh]] = np.partition(sims[fresh], len(cols) - self.k, axis=1)[:, len(cols) - self.k]
        at, col = np.nonzero(sims >= np.maximum(self.edge[rows] - 1e-8, np.finfo(float).min)[:, None])
        self.found.append((rows[at], cols[col], sims[at, col]))
        if sum(len(f[0]) for f in self.found) > self.kept + self.n * self.k:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, col, sim = (np.concatenate(x) for x in zip(*self.found))
        key = np.round(sim, ORDER_DIGITS)
        order = np.lexsort((col, -key, row))
        row, col, sim, key = row[order], col[order], sim[order], key[order]
        first = np.searchsorted(row, row)
        place = np.arange(len(row)) - first
        last = place == self.k - 1
        self.edge[row[last]] = np.maximum(self.edge[row[last]], key[last])
        keep = place < self.k
        self.found, self.kept = [(row[keep], col[keep], sim[keep])], int(keep.sum())
        return self.found[0]


def tiles(rows: np.ndarray, cols: np.ndarray):
    """Parts of (rows, cols) of a bounded number of pairs."""
    for c in range(0, len(cols), TILE_ITEMS):
        some = cols[c:c + TILE_ITEMS]
        step = max(1, TILE_PAIRS // len(some))
        for r in range(0, len(rows), step):
            yield rows[r:r + step], some


def tag_codes(wanted, held) -> tuple[np.ndarray, np.ndarray]:
    """Tags of queries and items as numbers; a query without one has -1."""
    codes, _ = pd.factorize(np.concatenate((np.asarray(wanted, object), np.asarray(held, object))))
    return codes[:len(wanted)], codes[len(wanted):]


def _score_cell(k: int, grid: list[str]):
    """Score one cell: a block pair of a large group, or many small groups together."""

    def best_of(mine: np.ndarray, theirs: np.ndarray, wanted: np.ndarray, held: np.ndarray):
        """Rows, columns and similarities of the best pairs of one group."""
        mine, theirs = _unit(mine), _unit(theirs)
        real_q, real_c = np.isfinite(mine).all(axis=1), np.isfinite(theirs).all(axis=1)
        best, tagged = Best(len(mine), k), (wanted >= 0).any()
        for rows, cols in tiles(np.flatnonzero(real_q), np.flatnonzero(real_c)):
            sims = mine[rows] @ theirs[cols].T
            if tagged:
                sims[(wanted[rows] >= 0)[:, None] & (wanted[rows][:, None] != held[cols][None, :])] = -np.inf
            best.add(rows, cols, sims)
        return best.settle()

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        # a cell may hold very many small groups: they are cut out of arrays, and their pairs become one frame
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if not q.empty and not c.empty:
            # item order breaks ties, and stays put through the grouping
            c = c.sort_values("item_key", kind="stable")
            mine, theirs = q["vec"].to_numpy(), c["vec"].to_numpy()
            wanted, held = tag_codes(q["tag"].to_numpy(), c["tag"].to_numpy())
            there = c.groupby([f"c{g}" for g in grid], sort=False).indices
            for group, rows in q.groupby([f"q{g}" for g in grid], sort=False).indices.items():
                cols = there.get(group)
                if cols is not None:
                    row, col, sims = best_of(mine[rows], theirs[cols], wanted[rows], held[cols])
                    found.append((rows[row], cols[col], sims))
        rows, cols, sims = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"query_key": q["query_key"].to_numpy()[rows], "item_key": c["item_key"].to_numpy()[cols],
                             "similarity": sims})

    return score


def blocked_top_k(
    queries: DataFrame,
    items: DataFrame,
    keys: list[str],
    query_id: str,
    item_id: str,
    query_vector: str,
    item_vector: str,
    k: int,
    query_tag: Column | None = None,
    item_tag: Column | None = None,
    item_block: int = ITEM_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Up to ``k`` best items per (query, group block): a superset of the top k.

    With no keys the whole of both sides is one group (and ``sizes`` one row); a row is then sent to ``SPREAD``
    blocks or, of more than ``SPREAD * LARGE_BLOCK`` rows, to one for each ``LARGE_BLOCK``.
    A non-null query tag restricts a query to items with the same tag. The
    caller ranks the union of the blocks.
    """
    no_tag = F.lit(None).cast("string")
    one_group = not keys
    if one_group:
        keys = ["_all"]
        queries, items = queries.withColumn("_all", F.lit(0)), items.withColumn("_all", F.lit(0))
    q = queries.filter(F.col(query_vector).isNotNull()).select(
        *keys,
        F.col(query_id).alias("query_key"),
        F.col(query_vector).alias("vec"),
        (no_tag if query_tag is None else query_tag).alias("tag"),
    )
    c = items.filter(F.col(item_vector).isNotNull()).select(
        *keys,
        F.col(item_id).alias("item_key"),
        F.col(item_vector).alias("vec"),
        (no_tag if item_tag is None else item_tag).alias("tag"),
    )
    def blocks(rows: str, size: int) -> Column:
        few = F.ceil(F.col(rows) / size)
        if one_group:
            few = F.least(few, F.greatest(F.lit(SPREAD), F.ceil(F.col(rows) / LARGE_BLOCK)))
        return few.cast("int")

    # one small row per group: how many blocks each side needs
    n_q = q.groupBy(*keys).agg(F.count("*").alias("_nq"))
    n_c = c.groupBy(*keys).agg(F.count("*").alias("_nc"))
    sizes = (
        n_q.join(n_c, keys)
        .select(
            *keys,
            blocks("_nq", query_block).alias("_nqb"),
            blocks("_nc", item_block).alias("_ncb"),
            (F.col("_nq") + F.col("_nc")).alias("_rows"),
        )
    )
    # small groups share cells, so a task call is never about a handful of rows
    total = sizes.agg(F.greatest(
        F.lit(8), F.ceil(F.sum("_rows") / CELL_ROWS)).cast("bigint").alias("n"))
    sizes = sizes.withColumn("_cells", total.scalar()).drop("_rows")

    def place(df: DataFrame, side: str, ident: str, own: str, own_n: str, other: str,
              other_n: str) -> DataFrame:
        placed = (
            # one group means one row of sizes, so it can always be broadcast; vectors never are, however
            # small their files: alike ones are a hundredth of their size there
            (df.join(F.broadcast(sizes), keys) if one_group else df.hint("shuffle_merge").join(sizes, keys))
            .withColumn(own, F.pmod(F.xxhash64(ident), F.col(own_n)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
        )
        alone = F.col("_nqb") * F.col("_ncb") > 1
        cell = F.when(alone, F.xxhash64(*keys, "_qb", "_cb")).otherwise(
            F.pmod(F.xxhash64(*keys), F.col("_cells")))
        # both sides may come from one table: give each its own key columns
        own_keys = [F.col(k).alias(f"{side}{k}") for k in [*keys, "_qb", "_cb"]]
        return placed.select(cell.alias(f"{side}_cell"), *own_keys, ident, "vec", "tag")

    q = place(q, "q", "query_key", "_qb", "_nqb", "_cb", "_ncb")
    c = place(c, "c", "item_key", "_cb", "_ncb", "_qb", "_nqb")
    schema = T.StructType(
        [
            T.StructField("query_key", q.schema["query_key"].dataType),
            T.StructField("item_key", c.schema["item_key"].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    return (
        q.groupBy("q_cell").cogroup(c.groupBy("c_cell"))
        .applyInPandas(_score_cell(k, [*keys, "_qb", "_cb"]), schema)
        .withColumnRenamed("query_key", query_id)
        .withColumnRenamed("item_key", item_id)
    )
