"""Ordered aggregates over keys that may hold a third of all rows.

A plain window puts a whole key into one task. Here rows are range-partitioned along (key, order), so a key with
very many rows lies in many partitions, also when they all carry one instant: the cut falls between ids. Every
partition is scanned alone. A partition begins with at most one key that an earlier one has begun, so one small row
a partition carries the totals forward. The outcome equals the plain window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.shared import materialise

PART = "_part"

_COMBINE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "min": F.least,
    "max": F.greatest,
    "last": F.coalesce,
}


def by_range(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows in partitions along (keys, order), numbered in ``_part``. Written once, so that a lost executor or a
    second reading cannot move a cut. ``order`` must tell the rows of a key apart."""
    return materialise(df.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def carried(totals: DataFrame, keys: list[str], columns: dict[str, Column], backward: bool = False) -> DataFrame:
    """What a key's earlier partitions leave to a later one: at most one row for each partition.

    ``totals`` has a row for each (partition, key); ``columns`` are aggregates over the rows of the earlier ones.
    """
    before = earlier(keys, backward)
    out = totals.select(PART, *keys, F.count("*").over(before).alias("_n"),
                        *[c.over(before).alias(n) for n, c in columns.items()])
    return out.filter("_n > 0").drop("_n")


def earlier(keys: list[str], backward: bool = False):
    along = F.col(PART).desc() if backward else F.col(PART).asc()
    return Window.partitionBy(*keys).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)


def with_carry(local: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Join the carried row of a partition to its rows of that key; null where nothing came before."""
    names = [PART, *keys]
    renamed = carry.withColumnsRenamed({n: f"_r_{n}" for n in names})
    on = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names])
    return local.join(F.broadcast(renamed), on, "left").drop(*[f"_r_{n}" for n in names])


def scan(
    placed: DataFrame,
    keys: list[str],
    order: list[str],
    aggs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    backward: bool = False,
) -> DataFrame:
    """Add running aggregates per key to rows that ``by_range`` has placed; they keep their place.

    ``aggs`` maps an output name to ``(kind, column)``; kinds are ``sum``, ``min``, ``max`` and ``last`` (latest
    non-null). ``backward`` runs from the end of the key.
    """
    src = placed.select("*", *[col.alias(f"_in_{name}") for name, (_, col) in aggs.items()])
    direction = (lambda c: F.col(c).desc()) if backward else (lambda c: F.col(c).asc())
    inner = (
        Window.partitionBy(PART, *keys)
        .orderBy(*[direction(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    step = F.struct(*[F.col(c) for c in order])
    edge = F.min_by if backward else F.max_by

    totals, before, local = [], {}, []
    for name, (kind, _) in aggs.items():
        col = F.col(f"_in_{name}")
        if kind == "last":
            totals.append(edge(col, F.when(col.isNotNull(), step)).alias(f"_t_{name}"))
            before[f"_c_{name}"] = F.last(f"_t_{name}", True)
            local.append(F.last(col, True).over(inner).alias(f"_l_{name}"))
        else:
            fn = getattr(F, kind)
            totals.append(fn(col).alias(f"_t_{name}"))
            before[f"_c_{name}"] = fn(f"_t_{name}")
            local.append(fn(col).over(inner).alias(f"_l_{name}"))

    carry = carried(src.groupBy(PART, *keys).agg(*totals), keys, before, backward)
    joined = with_carry(src.select(*placed.columns, *local), carry, keys)
    return joined.select(
        *placed.columns,
        *[
            _COMBINE[kind](F.col(f"_l_{name}"), F.col(f"_c_{name}")).alias(name)
            for name, (kind, _) in aggs.items()
        ],
    )


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    aggs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    backward: bool = False,
) -> DataFrame:
    """``scan`` of rows placed for it."""
    return scan(by_range(df, keys, order), keys, order, aggs, inclusive, backward).drop(PART)


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank_no"):
    """First ``n`` rows per key. Spark prunes each task to ``n`` rows per key
    before the shuffle, so a hot key never travels whole (n stays small)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
