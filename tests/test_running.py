import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.functions.running import by_range, newest, running


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(0 if i % 3 == 0 else i % 5, i // 2, i, rng.choice([None, 1, 2, -3])) for i in range(600)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k INT, t INT, id INT, x INT")


@pytest.fixture
def cut_small(spark):
    """Partitions so small that every key is cut."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("backward", [True, False])
def test_matches_plain_window(rows, cut_small, inclusive, backward):
    aggs = {"s": ("sum", F.col("x")), "lo": ("min", F.col("x")), "hi": ("max", F.col("x")),
            "seen": ("last", F.col("x"))}
    got = running(rows, ["k"], ["t", "id"], aggs, inclusive, backward)
    order = [F.desc("t"), F.desc("id")] if backward else [F.asc("t"), F.asc("id")]
    w = Window.partitionBy("k").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    want = rows.select("*", F.coalesce(F.sum("x").over(w), F.lit(0)).alias("s"),
                       F.min("x").over(w).alias("lo"), F.max("x").over(w).alias("hi"),
                       F.last("x", True).over(w).alias("seen"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == sorted(
        map(tuple, want.collect()), key=lambda r: r[2])


def test_newest_is_pruned_before_the_shuffle(rows):
    plan = newest(rows, ["k"], [F.desc("t")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_one_key_at_one_instant_lies_in_several_tasks(spark, cut_small):
    rows = spark.range(200_000).selectExpr("1 AS k", "timestamp'2025-01-01' AS t", "id", "id % 7 AS x")
    placed = by_range(rows, ["k"], ["t", "id"])
    most, parts = placed.groupBy("_part").count().agg(F.max("count"), F.count("*")).first()
    assert parts > 5 and most < 60_000
    got = running(rows, ["k"], ["t", "id"], {"s": ("sum", F.col("x")), "seen": ("last", F.col("x"))}, inclusive=False)
    week = F.expr("21 * (id DIV 7) + (id % 7) * (id % 7 - 1) DIV 2")
    bad = got.filter((F.col("s") != week) | ~F.col("seen").eqNullSafe(F.expr("CASE WHEN id > 0 THEN (id - 1) % 7 END")))
    assert got.count() == 200_000 and bad.count() == 0


def test_null_keys_and_an_empty_table(spark, cut_small):
    rows = spark.createDataFrame([(None, i, 1) for i in range(50)] + [(2, i, 1) for i in range(50)], "k INT, id INT, x INT")
    got = running(rows, ["k"], ["id"], {"n": ("sum", F.col("x"))})
    assert got.filter("n != id + 1").count() == 0 and got.count() == 100
    assert running(rows.limit(0), ["k"], ["id"], {"n": ("sum", F.col("x"))}).count() == 0
