"""The extendible-hash index against grouping by text."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmark.llm import exact_copies

NAMES = ("doc_id", *exact_copies.RESULT)


def brute(rows):
    groups, done = {}, set()
    keyed = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, *_ in rows]
    for i, t in keyed:
        groups.setdefault(t, []).append(float("inf") if i is None else i)
    out = Counter()
    for i, t in keyed:
        low = min(groups[t])
        first = (float("inf") if i is None else i) == low and t not in done
        if first:
            done.add(t)
        out[i, None if low == float("inf") else low, len(groups[t]), first, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


def result(df):
    return Counter(tuple(r[n] for n in NAMES) for r in df.collect())


@pytest.mark.parametrize("bits,capacity,hot", [(64, None, 200), (64, 3000, 1), (3, 3000, 0), (0, 100, 2)])
def test_matches_grouping(docs, corpus, monkeypatch, bits, capacity, hot):
    monkeypatch.setattr(exact_copies, "HOT", hot)
    index = exact_copies.insert(docs, bits=max(bits, 1), capacity=capacity)
    assert result(exact_copies.report(docs, index)) == brute(corpus)


def test_inserts_add_up(spark, docs, corpus):
    """Three inserts give the groups of one; buckets without new keys stay in their files."""
    index, seen = None, None
    for k in range(3):
        part = docs.filter(F.coalesce(F.col("doc_id"), F.lit(0)) % 3 == k)
        index = exact_copies.insert(part, index, capacity=3000)
        seen = part if seen is None else seen.union(part)
    assert result(exact_copies.report(docs, index)) == brute(corpus)
    one = docs.limit(1).select(F.lit(1000).alias("doc_id"), F.lit("quite new").alias("text"))
    grown = exact_copies.insert(one, index, capacity=3000)
    homes = spark.read.parquet(grown.directory).groupBy("home").count().orderBy("count").collect()
    assert [r["count"] for r in homes][0] <= 3 and len(homes) > 1
    assert result(exact_copies.report(docs, grown)) == brute(corpus)
    everything = exact_copies.entries(spark, spark.read.parquet(grown.directory))
    assert everything.agg(F.sum("n")).first()[0] == len(corpus) + 1


def test_buckets_are_key_ranges_that_fit(spark, docs):
    index = exact_copies.insert(docs, capacity=20_000)
    directory = spark.read.parquet(index.directory)
    found = exact_copies.entries(spark, directory).join(directory.select("bucket", "depth"), "bucket")
    assert found.filter(F.expr("bucket != shiftleft(1L, depth) + CASE WHEN depth = 0 THEN 0 "
                               "ELSE shiftrightunsigned(h, 64 - depth) END")).count() == 0
    deepest = directory.agg(F.max("depth")).first()[0]
    assert directory.filter((F.col("size") > 20_000) & (F.col("depth") < deepest)).count() == 0
    assert directory.count() > 4


def test_collisions_are_chained(spark, docs):
    """With one bit of a key nearly all texts collide; the chain tells them apart."""
    index = exact_copies.insert(docs, bits=1)
    found = exact_copies.entries(spark, spark.read.parquet(index.directory))
    chains = found.groupBy("h").agg(F.count("*").alias("n"), F.max("chain").alias("last"), F.count_distinct("text").alias("t"))
    assert chains.filter("n != last + 1 OR n != t").count() == 0 and chains.count() <= 2


def test_empty_table_and_clashing_names(docs, empty):
    out = exact_copies.report(empty, exact_copies.insert(empty))
    assert out.count() == 0
    again = exact_copies.insert(docs, exact_copies.insert(empty))
    whole = exact_copies.report(docs, again, texts=True)
    assert whole.columns == [c for c in docs.columns if c != "kept"] + list(exact_copies.RESULT)
