from collections import Counter

import corpus_pipeline
import pytest

from quillmark.llm import classifier, decontaminate, mixing, near_copies
from quillmark.llm.common import text_of, word_count

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage keeps of the smallest documents, with a null text, a null id and an extra column added."""
    from quillmark.functions.shared import materialise

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("*", "1 as shard")
    odd = spark.createDataFrame([(100001, None, None, None, None, 2), (None, "", "en", "src1", 0, 3)], docs.schema)
    kept = [docs.union(odd)]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialise(stage(spark, kept[-1], SMALL), name))
    return kept


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_follow_their_operators(spark, stages):
    docs, good, apart, clean, mixed, sharded = stages
    assert all(s.columns == docs.columns for s in stages[:-1])
    model = classifier.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert ids(good) == ids(classifier.score(docs, model).filter("score >= 0.5"))
    assert ids(apart) == ids(near_copies.groups(good, 5, 80).filter("kept"))
    held = set(ids(decontaminate.leaks(apart, spark.read.parquet(f"{SMALL}/benchmark.parquet"))))
    assert held and ids(clean) == Counter({i: n for i, n in ids(apart).items() if i not in held})
    sized = clean.select("doc_id", "source", word_count(text_of()).alias("size"))
    plan = mixing.rates(sized, mixing.targets(sized))
    assert ids(mixed) == ids(mixing.mix(clean, plan)) and ids(sharded) == ids(mixed)


def test_good_clean_documents_stay(spark, stages):
    docs, good = stages[:2]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    before, after = ids(docs), ids(good)
    marked = [i for i in before if labels.get(i) == 1]
    assert sum(i in after for i in marked) >= 0.98 * len(marked)
    assert not [i for i in after if labels.get(i) == 0]


def test_shards_are_gapless(stages):
    slots = {}
    for r in stages[-1].collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_columns_named_like_those_of_operators_are_carried(spark):
    names = ("target", "copies", "copy", "source_size", "score", "_key", "_id", "_w", "n", "a b", "anomaly")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = docs.selectExpr("*", *[f"concat('{i}-', doc_id) AS `{c}`" for i, c in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, SMALL)
        assert odd.columns == [*docs.columns, *names], name
    rows = odd.collect()
    assert rows and all(r[c] == f"{i}-{r['doc_id']}" for r in rows for i, c in enumerate(names))
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SMALL).count() == len(rows)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0
