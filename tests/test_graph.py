"""Concept resolution: thresholds, reruns, merges; graph reads."""

import pytest
from pyspark.sql import functions as F

from quillmark.functions import expr as X
from quillmark.operators import canonical as G
from quillmark.operators import memory as M

CONCEPT = ("user_id BIGINT, concept_id BIGINT, canonical_name STRING, normalized_name STRING, "
           "aliases ARRAY<STRING>, embedding ARRAY<DOUBLE>, source_paper_ids ARRAY<BIGINT>, "
           "merged_into_id BIGINT")
CAND = ("user_id BIGINT, paper_id BIGINT, arrival INT, candidate_no BIGINT, name STRING, "
        "aliases ARRAY<STRING>, prerequisites ARRAY<STRING>, vector ARRAY<DOUBLE>")
EDGE = ("user_id BIGINT, source_concept_id BIGINT, target_concept_id BIGINT, "
        "relationship_type STRING, confidence DOUBLE")
DECOY = (9, 90, "Entropy", "entropy", ["ent"], [1.0, 0.0], [1], None)


def verdicts(spark, rows):
    schema = ("candidate_no BIGINT, verdict STRING, verdict_confidence DOUBLE, "
              "relationship_type STRING")
    table = spark.createDataFrame(rows or [(-1, "same", 1.0, None)], schema)
    return lambda _: table


def run(spark, cands, stored=(), judged=()):
    concepts = spark.createDataFrame([DECOY, *stored], CONCEPT)
    edges = spark.createDataFrame([], EDGE)
    return G.canonicalize(spark.createDataFrame(cands, CAND), concepts, edges,
                          verdicts(spark, list(judged)))


def mine(df):
    return df.filter("user_id = 1")


def test_name_key_ignores_case_and_punctuation(spark):
    r = spark.range(1).select(X.name_key(F.lit("  K-L  Divergence!")).alias("k")).first().k
    assert r == "k l divergence"


@pytest.mark.parametrize("verdict,confidence,kind,concepts,edges", [
    ("same", 0.9, None, 1, []), ("same", 0.8, None, 2, []),
    ("related", 0.75, "component_of", 2, ["component_of"]),
    ("related", 0.75, "odd", 2, ["co_occurs_with"]), ("related", 0.6, "component_of", 2, []),
    ("distinct", 1.0, None, 2, [])])
def test_verdict_thresholds(spark, verdict, confidence, kind, concepts, edges):
    stored = [(1, 5, "cross entropy", "cross entropy", [], [1.0, 0.0], [1], None)]
    cands = [(1, 2, 0, 1, "entropy loss", ["el"], [], [0.99, 0.05])]
    got, links = run(spark, cands, stored, [(1, verdict, confidence, kind)])
    rows = mine(got).collect()
    assert len(rows) == concepts
    assert [r.relationship_type for r in mine(links).collect()] == edges
    if concepts == 1:
        assert rows[0].source_paper_ids == [1, 2] and rows[0].aliases == ["el"]


def test_later_paper_sees_earlier_commit_and_rerun_changes_nothing(spark):
    cands = [(1, 2, 0, 1, "Dropout", ["drop out"], [], [1.0, 0.0]),
             (1, 2, 0, 2, "Noise", [], ["Dropout"], [0.0, 1.0]),
             (1, 3, 1, 3, "dropout!", [], [], [1.0, 0.0])]
    concepts, edges = run(spark, cands)
    rows = {r.normalized_name: r for r in mine(concepts).collect()}
    assert set(rows) == {"dropout", "noise"} and rows["dropout"].source_paper_ids == [2, 3]
    link = mine(edges).first()
    assert (link.source_concept_id, link.target_concept_id, link.relationship_type) == (
        rows["dropout"].concept_id, rows["noise"].concept_id, "prerequisite_of")
    again, edges2 = G.canonicalize(spark.createDataFrame(cands, CAND), concepts, edges,
                                   verdicts(spark, []))
    assert {tuple(map(str, r)) for r in again.collect()} == {
        tuple(map(str, r)) for r in concepts.collect()}
    assert edges2.count() == edges.count()


def test_candidates_of_one_paper_do_not_match_each_other(spark):
    cands = [(1, 2, 0, 1, "alpha beta", [], [], [1.0, 0.0]),
             (1, 2, 0, 2, "alpha gamma", [], [], [1.0, 0.0])]
    assert mine(run(spark, cands)[0]).count() == 2


def test_chains_end_at_the_survivor(spark):
    rows = [(i, i + 1 if i < 11 else None) for i in range(12)]
    c = spark.createDataFrame(rows, "concept_id INT, merged_into_id INT")
    assert {r.survivor_id for r in G.survivors(c).collect()} == {11}


def test_long_chains_circles_and_missing_ends(spark):
    rows = [(i, i + 1 if i < 99 else None) for i in range(100)]  # far longer than sixteen hops
    rows += [(200, 201), (201, 202), (202, 200), (190, 201), (189, 190), (300, 300), (400, 999)]
    c = spark.createDataFrame(rows, "concept_id INT, merged_into_id INT")
    got = {r.concept_id: r.survivor_id for r in G.survivors(c).collect()}
    assert got == {**{i: 99 for i in range(100)}, 200: 200, 201: 200, 202: 200, 190: 200, 189: 200,
                   300: 300, 400: 999}
    assert G.survivors(c.limit(0)).count() == 0


def test_second_hop_is_keyed_by_the_near_node(spark):
    concepts = spark.createDataFrame(
        [(1, i, f"c{i}", None if i != 4 else 1) for i in range(1, 6)],
        "user_id INT, concept_id INT, canonical_name STRING, merged_into_id INT")
    edges = spark.createDataFrame(
        [(1, 1, 2, "component_of", 0.9), (1, 3, 2, "component_of", 0.8),
         (1, 1, 4, "component_of", 0.7), (2, 1, 5, "component_of", 0.9)], EDGE)
    roots = spark.createDataFrame([(1, 1, 1)], "call_id INT, user_id INT, concept_id INT")
    got = {(r.near, r.far, r.hop) for r in M.neighbours(roots, edges, concepts, 2).collect()}
    assert got == {(1, 2, 1), (2, 1, 2), (2, 3, 2)}
