"""Callback scenario with each suppression, checks, feedback folding."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillmark import vocab as V
from quillmark.operators import callbacks as H
from quillmark.operators import checks as I
from quillmark.operators import feedback as K

NOW = datetime(2024, 2, 1)
CONCEPT = ("user_id INT, concept_id INT, canonical_name STRING, understanding_score DOUBLE, "
           "score_confidence DOUBLE, effective_style STRING, last_reinforced_at TIMESTAMP_NTZ, "
           "user_override_score DOUBLE, merged_into_id INT, source_paper_ids ARRAY<INT>")
TURN = ("turn_id INT, user_id INT, paper_id INT, agent_action STRING, callback_concept_id INT, "
        "created_at TIMESTAMP_NTZ")


def decide(spark, *, prefs="{}", hits=True, weak=0.31, papers=(1,), grants=((1, 1),), fired=(), n=6):
    concepts = spark.createDataFrame([
        (1, 10, "weak one", weak, 0.72, "numerical", NOW, None, None, list(papers)),
        (1, 20, "asked", 0.8, 0.7, None, NOW, None, None, [2]),
        (7, 70, "decoy", 0.1, 0.9, None, NOW, None, None, [1])], CONCEPT)
    edges = spark.createDataFrame(
        [(1, 10, 20, "component_of", 0.86), (7, 70, 20, "component_of", 0.99)],
        "user_id INT, source_concept_id INT, target_concept_id INT, relationship_type STRING, "
        "confidence DOUBLE")
    turns = spark.createDataFrame([
        (i, 1, 2, "callback" if i in fired else "answer", 10 if i in fired else None,
         NOW + timedelta(minutes=i)) for i in range(n)], TURN)
    users = spark.createDataFrame([(1, prefs)], "user_id INT, preferences STRING")
    rows = [(n - 1, 1, 20, 1)] if hits else [(99, 1, 20, 1)]
    hit = spark.createDataFrame(rows, "turn_id INT, user_id INT, concept_id INT, rank_no INT")
    scoped = spark.createDataFrame(list(grants) or [(5, 5)], "user_id INT, paper_id INT")
    history = concepts.select(
        "user_id", "concept_id", F.lit(1).alias("observation_id"), F.lit(NOW).cast("timestamp_ntz").alias("valid_from"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.col("understanding_score").alias("raw_score"),
        "score_confidence", "effective_style", "last_reinforced_at")
    out = H.decide(turns, users, hit, edges, concepts, scoped, history)
    return out.filter(f"turn_id = {n - 1}").first()


def test_callback_fires(spark):
    r = decide(spark)
    assert r.suppressed_reason is None
    assert (r.concept_id, r.prior_paper_id, r.relationship_type, r.effective_style) == (
        10, 1, "component_of", "numerical")


@pytest.mark.parametrize("reason,case", [
    ("personalization_off", {"prefs": '{"personalization_enabled": false}'}),
    ("proactivity_off", {"prefs": '{"proactivity": "off"}'}),
    ("no_memory", {"hits": False}),
    ("no_weak_candidate", {"weak": 0.9}),
    ("rate_limited", {"fired": (2,)}),
    ("grant_revoked", {"grants": ((2, 1),)}),
    ("grant_revoked", {"papers": (2,)}),
    (None, {"fired": (0,)}),
    (None, {"fired": (2,), "prefs": '{"proactivity": "high"}'}),
    ("rate_limited", {"fired": (0,), "prefs": '{"proactivity": "low"}'}),
])
def test_suppressions(spark, reason, case):
    if case.get("fired") == (0,) and reason is None:
        case = {**case, "n": 7}
    r = decide(spark, **case)
    assert r.suppressed_reason == reason
    assert (r.concept_id is None) == (reason is not None)


def test_lexical_grades(spark):
    rows = spark.createDataFrame([
        (1, "All about Entropy and loss", ["entropy", "loss"]), (2, "entropy", ["entropy", "loss"]),
        (3, "no", ["entropy", "loss"]), (4, "anything", None)],
        "id INT, answer_text STRING, must_mention ARRAY<STRING>")
    got = {r.id: (r.lexical_grade, r.missing_elements) for r in I.grade_lexically(rows).collect()}
    assert got == {1: ("correct", []), 2: ("partial", ["loss"]),
                   3: ("incorrect", ["entropy", "loss"]), 4: ("partial", [])}


def test_grade_or_error_never_both(views):
    out = I.validate_grades(views.attempts)
    assert out.filter("(grade IS NULL) <> (grading_error IS NOT NULL)").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_depth_fold_saturates_at_each_step(spark, seed):
    rng = random.Random(seed)
    kinds = ("too_basic", "too_basic", "too_advanced", "helpful")
    rows, want = [], {}
    start = {u: d for u, d in zip(range(4), ("expert", "introductory", "bogus", "normal"))}
    for u, level in start.items():
        at = V.DEPTH_LEVELS.index(level) if level in V.DEPTH_LEVELS else 1
        moved = False
        for i in range(rng.choice([0, 3, 80])):
            kind = rng.choice(kinds)
            rows.append((u, u * 1000 + i, kind, NOW + timedelta(minutes=41 * i)))
            step = {"too_basic": 1, "too_advanced": -1}.get(kind, 0)
            moved = moved or step != 0
            at = max(0, min(3, at + step))
        want[u] = V.DEPTH_LEVELS[at] if moved else level
    feedback = spark.createDataFrame(
        rows or [(99, 0, "helpful", NOW)],
        "user_id INT, feedback_id INT, feedback_type STRING, created_at TIMESTAMP_NTZ")
    users = spark.createDataFrame(list(start.items()), "user_id INT, depth STRING")
    assert {r.user_id: r.depth for r in K.fold_depth(feedback, users).collect()} == want


def test_feedback_stamps_the_next_answered_turn(spark):
    turns = spark.createDataFrame([
        (1, 1, 2, "answer", None, NOW), (2, 1, 2, "grade_quiz", None, NOW + timedelta(minutes=2)),
        (3, 1, 2, "answer", None, NOW + timedelta(hours=30)),
        (4, 2, 2, "answer", None, NOW + timedelta(minutes=2))], TURN)
    rows = spark.createDataFrame([
        (1, 50, "too_basic", NOW + timedelta(minutes=1)), (1, 51, "helpful", NOW),
        (1, 52, "too_basic", NOW + timedelta(hours=40))],
        "user_id INT, feedback_id INT, feedback_type STRING, created_at TIMESTAMP_NTZ")
    got = {r.feedback_id: r.applied_to_turn_id for r in K.stamp(rows, turns).collect()}
    assert got == {50: 3, 52: None}
