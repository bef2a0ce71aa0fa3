import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillmark import vocab as V
from quillmark.functions import expr as X
from quillmark.operators import learner as L

T0 = datetime(2024, 1, 1)
DDL = ("observation_id BIGINT, user_id BIGINT, concept_id BIGINT, signal_type STRING, "
       "style_in_play STRING, observed_at TIMESTAMP_NTZ")
DECOY = [(900, 9, 9, "quiz_correct", None, T0)]


def evidence(spark, rows):
    return L.evidence(spark.createDataFrame(rows + DECOY, DDL))


def state(spark, rows):
    return L.states(evidence(spark, rows)).filter("user_id = 1").first()


def test_struggle_then_assisted_understanding(spark):
    rows = [(1, 1, 1, "explicit_confusion", "formal", T0),
            (2, 1, 1, "explicit_understanding", "numerical", T0 + timedelta(minutes=2))]
    s = state(spark, rows)
    assert s.raw_score == pytest.approx(0.35) and s.score_confidence == pytest.approx(0.70, abs=0.005)
    assert s.effective_style == "numerical" and s.evidence_count == 2
    later = L.score_at(L.states(evidence(spark, rows)),
                       F.lit(T0 + timedelta(minutes=2, days=5.3)).cast("timestamp_ntz"))
    r = later.filter("user_id = 1").first()
    assert r.score == pytest.approx(0.31, abs=0.005) and r.is_weak


def test_reminders_move_the_clock_only(spark):
    s = state(spark, [(1, 1, 1, "reinforcement", None, T0)])
    assert s.raw_score is None and s.score_confidence == 0 and s.last_reinforced_at == T0


def test_decay_floor_and_future(spark):
    def at(days):
        return spark.range(1).select(X.decay(
            F.lit(T0).cast("timestamp_ntz"),
            F.lit(T0 + timedelta(days=days)).cast("timestamp_ntz")).alias("d")).first().d

    assert at(30) == pytest.approx(0.5) and at(3000) == 0.25 and at(-5) == 1.0


def test_row_order_does_not_matter(spark):
    rng = random.Random(5)
    rows = [(i, 1, 1, rng.choice(V.SIGNAL_TYPE), rng.choice(V.EXPLANATION_STYLE),
             T0 + timedelta(minutes=i)) for i in range(60)]
    a = state(spark, rows)
    rng.shuffle(rows)
    b = state(spark, rows)
    assert a.effective_style == b.effective_style and a.raw_score == pytest.approx(b.raw_score)


def stack_pairs(rows):
    open_, out = {}, set()
    for obs, user, concept, kind, _, _ in sorted(rows, key=lambda r: (r[5], r[0])):
        held = open_.setdefault((user, concept), [])
        if kind in V.STRUGGLES:
            held.append(obs)
        elif kind in V.RESOLVING and held:
            out.add((obs, held.pop()))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_pairing_equals_a_stack(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randint(1, 2), rng.randint(1, 2), rng.choice(V.SIGNAL_TYPE), None,
             T0 + timedelta(minutes=rng.randint(0, 400))) for i in range(300)]
    got = {tuple(r) for r in L.pair_struggles(spark.createDataFrame(rows, DDL)).collect()}
    assert got == stack_pairs(rows)


def test_weights_of_every_pair(spark):
    pairs = [(t, s) for t in V.SIGNAL_TYPE for s in (*V.SIGNAL_SOURCE, "odd")]
    df = spark.createDataFrame(pairs, "t STRING, s STRING")
    for r in df.select("t", "s", L.weight_of(F.col("t"), F.col("s")).alias("w")).collect():
        special = r.t == "applied_correctly" and r.s == "implicit"
        assert r.w == (0.75 if special else V.WEIGHT_OF_SOURCE.get(r.s, 0.4))


def test_what_if_equals_landing(spark):
    rows = [(1, 1, 1, "explicit_confusion", None, T0), (2, 1, 1, "quiz_correct", None,
                                                        T0 + timedelta(hours=1))]
    all_rows = evidence(spark, rows).filter("user_id = 1")
    before = all_rows.filter("observation_id = 1")
    pending = all_rows.filter("observation_id = 2")
    got = L.project(before, pending).first()
    assert got.raw_score == pytest.approx(L.states(all_rows).first().raw_score)


def test_refresh_keeps_overrides_and_empties_unsupported(spark):
    c = spark.createDataFrame([(1, 1, 0.9, 0.1), (1, 2, None, 0.4)],
                              "user_id BIGINT, concept_id BIGINT, user_override_score DOUBLE, "
                              "understanding_score DOUBLE")
    out = {r.concept_id: r for r in L.refresh(c, L.states(evidence(spark, [
        (1, 1, 1, "quiz_correct", None, T0)]))).collect()}
    assert out[1].user_override_score == 0.9 and out[1].understanding_score == 1.0
    assert out[2].understanding_score is None and out[2].score_confidence == 0.0


def test_sql_functions(spark):
    X.register(spark)
    r = spark.sql("SELECT evidence_confidence(0.7D) c, concept_key(' A-b! C ') k, token_estimate('') t, "
                  "cosine_sim(array(1D, 0D), array(1D, 1D)) s").first()
    assert (r.c, r.k, r.t) == (0.5, "a b c", 1) and r.s == pytest.approx(0.70710678)
