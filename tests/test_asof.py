"""States and histories at a moment, against plain loops."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillmark.functions import expr as X
from quillmark.operators import asof
from quillmark.operators import conversations as J

START = datetime(2024, 1, 1)
SEEN = ("user_id INT, concept_id INT, observation_id INT, observed_at TIMESTAMP_NTZ, weight DOUBLE, target DOUBLE, "
        "resolves_observation_id INT, style_in_play STRING")


def observations(seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        user = 0 if i % 3 == 0 else rng.randrange(1, 4)
        rows.append((user, user * 10 + rng.randrange(3), i, START + timedelta(hours=rng.randrange(60) * 12),
                     rng.choice([0.0, 0.4, 0.75, 1.0]), rng.choice([0.0, 0.5, 1.0]),
                     rng.choice([None, 7]), rng.choice([None, "a", "b", "c"])))
    return rows


def state(rows, user, concept, moment):
    own = [r for r in rows if r[:2] == (user, concept) and r[3] < moment]
    if not own:
        return None, None, None, None
    weight = sum(r[4] for r in own)
    styles = {}
    for r in own:
        if r[6] is not None and r[7] is not None:
            n, last = styles.get(r[7], (0, START))
            styles[r[7]] = (n + 1, max(last, r[3]))
    lead = max(((n, last, s) for s, (n, last) in styles.items()), default=(0, 0, None))[2]
    raw = round(sum(r[4] * r[5] for r in own) / weight, 9) if weight else None
    return raw, round(weight / (weight + 0.7), 9) if weight else 0.0, lead, max(r[3] for r in own)


def test_state_is_that_before_the_moment(spark):
    rows = observations()
    rng = random.Random(8)
    asked = [(i, (u := rng.randrange(5)), u * 10 + rng.randrange(4), START + timedelta(hours=rng.randrange(62) * 12))
             for i in range(200)]
    history = asof.intervals(spark.createDataFrame(rows, SEEN))
    requests = spark.createDataFrame(asked, "request_id INT, user_id INT, concept_id INT, at TIMESTAMP_NTZ")
    got = {r.request_id: (r.raw_score, r.score_confidence, r.effective_style, r.last_reinforced_at)
           for r in asof.state_at(requests, history).collect()}
    assert len(got) == len(asked)
    for ident, user, concept, moment in asked:
        want = state(rows, user, concept, moment)
        assert got[ident][2:] == want[2:], ident
        assert all(a == b or abs(a - b) < 2e-9 for a, b in zip(got[ident][:2], want[:2])), ident


def test_intervals_follow_each_other(spark):
    history = asof.intervals(spark.createDataFrame(observations(), SEEN))
    assert history.filter("valid_to < valid_from").count() == 0
    open_ended = history.filter("valid_to IS NULL").groupBy("user_id", "concept_id").count()
    assert open_ended.filter("count != 1").count() == 0 and open_ended.count() == history.select(
        "user_id", "concept_id").distinct().count()


def test_no_concept_that_was_ever_weak_is_left_out(spark):
    rows = observations()
    history = asof.intervals(spark.createDataFrame(rows, SEEN))
    concepts = history.select("concept_id").distinct().withColumn(
        "user_override_score", F.when(F.col("concept_id") == 11, 0.9).cast("double"))
    moments = spark.range(0, 70).select(
        (F.lit(START).cast("timestamp_ntz") + F.expr("make_interval(0, 0, 0, 0, CAST(id AS INT) * 12 + 1)")).alias("at"))
    pairs = history.select("user_id", "concept_id").distinct().join(moments)
    weak = {r.concept_id for r in asof.scored_at(pairs, history, concepts).filter("is_weak").collect()}
    able = {r.concept_id for r in asof.ever_weak(history, concepts).collect()}
    assert weak and weak <= able and 11 not in able


def test_history_before_a_request(spark):
    rng = random.Random(6)
    said = [(s, i, START + timedelta(minutes=rng.randrange(200)), "x" * rng.choice([0, 3, 40, 90]))
            for s in range(4) for i in range(1 if s == 3 else 60)]
    asked = [(i, rng.randrange(5), START + timedelta(minutes=rng.randrange(220))) for i in range(80)]
    messages = spark.createDataFrame(said, "session_id INT, ordinal INT, created_at TIMESTAMP_NTZ, content STRING")
    requests = spark.createDataFrame(asked, "turn_id INT, session_id INT, created_at TIMESTAMP_NTZ")
    cost = {(r.session_id, r.ordinal): max(1, r.c) for r in messages.select(
        "session_id", "ordinal", X.token_estimate(F.col("content")).alias("c")).collect()}
    got = {}
    for r in J.placed_messages(messages).join(
            J.context_places_at(requests, messages, 60), ["session_id", "place"]).collect():
        got.setdefault(r.turn_id, set()).add(r.ordinal)
    for turn, session, moment in asked:
        before = sorted((m[2], m[1]) for m in said if m[0] == session and m[2] < moment)[::-1]
        want, spent = set(), 0
        for n, (_, ordinal) in enumerate(before):
            spent += cost[session, ordinal]
            if spent <= 60 or n == 0:
                want.add(ordinal)
            else:
                break
        assert got.get(turn, set()) == want, turn


def test_requests_between_two_messages_share_one_history(spark):
    said = [(1, i, START + timedelta(minutes=10 * i), "user", f"m{i}") for i in range(3)]
    messages = spark.createDataFrame(said, "session_id INT, ordinal INT, created_at TIMESTAMP_NTZ, role STRING, content STRING")
    asked = [(t, 7, 1, 5, START + timedelta(minutes=m)) for t, m in ((1, 0), (2, 11), (3, 12), (4, 13), (5, 99))]
    requests = spark.createDataFrame(asked, "turn_id INT, user_id INT, session_id INT, paper_id INT, created_at TIMESTAMP_NTZ")
    hits = spark.createDataFrame([(t, 7, 9, 1, 0.5) for t in (1, 4)], "turn_id INT, user_id INT, concept_id INT, rank_no INT, score DOUBLE")
    related = spark.createDataFrame([(7, 9, i, "t", 0.1 * i) for i in range(5)],
                                    "user_id INT, concept_id INT, related_id INT, relationship_type STRING, edge_confidence DOUBLE")
    decisions = spark.createDataFrame([], "turn_id INT, suppressed_reason STRING")
    out = J.context_rows(requests, messages, hits, related, decisions, spark.createDataFrame([(7, "normal")], "user_id INT, depth STRING"),
                         spark.createDataFrame([(5, "title")], "paper_id INT, title STRING"))
    got = {r.turn_id: r for r in out.collect()}
    assert {t: [m.content for m in r.history or []] for t, r in got.items()} == {
        1: [], 2: ["m0", "m1"], 3: ["m0", "m1"], 4: ["m0", "m1"], 5: ["m0", "m1", "m2"]}
    assert {t: [[n.related_id for n in m.near] for m in r.memory or []] for t, r in got.items()} == {
        1: [[4, 3, 2]], 2: [], 3: [], 4: [[4, 3, 2]], 5: []}
