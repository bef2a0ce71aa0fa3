"""Section E queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import expr as X
from quillmark.operators import learner as L
from quillmark.plans.common import i64, r6, us
from quillmark.plans.registry import query
from quillmark.plans.views import AS_OF

_TS = f"TIMESTAMP '{AS_OF}'"
_DAYS = f"(epoch_us({_TS}) - epoch_us(last_reinforced_at)) / 86400000000.0"
DECAY = (f"CASE WHEN last_reinforced_at IS NULL OR {_DAYS} <= 0 THEN 1.0 "
         f"ELSE greatest(0.25, pow(0.5, {_DAYS} / 30.0)) END")
SCORE = f"coalesce(user_override_score, understanding_score * ({DECAY}))"


def known_at(pairs: str, ident: str) -> str:
    """Twin of the as-of state: all evidence of each (``ident``, concept_id, moment) of ``pairs`` before its moment."""
    days = "(epoch_us(moment) - epoch_us(last_at)) / 86400000000.0"
    before = f"({pairs}) p JOIN observations o ON o.concept_id = p.concept_id AND o.observed_at < p.moment"
    return f"""
SELECT *, round(coalesce(user_override_score, raw_score * CASE WHEN {days} <= 0 THEN 1.0
    ELSE greatest(0.25, pow(0.5, {days} / 30.0)) END), 9) AS score
FROM (SELECT p.{ident}, p.concept_id, any_value(p.moment) AS moment, max(o.observed_at) AS last_at,
    CASE WHEN sum(weight) > 0 THEN round(sum(weight * target) / sum(weight), 9) END AS raw_score,
    CASE WHEN sum(weight) > 0 THEN round(sum(weight) / (sum(weight) + 0.7), 9) ELSE 0.0 END AS score_confidence FROM {before} GROUP BY 1, 2) k
LEFT JOIN (SELECT {ident}, concept_id, arg_max(style, (n, last, style)) AS effective_style
  FROM (SELECT p.{ident}, p.concept_id, style_in_play AS style, count(*) AS n, max(o.observed_at) AS last
    FROM {before} WHERE resolves_observation_id IS NOT NULL AND style_in_play IS NOT NULL GROUP BY 1, 2, 3) s
  GROUP BY 1, 2) e USING ({ident}, concept_id)
LEFT JOIN (SELECT concept_id, user_override_score FROM concepts) c USING (concept_id)"""


def raw_names(v):
    """Untrusted signal rows: the name is free text, types and styles may be unknown."""
    return v.sql("""
      SELECT event_id AS signal_id, user_id, event_type AS raw_type,
        CASE WHEN event_id % 6 = 0 THEN 'quiz_correct' WHEN event_id % 6 = 1 THEN 'mystery'
             WHEN event_id % 6 = 2 THEN NULL ELSE 'explicit_confusion' END AS signal_type,
        CASE WHEN event_id % 8 = 0 THEN concat(' ', chr(9), chr(7), ' ')
             ELSE concat(' ', event_type, chr(10), chr(31), props, '  x') END AS concept_name,
        CASE WHEN event_id % 2 = 0 THEN 'formal' ELSE 'loud' END AS style_in_play,
        CASE WHEN event_id % 4 = 0 THEN '   ' WHEN event_id % 4 = 1 THEN repeat(props, 80)
             WHEN event_id % 4 = 2 THEN concat('  ', props) END AS note
      FROM events""")


@query("e1_signal_validation", r"""
WITH raw AS (SELECT event_id AS signal_id,
    CASE WHEN event_id % 6 = 0 THEN 'quiz_correct' WHEN event_id % 6 = 1 THEN 'mystery'
         WHEN event_id % 6 = 2 THEN NULL ELSE 'explicit_confusion' END AS signal_type,
    CASE WHEN event_id % 8 = 0 THEN concat(' ', chr(9), chr(7), ' ')
         ELSE concat(' ', event_type, chr(10), chr(31), props, '  x') END AS concept_name,
    CASE WHEN event_id % 2 = 0 THEN 'formal' END AS style_in_play,
    left(trim(CASE WHEN event_id % 4 = 1 THEN repeat(props, 80)
         WHEN event_id % 4 = 2 THEN concat('  ', props) ELSE '' END), 500) AS note FROM events),
c AS (SELECT * REPLACE (left(trim(regexp_replace(regexp_replace(concept_name,
    '[\x00-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g')), 200) AS concept_name,
    nullif(note, '') AS note) FROM raw)
SELECT *, CASE WHEN signal_type IS NULL OR signal_type = 'mystery' THEN 'unknown_signal_type'
  WHEN concept_name = '' THEN 'empty_name' END AS reject_reason FROM c""")
def e1(v):
    return L.validate(raw_names(v)).drop("user_id", "raw_type")


@query("e2_signal_source", """
SELECT observation_id, signal_source FROM observations""")
def e2(v):
    return v.signals.select("observation_id",
                            L.source_of(F.col("signal_type")).alias("signal_source"))


@query("e3_signal_weight", "SELECT observation_id, weight FROM observations")
def e3(v):
    source = L.source_of(F.col("signal_type"))
    return v.signals.select("observation_id",
                            L.weight_of(F.col("signal_type"), source).alias("weight"))


@query("e4_signal_target", "SELECT observation_id, target FROM observations")
def e4(v):
    return v.observations.select("observation_id", L.target_of(
        F.col("signal_type"), F.col("resolves_observation_id")).cast("double").alias("target"))


@query("e5_struggle_pairing", "SELECT observation_id, resolves_observation_id FROM paired")
def e5(v):
    return L.pair_struggles(v.signals)


@query("e6_learner_state", """
SELECT user_id, concept_id, round(total_weight, 6) AS total_weight, round(raw_score, 6) AS raw_score,
  evidence_count, epoch_us(last_reinforced_at) AS last_reinforced_at FROM states""")
def e6(v):
    return L.states(v.observations).select(
        "user_id", "concept_id", r6("total_weight"), r6("raw_score"), "evidence_count",
        us("last_reinforced_at"))


@query("e7_confidence", """
SELECT user_id, concept_id, round(score_confidence, 6) AS score_confidence FROM states""")
def e7(v):
    w = v.observations.groupBy("user_id", "concept_id").agg(F.sum("weight").alias("w"))
    return w.select("user_id", "concept_id",
                    r6(X.confidence(F.col("w")), "score_confidence"))


@query("e8_decay", f"""
SELECT observation_id, round({DECAY}, 6) AS decay
FROM (SELECT observation_id, observed_at AS last_reinforced_at FROM signals)""")
def e8(v):
    return v.signals.select(
        "observation_id", r6(X.decay(F.col("observed_at"), v.as_of()), "decay"))


@query("e9_effective_score", f"""
SELECT concept_id, round({SCORE}, 6) AS score FROM concepts""")
def e9(v):
    return v.concepts.select("concept_id", r6(X.effective_score(
        F.col("user_override_score"), F.col("understanding_score"),
        F.col("last_reinforced_at"), v.as_of()), "score"))


@query("e10_weak_flag", f"""
SELECT concept_id, coalesce(round({SCORE}, 9) < 0.4 AND score_confidence >= 0.3, false) AS is_weak
FROM concepts""")
def e10(v):
    score = X.effective_score(F.col("user_override_score"), F.col("understanding_score"),
                              F.col("last_reinforced_at"), v.as_of())
    return v.concepts.select(
        "concept_id", X.is_weak(F.round(score, 9), F.col("score_confidence")).alias("is_weak"))


@query("e11_effective_style", """
SELECT user_id, concept_id, effective_style FROM states""")
def e11(v):
    return L.states(v.observations).select("user_id", "concept_id", "effective_style")


@query("e12_refresh_cache", """
SELECT k.user_id, k.concept_id, round(raw_score, 6) AS understanding_score,
  round(coalesce(score_confidence, 0), 6) AS score_confidence,
  coalesce(evidence_count, 0) AS evidence_count, effective_style,
  CAST(CASE WHEN k.concept_id % 13 = 0 THEN 0.9 END AS DOUBLE) AS user_override_score
FROM (SELECT DISTINCT user_id, user_id * 12 + event_id % 15 AS concept_id FROM events) k
LEFT JOIN states s ON s.user_id = k.user_id AND s.concept_id = k.concept_id""")
def e12(v):
    """Concepts include some nobody has evidence for; overrides are left alone."""
    concepts = v.events.select(
        "user_id", (F.col("user_id") * 12 + F.col("event_id") % 15).alias("concept_id")
    ).distinct().withColumns({
        "user_override_score": F.when(F.col("concept_id") % 13 == 0, 0.9),
        "understanding_score": F.lit(0.5), "score_confidence": F.lit(0.5),
        "evidence_count": F.lit(1), "effective_style": F.lit("code"),
        "last_reinforced_at": v.as_of()})
    return L.refresh(concepts, v.states).select(
        "user_id", "concept_id", r6("understanding_score"), r6("score_confidence"),
        "evidence_count", "effective_style", "user_override_score")


@query("e13_score_timeline", """
SELECT observation_id, round(sum(weight) OVER w, 6) AS cum_weight,
  round(CASE WHEN sum(weight) OVER w > 0 THEN sum(weight * target) OVER w / sum(weight) OVER w END,
    6) AS score_after, count(*) OVER w AS cum_count
FROM observations WINDOW w AS (PARTITION BY user_id, concept_id
  ORDER BY observed_at, observation_id ROWS UNBOUNDED PRECEDING)""")
def e13(v):
    return L.timeline(v.observations).select(
        "observation_id", r6("cum_weight"), r6("score_after"), i64("cum_count"))


@query("e14_what_if", """
WITH pend AS (SELECT user_id, user_id * 12 AS concept_id, max(ts) + INTERVAL 1 DAY AS observed_at,
    0.9 AS weight, 1.0 AS target FROM events GROUP BY user_id)
SELECT user_id, concept_id, round(sum(weight * target) / sum(weight), 6) AS raw_score,
  round(sum(weight) / (sum(weight) + 0.7), 6) AS score_confidence,
  CAST(count(*) AS INTEGER) AS evidence_count, epoch_us(max(observed_at)) AS last_reinforced_at
FROM (SELECT o.user_id, o.concept_id, o.observed_at, o.weight, o.target FROM observations o
      SEMI JOIN pend p ON o.user_id = p.user_id AND o.concept_id = p.concept_id
      UNION ALL SELECT * FROM pend) q GROUP BY user_id, concept_id""")
def e14(v):
    pending = v.events.groupBy("user_id").agg(F.max("ts").alias("last")).select(
        "user_id", (F.col("user_id") * 12).alias("concept_id"),
        (F.col("last") + F.expr("INTERVAL '1' DAY")).alias("observed_at"),
        F.lit(None).cast("string").alias("style_in_play"),
        F.lit(None).cast("bigint").alias("resolves_observation_id"),
        F.lit(0.9).alias("weight"), F.lit(1.0).alias("target"))
    return L.project(v.observations, pending).select(
        "user_id", "concept_id", r6("raw_score"), r6("score_confidence"), "evidence_count",
        us("last_reinforced_at"))


_NAMED = """
SELECT observation_id AS signal_id, user_id, turn_id * 5 % (SELECT max(n) FROM doc_count) AS paper_id,
  CASE WHEN observation_id % 4 = 0 THEN 'alias 3' WHEN observation_id % 4 = 1 THEN 'ALIAS-7!'
       WHEN observation_id % 4 = 2 THEN 'Alias-7' ELSE 'brand new ' || CAST(observation_id % 9 AS STRING)
  END AS concept_name FROM signals"""
_KEY = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
_RECALL = f"""
live AS (SELECT * FROM concepts WHERE merged_into_id IS NULL),
keys AS (SELECT user_id, concept_id, 0 AS kind, {_KEY.format('canonical_name')} AS key FROM live
  UNION ALL SELECT user_id, concept_id, 1, unnest(aliases) FROM live),
named AS ({_NAMED}),
hits AS (SELECT signal_id, arg_min(concept_id, (kind, concept_id)) AS matched_concept_id
  FROM (SELECT n.signal_id, k.kind, k.concept_id FROM named n JOIN keys k ON k.user_id = n.user_id
        AND k.kind = 0 AND k.key = {_KEY.format('n.concept_name')}
        UNION ALL SELECT n.signal_id, k.kind, k.concept_id FROM named n JOIN keys k
        ON k.user_id = n.user_id AND k.kind = 1 AND k.key = n.concept_name) h GROUP BY signal_id)"""


@query("e15_recall_concept", f"""
WITH {_RECALL}
SELECT signal_id, concept_name, matched_concept_id, matched_concept_id IS NULL AS created
FROM named LEFT JOIN hits USING (signal_id)""")
def e15(v):
    return L.recall(v.sql(_NAMED), v.concepts).select(
        "signal_id", "concept_name", "matched_concept_id",
        F.col("matched_concept_id").isNull().alias("created"))


@query("e15_create_concepts", f"""
WITH {_RECALL},
missing AS (SELECT n.*, left({_KEY.format('n.concept_name')}, 200) AS normalized_name
  FROM named n LEFT JOIN hits USING (signal_id) WHERE matched_concept_id IS NULL)
SELECT user_id, normalized_name, left(arg_min(concept_name, signal_id), 200) AS canonical_name,
  arg_min(paper_id, signal_id) AS first_paper_id, count(*) AS signals,
  CAST('0x' || left(md5(CAST(user_id AS VARCHAR) || '|' || normalized_name), 15) AS BIGINT) AS concept_id
FROM missing GROUP BY user_id, normalized_name""")
def e15_create(v):
    """Names that match nothing become one concept each, however many signals carry them."""
    return L.create_missing(L.recall(v.sql(_NAMED), v.concepts))


@query("e15_placed_signals", f"""
WITH {_RECALL}
SELECT signal_id, coalesce(matched_concept_id, CAST('0x' || left(md5(CAST(user_id AS VARCHAR) || '|' ||
  left({_KEY.format('concept_name')}, 200)), 15) AS BIGINT)) AS concept_id
FROM named LEFT JOIN hits USING (signal_id)""")
def e15_placed(v):
    return L.placed_signals(L.recall(v.sql(_NAMED), v.concepts)).select("signal_id", "concept_id")


@query("e15_add_source_papers", f"""
WITH {_RECALL},
new AS (SELECT matched_concept_id AS concept_id, list_sort(list_distinct(list(paper_id))) AS extra
  FROM named JOIN hits USING (signal_id) GROUP BY 1)
SELECT concept_id, array_to_string(CASE WHEN extra IS NULL THEN source_paper_ids ELSE
  list_concat(source_paper_ids[1:1],
    [x FOR x IN source_paper_ids[2:2] IF NOT list_contains(source_paper_ids[1:1], x)],
    [x FOR x IN source_paper_ids[3:3] IF NOT list_contains(source_paper_ids[1:2], x)],
    [x FOR x IN extra IF NOT list_contains(source_paper_ids, x)]) END, ',') AS papers
FROM concepts LEFT JOIN new USING (concept_id)""")
def e15b(v):
    matched = L.recall(v.sql(_NAMED), v.concepts).filter("matched_concept_id IS NOT NULL")
    return L.add_sources(v.concepts, matched).select(
        "concept_id", F.array_join("source_paper_ids", ",").alias("papers"))


@query("e16_backstop_signal", """
WITH sig AS (SELECT turn_id FROM signals WHERE signal_type <> 'reinforcement'),
hits AS (SELECT turn_id, user_id * 12 + (turn_id + r) % 12 AS concept_id, r FROM raw_turns,
  (VALUES (1), (2)) x(r) WHERE memory_read AND turn_id % 7 <> 0)
SELECT t.turn_id, t.user_id, min_by(h.concept_id, h.r) AS concept_id, 'reinforcement' AS signal_type,
  CAST(0 AS DOUBLE) AS weight, epoch_us(min(t.created_at)) AS observed_at
FROM raw_turns t JOIN hits h USING (turn_id)
WHERE agent_action IN ('answer', 'callback') AND memory_read AND error_code IS NULL
  AND t.turn_id NOT IN (FROM sig) GROUP BY t.turn_id, t.user_id""")
def e16(v):
    signals = v.signals.filter("signal_type <> 'reinforcement'")
    hits = v.raw_turns.filter("memory_read AND turn_id % 7 <> 0").select(
        "turn_id", "user_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank_no")
    ).select("turn_id", "rank_no", (
        F.col("user_id") * 12 + (F.col("turn_id") + F.col("rank_no")) % 12).alias("concept_id"))
    return L.backstop(v.raw_turns, signals, hits).select(
        "turn_id", "user_id", "concept_id", "signal_type", "weight", us("observed_at"))


@query("e17_persisted_signals", """
SELECT observation_id FROM signals WHERE turn_id IN
  (SELECT turn_id FROM raw_turns WHERE error_code IS NULL)""")
def e17(v):
    stored = v.raw_turns.filter("error_code IS NULL")
    return L.persisted(v.signals, stored).select("observation_id")


def correction_requests(v):
    return v.sql("""SELECT event_id AS request_id, user_id, user_id * 12 + event_id % 12 AS concept_id,
      CAST((event_id % 21) AS DOUBLE) / 20 AS score, ts AS created_at,
      CASE WHEN event_id % 2 = 0 THEN ' ' ELSE props END AS note
      FROM events WHERE event_type = 'purchase'""")


@query("e18_correction_override", """
SELECT user_id, user_id * 12 + event_id % 12 AS concept_id,
  arg_max(CAST(event_id % 21 AS DOUBLE) / 20, (ts, event_id)) AS user_override_score
FROM events WHERE event_type = 'purchase' GROUP BY 1, 2""")
def e18(v):
    return L.corrections(correction_requests(v))[0]


@query("e18_correction_signals", """
SELECT event_id AS signal_id, user_id, user_id * 12 + event_id % 12 AS concept_id,
  CASE WHEN event_id % 21 >= 8 THEN 'user_stated_known' ELSE 'user_stated_unknown' END AS signal_type,
  CASE WHEN event_id % 2 = 0 THEN 'Corrected by the reader.' ELSE trim(props) END AS note
FROM events WHERE event_type = 'purchase'""")
def e18s(v):
    return L.corrections(correction_requests(v))[1]


@query("e19_style_ranking", """
SELECT user_id, concept_id, style_in_play, count(*) AS resolutions,
  CAST(dense_rank() OVER (PARTITION BY user_id, concept_id ORDER BY count(*) DESC) AS INTEGER) AS place
FROM observations WHERE resolves_observation_id IS NOT NULL AND style_in_play IS NOT NULL
GROUP BY user_id, concept_id, style_in_play""")
def e19(v):
    return L.style_counts(v.observations).select(
        "user_id", "concept_id", "style_in_play", "resolutions", "place")
