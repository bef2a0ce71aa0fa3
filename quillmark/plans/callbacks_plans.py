"""Section H queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import callbacks as H
from quillmark.operators import retrieval as R
from quillmark.plans import memory_plans  # noqa: F401  (graph views)
from quillmark.plans.common import r6
from quillmark.plans.learner_plans import known_at
from quillmark.plans.registry import query
from quillmark.plans.views import ORACLE_VIEWS, _DUCK, _SPARK, add_stored, dialect

_HITS = """SELECT turn_id, user_id, rank_no, user_id * 12 + (turn_id + rank_no * 5) % 12 AS concept_id
  FROM (SELECT turn_id, user_id, <<explode 1, 2, 3>> AS rank_no FROM raw_turns
        WHERE memory_read) q"""
ORACLE_VIEWS["memory_hits"] = dialect(_HITS, _DUCK)
ORACLE_VIEWS["reader_preferences"] = """
SELECT user_id, coalesce(json_extract_string(preferences, '$.personalization_enabled'), 'true')
    = 'true' AS personalization_enabled,
  coalesce(json_extract_string(preferences, '$.proactivity'), 'normal') AS proactivity,
  coalesce(json_extract_string(preferences, '$.quiz_appetite'), 'normal') AS quiz_appetite,
  coalesce(json_extract_string(preferences, '$.depth'), 'normal') AS depth,
  json_extract_string(preferences, '$.preferred_style') AS preferred_style,
  CASE coalesce(json_extract_string(preferences, '$.proactivity'), 'normal') WHEN 'off' THEN NULL
    WHEN 'low' THEN 10 WHEN 'high' THEN 2 ELSE 5 END AS callback_gap,
  CASE coalesce(json_extract_string(preferences, '$.quiz_appetite'), 'normal') WHEN 'off' THEN NULL
    WHEN 'low' THEN 8 WHEN 'high' THEN 2 ELSE 4 END AS check_gap
FROM users"""
ORACLE_VIEWS["callback_gaps"] = """
SELECT turn_id, user_id, (seen - 1) - last_value(CASE WHEN callback_concept_id IS NOT NULL THEN upto END
    IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY created_at, turn_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turns_since
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, turn_id) AS seen,
    count(*) OVER (PARTITION BY user_id ORDER BY created_at) AS upto FROM raw_turns) q"""
ORACLE_VIEWS["callback_reach"] = """
SELECT h.turn_id, h.user_id, g.far AS concept_id, any_value(t.created_at) AS moment,
  arg_max(struct_pack(relationship_type := g.relationship_type, confidence := g.confidence),
    (g.confidence, -h.rank_no, g.relationship_type)) AS e
FROM memory_hits h JOIN graph g ON g.user_id = h.user_id AND g.near = h.concept_id
JOIN memory_hits p ON p.turn_id = h.turn_id AND p.rank_no = 1
JOIN raw_turns t ON t.turn_id = h.turn_id
WHERE g.far <> p.concept_id GROUP BY 1, 2, 3"""
ORACLE_VIEWS["reach_known"] = known_at("SELECT turn_id, concept_id, moment FROM callback_reach", "turn_id")
ORACLE_VIEWS["ranked_callbacks"] = """
SELECT turn_id, user_id, concept_id, e.relationship_type, weight, score, effective_style,
  source_paper_ids, row_number() OVER (PARTITION BY turn_id ORDER BY weight DESC, concept_id) AS place
FROM (SELECT b.turn_id, b.user_id, b.concept_id, b.e, k.score, k.effective_style,
    c.source_paper_ids, round(b.e.confidence * (1 - k.score), 9) AS weight
  FROM callback_reach b JOIN reach_known k ON k.turn_id = b.turn_id AND k.concept_id = b.concept_id
  JOIN (SELECT concept_id, source_paper_ids FROM concepts) c ON c.concept_id = b.concept_id
  WHERE k.score < 0.4 AND k.score_confidence >= 0.3) q"""
ORACLE_VIEWS["prior_options"] = """
SELECT r.turn_id, r.concept_id, min(r.paper_id) AS prior_paper_id
FROM (SELECT turn_id, user_id, concept_id, unnest(source_paper_ids) AS paper_id
      FROM ranked_callbacks) r
JOIN raw_turns t ON t.turn_id = r.turn_id AND t.paper_id IS DISTINCT FROM r.paper_id
JOIN user_paper_access a ON a.user_id = r.user_id AND a.paper_id = r.paper_id
  AND a.revoked_at IS NULL GROUP BY 1, 2"""
ORACLE_VIEWS["decisions"] = """
SELECT turn_id, user_id, suppressed_reason, CASE WHEN suppressed_reason IS NULL THEN c.concept_id END
    AS concept_id,
  CASE WHEN suppressed_reason IS NULL THEN c.relationship_type END AS relationship_type,
  CASE WHEN suppressed_reason IS NULL THEN c.prior_paper_id END AS prior_paper_id,
  CASE WHEN suppressed_reason IS NULL THEN c.effective_style END AS effective_style
FROM (SELECT t.turn_id, t.user_id, c.c, CASE WHEN NOT p.personalization_enabled
      THEN 'personalization_off' WHEN p.callback_gap IS NULL THEN 'proactivity_off'
    WHEN t.turn_id NOT IN (SELECT turn_id FROM memory_hits) THEN 'no_memory'
    WHEN t.turn_id NOT IN (SELECT turn_id FROM ranked_callbacks) THEN 'no_weak_candidate'
    WHEN g.turns_since < p.callback_gap THEN 'rate_limited' WHEN c.c IS NULL THEN 'grant_revoked'
    END AS suppressed_reason
  FROM raw_turns t JOIN reader_preferences p USING (user_id) JOIN callback_gaps g USING (turn_id)
  LEFT JOIN (SELECT turn_id, arg_min(struct_pack(concept_id := r.concept_id, relationship_type :=
      r.relationship_type, prior_paper_id := o.prior_paper_id, effective_style := r.effective_style),
      place) AS c FROM ranked_callbacks r JOIN prior_options o USING (turn_id, concept_id)
    GROUP BY turn_id) c USING (turn_id)
  WHERE t.agent_action IN ('answer', 'callback')) q"""


def hits(v):
    return v.sql(dialect(_HITS, _SPARK))


def _decisions(v):
    return H.decide(v.turns, v.users, hits(v), v.edges, v.concept_links, R.scope(v.user_paper_access),
                    v.concept_history)


def _ranked(v):
    return H.rank_candidates(hits(v), v.turns, v.edges, v.concept_links, v.concept_history)


add_stored("decisions", _decisions)


@query("h1_preference_gate", """
SELECT user_id, personalization_enabled, proactivity, quiz_appetite, depth, preferred_style,
  CAST(callback_gap AS INTEGER) AS callback_gap, CAST(check_gap AS INTEGER) AS check_gap
FROM reader_preferences""")
def h1(v):
    return H.preferences(v.users)


@query("h2_candidate_ranking", """
SELECT turn_id, concept_id, relationship_type, round(weight, 6) AS weight,
  CAST(place AS INTEGER) AS place FROM ranked_callbacks""")
def h2(v):
    return _ranked(v).select(
        "turn_id", "concept_id", "relationship_type", r6("weight"), "place")


@query("h3_turn_gap", "SELECT turn_id, turns_since FROM callback_gaps")
def h3(v):
    return H.turns_since(v.turns, H.callback_marks(v.turns)).select("turn_id", "turns_since")


@query("h4_prior_paper", "SELECT turn_id, concept_id, prior_paper_id FROM prior_options")
def h4(v):
    return H.prior_papers(_ranked(v), v.turns, R.scope(v.user_paper_access))


@query("h5_callback_decision", "SELECT * FROM decisions")
def h5(v):
    return _decisions(v)


@query("h6_suppression_counts", """
SELECT user_id, outcome, count(*) AS turns, CAST(grouping_id(user_id, outcome) AS INTEGER) AS level
FROM (SELECT user_id, coalesce(suppressed_reason, 'fired') AS outcome FROM decisions) q
GROUP BY ROLLUP (user_id, outcome)""")
def h6(v):
    return H.outcome_counts(v.decisions)
