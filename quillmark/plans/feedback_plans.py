"""Section K queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark import vocab as V
from quillmark.operators import callbacks as H
from quillmark.operators import feedback as K
from quillmark.plans import callbacks_plans  # noqa: F401  (preference views)
from quillmark.plans.registry import query
from quillmark.plans.views import ORACLE_VIEWS, words

ORACLE_VIEWS["judged_feedback"] = f"""
SELECT feedback_id, user_id, created_at, feedback_type, target_turn_id, target_concept_id,
  preferred_style, nullif(left(trim(coalesce(comment, '')), 2000), '') AS comment,
  CASE WHEN feedback_type NOT IN ({words(V.FEEDBACK_TYPE)}) THEN 'unknown_type'
    WHEN (target_turn_id IS NULL) = (target_concept_id IS NULL) THEN 'exactly_one_target'
    WHEN feedback_type = 'style_preference' AND preferred_style NOT IN ({words(V.EXPLANATION_STYLE)})
      THEN 'unknown_style' END AS reject_reason FROM feedback"""


def _good(v):
    return K.validate(v.feedback).filter("reject_reason IS NULL")


@query("k1_feedback_validation", """
SELECT feedback_id, comment, reject_reason FROM judged_feedback""")
def k1(v):
    return K.validate(v.feedback).select("feedback_id", "comment", "reject_reason")


@query("k2_depth_fold", """
WITH moves AS (SELECT user_id, list(CASE feedback_type WHEN 'too_basic' THEN 1 ELSE -1 END
    ORDER BY created_at, feedback_id) AS ms FROM judged_feedback
  WHERE reject_reason IS NULL AND feedback_type IN ('too_basic', 'too_advanced') GROUP BY user_id)
SELECT user_id, CASE WHEN ms IS NULL THEN depth ELSE list_extract(['introductory', 'normal', 'detailed',
  'expert'], 1 + CAST(list_reduce(list_concat([CASE depth WHEN 'introductory' THEN 0 WHEN 'detailed' THEN 2
    WHEN 'expert' THEN 3 ELSE 1 END], ms), lambda a, x: greatest(0, least(3, a + x))) AS INTEGER))
  END AS depth
FROM reader_preferences LEFT JOIN moves USING (user_id)""")
def k2(v):
    return K.fold_depth(_good(v), H.preferences(v.users))


@query("k3_preferred_style", """
SELECT user_id, arg_max(preferred_style, (created_at, feedback_id)) AS preferred_style
FROM judged_feedback WHERE reject_reason IS NULL AND feedback_type = 'style_preference'
GROUP BY user_id""")
def k3(v):
    return K.preferred_style(_good(v))


@query("k4_applied_to_turn", """
WITH both_rows AS (SELECT user_id, created_at, 1 AS seq, NULL AS turn_id, feedback_id
    FROM judged_feedback WHERE reject_reason IS NULL AND feedback_type IN
    ('too_basic', 'too_advanced', 'style_preference')
  UNION ALL SELECT user_id, created_at, 0, turn_id, NULL FROM raw_turns
  WHERE agent_action IN ('answer', 'callback'))
SELECT feedback_id, applied_to_turn_id FROM (SELECT *, first_value(turn_id IGNORE NULLS) OVER
    (PARTITION BY user_id ORDER BY created_at, seq, turn_id, feedback_id
     ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS applied_to_turn_id FROM both_rows) q
WHERE feedback_id IS NOT NULL""")
def k4(v):
    return K.stamp(_good(v), v.turns)


@query("k5_recent_feedback", """
SELECT user_id, feedback_id, CAST(rn AS INTEGER) AS rank_no FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id ORDER BY created_at DESC, feedback_id DESC) AS rn FROM feedback) q
WHERE rn <= 50""")
def k5(v):
    return K.recent(v.feedback).select("user_id", "feedback_id", "rank_no")


@query("k6_foreign_targets", """
SELECT feedback_id FROM feedback f WHERE (target_turn_id IS NOT NULL AND NOT EXISTS (SELECT 1
    FROM raw_turns t WHERE t.turn_id = f.target_turn_id AND t.user_id = f.user_id))
  OR (target_concept_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM concepts c
    WHERE c.concept_id = f.target_concept_id AND c.user_id = f.user_id))""")
def k6(v):
    return K.not_owned(v.feedback, v.raw_turns, v.concepts)
