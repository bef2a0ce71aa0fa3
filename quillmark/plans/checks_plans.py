"""Section I queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import checks as I
from quillmark.operators import memory as M
from quillmark.plans import callbacks_plans  # noqa: F401  (preference views)
from quillmark.plans import memory_plans  # noqa: F401  (concept views)
from quillmark.plans.learner_plans import known_at
from quillmark.plans.registry import query
from quillmark.plans.views import ORACLE_VIEWS

ORACLE_VIEWS["graded_attempts"] = """
SELECT a.attempt_id, a.quiz_id, a.user_id, coalesce(nullif(left(trim(a.answer_text), 4000), ''),
    '(no answer)') AS answer_text,
  CASE WHEN returned_grade IN ('correct', 'partial', 'incorrect') THEN returned_grade END AS grade,
  CASE WHEN returned_grade IS NULL THEN 'grading failed'
    WHEN returned_grade NOT IN ('correct', 'partial', 'incorrect')
    THEN 'unknown grade ' || returned_grade END AS grading_error FROM attempts a"""


ORACLE_VIEWS["check_known"] = known_at(
    "SELECT turn_id, user_id * 12 + turn_id % 12 AS concept_id, created_at AS moment FROM raw_turns", "turn_id")


def _requests(v):
    return v.turns.withColumn("concept_id", F.col("user_id") * 12 + F.col("turn_id") % 12)


@query("i1_check_gate", """
WITH marks AS (SELECT user_id, created_at AS moment, 1 AS seq, NULL AS turn_id FROM quizzes),
both_rows AS (SELECT user_id, created_at AS moment, 0 AS seq, turn_id FROM raw_turns
  UNION ALL SELECT * FROM marks),
counted AS (SELECT *, count(turn_id) OVER (PARTITION BY user_id ORDER BY moment, seq, turn_id NULLS FIRST
    ROWS UNBOUNDED PRECEDING) AS upto FROM both_rows),
gaps AS (SELECT turn_id, upto - 1 - last_value(CASE WHEN turn_id IS NULL THEN upto END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY moment, seq, turn_id NULLS FIRST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turns_since FROM counted)
SELECT t.turn_id, t.user_id, CASE WHEN s.activity = 'QUIZ_PENDING' THEN 'quiz_already_pending'
  WHEN p.check_gap IS NULL THEN 'quiz_appetite_off'
  WHEN c.score >= 0.85 AND c.score_confidence >= 0.3 THEN 'quiz_not_needed'
  WHEN g.turns_since < p.check_gap THEN 'quiz_rate_limited' END AS refused
FROM raw_turns t JOIN sessions s USING (session_id) JOIN reader_preferences p ON p.user_id = t.user_id
LEFT JOIN check_known c ON c.turn_id = t.turn_id
JOIN gaps g ON g.turn_id = t.turn_id""")
def i1(v):
    return I.gate(_requests(v), v.sessions, v.users, v.concepts, v.quizzes, v.concept_history)


_DRAFTS = """SELECT turn_id, CASE turn_id % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'tricky' WHEN 2 THEN 'hard'
  END AS difficulty FROM answers"""


@query("i2_check_grounding", f"""
SELECT d.turn_id, CASE WHEN difficulty IN ('easy', 'medium', 'hard') THEN difficulty ELSE 'medium' END
    AS difficulty, ids AS grounding, CASE WHEN ids IS NULL THEN 'quiz_no_grounding' END AS refused
FROM ({_DRAFTS}) d LEFT JOIN (SELECT turn_id, string_agg(CAST(chunk_id AS VARCHAR), ','
  ORDER BY rank_no) AS ids FROM retrieval_sets GROUP BY turn_id) s USING (turn_id)""")
def i2(v):
    out = I.ground(v.sql(_DRAFTS), v.retrieval_sets)
    return out.select("turn_id", "difficulty", F.array_join("grounding_chunk_ids", ",")
                      .alias("grounding"), "refused")


@query("i3_lexical_grading", """
SELECT attempt_id, coalesce(array_to_string(missing, ','), '') AS missing_elements,
  CASE WHEN rubric IS NULL OR len(rubric) = 0 THEN 'partial' WHEN len(missing) = 0 THEN 'correct'
    WHEN len(missing) = len(rubric) THEN 'incorrect' ELSE 'partial' END AS lexical_grade
FROM (SELECT attempt_id, must_mention AS rubric, [p FOR p IN must_mention
    IF NOT contains(lower(answer_text), lower(p))] AS missing
  FROM attempts JOIN (SELECT quiz_id, must_mention FROM quizzes) q USING (quiz_id)) z""")
def i3(v):
    rows = v.attempts.join(v.quizzes.select("quiz_id", "must_mention"), "quiz_id")
    return I.grade_lexically(rows).select(
        "attempt_id", F.array_join("missing_elements", ",").alias("missing_elements"),
        "lexical_grade")


@query("i4_grade_validation", """
SELECT attempt_id, grade, grading_error, md5(answer_text) AS answer FROM graded_attempts""")
def i4(v):
    return I.validate_grades(v.attempts).select(
        "attempt_id", "grade", "grading_error", F.md5("answer_text").alias("answer"))


@query("i5_attempt_numbers", """
SELECT attempt_id, CAST(row_number() OVER (PARTITION BY quiz_id ORDER BY created_at, attempt_id)
  AS INTEGER) AS attempt_no FROM attempts""")
def i5(v):
    return I.number_attempts(v.attempts).select("attempt_id", "attempt_no")


@query("i6_next_action", """
SELECT attempt_id, next_action, CASE WHEN next_action = 'revisit_prerequisite'
    THEN prerequisite_id END AS prerequisite_id,
  CASE WHEN next_action = 'move_forward' THEN 'FREE' ELSE 'EXPLAINING' END AS activity
FROM (SELECT g.attempt_id, w.prerequisite_id, CASE WHEN grade IS NULL OR grade = 'correct'
    THEN 'move_forward' WHEN grade = 'incorrect' AND w.prerequisite_id IS NOT NULL
    THEN 'revisit_prerequisite' ELSE 'explain_differently' END AS next_action
  FROM graded_attempts g JOIN quizzes z USING (quiz_id)
  LEFT JOIN weak_prereqs w ON w.concept_id = z.concept_id) q""")
def i6(v):
    weak = M.weak_prerequisite(v.concepts, v.edges, v.as_of())
    return I.next_actions(I.validate_grades(v.attempts), v.quizzes, weak).select(
        "attempt_id", "next_action", "prerequisite_id", "activity")


@query("i7_check_signals", """
SELECT g.attempt_id, g.user_id, z.concept_id, 'quiz_' || grade AS signal_type,
  'quiz' AS signal_source, CAST(1 AS DOUBLE) AS weight
FROM graded_attempts g JOIN quizzes z USING (quiz_id) WHERE grade IS NOT NULL""")
def i7(v):
    return I.check_signals(I.validate_grades(v.attempts), v.quizzes)
