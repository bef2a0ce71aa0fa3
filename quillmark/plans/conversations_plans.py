"""Section J queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import asof
from quillmark.operators import conversations as J
from quillmark.operators import memory as M
from quillmark.operators import retrieval as R
from quillmark.plans import callbacks_plans as CP
from quillmark.plans.common import i64, us
from quillmark.plans.learner_plans import known_at
from quillmark.plans.registry import query
from quillmark.plans.views import ORACLE_VIEWS

_EXCHANGES = """SELECT conv_id AS session_id, conv_id % (SELECT max(user_id) + 1 FROM events) AS user_id,
  conv_id * 1000 + turn AS turn_id, TIMESTAMP '2024-01-05 00:00:00' + INTERVAL '1' MINUTE * turn
    AS created_at, CASE WHEN conv_id % 10 = 9 THEN '  ' ELSE text END AS asked,
  CASE WHEN conv_id % 10 = 8 THEN repeat(text, 400) ELSE 'Reply: ' || text END AS answered
  FROM conversations WHERE role <> 'assistant'"""
_TOKENS = "CAST(least(32767, greatest(1, round_even(length({0}) / 4.0, 0))) AS INTEGER)"


@query("j1_append_exchange", f"""
WITH ex AS ({_EXCHANGES}),
good AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, turn_id) AS nth
  FROM ex WHERE trim(asked) <> '' AND trim(answered) <> '' AND length(asked) <= 32000
    AND length(answered) <= 32000),
top AS (SELECT session_id, max(ordinal) AS top FROM messages GROUP BY session_id)
SELECT session_id, turn_id, CAST(coalesce(top, -1) + 2 * (nth - 1) + step AS INTEGER) AS ordinal, role,
  md5(content) AS content, {_TOKENS.format('content')} AS token_count
FROM (SELECT *, 1 AS step, 'user' AS role, asked AS content FROM good
      UNION ALL SELECT *, 2, 'assistant', answered FROM good) g LEFT JOIN top USING (session_id)""")
def j1(v):
    rows, _ = J.append_exchanges(v.messages, v.sql(_EXCHANGES))
    return rows.select("session_id", "turn_id", "ordinal", "role",
                       F.md5("content").alias("content"), "token_count")


@query("j1_rejected_exchange", f"""
SELECT turn_id, CASE WHEN trim(asked) = '' THEN 'empty' ELSE 'too_long' END AS reject_reason
FROM ({_EXCHANGES}) x WHERE trim(asked) = '' OR length(answered) > 32000""")
def j1r(v):
    return J.append_exchanges(v.messages, v.sql(_EXCHANGES))[1]


@query("j2_context_window", f"""
SELECT session_id, ordinal, CAST(spent AS BIGINT) AS spent FROM (
  SELECT *, sum(cost) OVER w AS spent, row_number() OVER w AS rn
  FROM (SELECT *, {_TOKENS.format('content')} AS cost FROM messages) m
  WINDOW w AS (PARTITION BY session_id ORDER BY ordinal DESC ROWS UNBOUNDED PRECEDING)) q
WHERE spent <= 3000 OR rn = 1""")
def j2(v):
    return J.context_places(v.messages).select("session_id", "ordinal", i64("spent"))


@query("j3_transcript", """
SELECT session_id, ordinal, role, md5(content) AS content FROM messages""")
def j3(v):
    return J.transcript(v.messages).select(
        "session_id", "ordinal", "role", F.md5("content").alias("content"))


@query("j5_exchange_completeness", """
SELECT session_id, count(*) AS unanswered FROM messages m WHERE role = 'user' AND NOT EXISTS (
  SELECT 1 FROM messages n WHERE n.session_id = m.session_id AND n.ordinal = m.ordinal + 1
  AND n.role = 'assistant') GROUP BY session_id""")
def j5(v):
    return J.unanswered(v.messages)


@query("j6_session_listing", """
SELECT s.session_id, s.user_id, title, CAST(row_number() OVER (PARTITION BY s.user_id
  ORDER BY last_activity_at DESC, s.session_id DESC) AS INTEGER) AS place
FROM sessions s LEFT JOIN papers p ON p.paper_id = s.active_paper_id""")
def j6(v):
    return J.session_listing(v.sessions, v.papers).select(
        "session_id", "user_id", "title", F.col("place").cast("int").alias("place"))


@query("j7_paper_listing", """
SELECT a.user_id, a.paper_id, processing_status, row_number() OVER (PARTITION BY a.user_id
  ORDER BY last_opened_at DESC NULLS LAST, a.paper_id DESC) AS place
FROM user_paper_access a JOIN papers p USING (paper_id) WHERE revoked_at IS NULL""")
def j7(v):
    return J.paper_listing(v.user_paper_access, v.papers).select(
        "user_id", "paper_id", "processing_status", i64("place"))


_ANSWER_TURNS = """SELECT turn_id, session_id, CAST(turn_id % 1000 AS INT) AS ordinal, draft
  FROM answers"""


@query("j8_last_turn", f"""
SELECT session_id, turn_id, ids AS retrieved FROM (SELECT session_id, max(turn_id) AS turn_id
  FROM ({_ANSWER_TURNS}) t GROUP BY session_id) l LEFT JOIN (SELECT turn_id,
    string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank_no) AS ids FROM retrieval_sets
  GROUP BY turn_id) r USING (turn_id)""")
def j8(v):
    out = J.last_turns(v.sql(_ANSWER_TURNS), v.retrieval_sets)
    return out.select("session_id", "turn_id", F.array_join(
        F.transform("retrievals", lambda r: r["chunk_id"]), ",").alias("retrieved"))


def _refusals() -> str:
    return "CASE error_code " + " ".join(
        f"WHEN '{k}' THEN '{r}'" for k, r in J.REFUSALS.items()) + " ELSE 'it could not be processed' END"


@query("j9_turn_routing", f"""
SELECT turn_id, route, CASE WHEN route = 'refuse' THEN CASE WHEN processing_status = 'failed'
  THEN {_refusals()} ELSE 'still processing' END END AS reason
FROM (SELECT t.turn_id, p.processing_status, p.error_code,
    CASE WHEN s.activity = 'QUIZ_PENDING' THEN 'grade_quiz'
      WHEN a.user_id IS NOT NULL AND p.processing_status NOT IN ('ready', 'partially_ready')
      THEN 'refuse' ELSE 'answer' END AS route
  FROM raw_turns t JOIN sessions s USING (session_id)
  LEFT JOIN user_paper_access a ON a.user_id = t.user_id AND a.paper_id = s.active_paper_id
    AND a.revoked_at IS NULL
  LEFT JOIN papers p ON p.paper_id = s.active_paper_id) q""")
def j9(v):
    requests = v.raw_turns.select("turn_id", "session_id", "user_id")
    return J.route_turns(requests, v.sessions, v.papers, R.scope(v.user_paper_access)).select(
        "turn_id", "route", "reason")


@query("j10_session_counters", """
SELECT session_id, CAST(max(ordinal) + 1 AS INTEGER) AS turn_count,
  epoch_us(max(created_at)) AS last_activity_at FROM turns GROUP BY session_id""")
def j10(v):
    return J.session_counters(v.turns).select("session_id", "turn_count", us("last_activity_at"))


ORACLE_VIEWS["hits_known"] = known_at("""
  SELECT h.turn_id, h.concept_id, t.created_at AS moment FROM memory_hits h
  JOIN (SELECT turn_id, created_at FROM raw_turns) t USING (turn_id)""", "turn_id")
_CONTEXT_REQUESTS = """SELECT turn_id, user_id, turn_id % (SELECT max(conv_id) + 1 FROM conversations)
  AS session_id, paper_id, created_at FROM raw_turns WHERE agent_action IN ('answer', 'callback')"""


@query("j11_context_assembly", f"""
WITH w AS (SELECT *, sum(cost) OVER x AS spent, row_number() OVER x AS rn
  FROM (SELECT r.turn_id, m.*, {_TOKENS.format('content')} AS cost FROM ({_CONTEXT_REQUESTS}) r
    JOIN messages m ON m.session_id = r.session_id AND m.created_at < r.created_at) m
  WINDOW x AS (PARTITION BY turn_id ORDER BY created_at DESC, ordinal DESC ROWS UNBOUNDED PRECEDING)),
hist AS (SELECT turn_id, md5(string_agg(CAST(ordinal AS VARCHAR) || ':' || CASE WHEN role = 'assistant'
    THEN 'model' ELSE 'user' END || ':' || CASE WHEN role = 'summary'
    THEN 'Summary of earlier turns: ' ELSE '' END || content, '|' ORDER BY created_at, ordinal)) AS history
  FROM w WHERE spent <= 3000 OR rn = 1 GROUP BY turn_id),
rel AS (SELECT *, row_number() OVER (PARTITION BY turn_id, concept_id ORDER BY confidence DESC, far,
    relationship_type) AS rn
  FROM (SELECT h.turn_id, h.concept_id, g.far, g.relationship_type, g.confidence FROM memory_hits h
        JOIN graph g ON g.user_id = h.user_id AND g.near = h.concept_id) r),
near AS (SELECT turn_id, concept_id, string_agg(CAST(far AS VARCHAR), '+' ORDER BY rn) AS near FROM rel
  WHERE rn <= 3 GROUP BY 1, 2),
mem AS (SELECT h.turn_id, string_agg(CAST(h.concept_id AS VARCHAR) || '='
    || coalesce(CAST(CAST(round(coalesce(k.score, c.user_override_score), 4) AS DECIMAL(9, 4)) AS VARCHAR), '?')
    || '>' || coalesce(near, ''), ','
    ORDER BY rank_no) AS memory
  FROM memory_hits h JOIN live_concepts c ON c.concept_id = h.concept_id
  LEFT JOIN hits_known k ON k.turn_id = h.turn_id AND k.concept_id = h.concept_id
  LEFT JOIN near n ON n.turn_id = h.turn_id AND n.concept_id = h.concept_id GROUP BY h.turn_id)
SELECT q.turn_id, history, memory, d.suppressed_reason, d.concept_id AS callback_concept_id,
  d.effective_style, p.depth, p.preferred_style, title
FROM ({_CONTEXT_REQUESTS}) q LEFT JOIN hist USING (turn_id) LEFT JOIN mem USING (turn_id)
LEFT JOIN decisions d ON d.turn_id = q.turn_id JOIN reader_preferences p ON p.user_id = q.user_id
LEFT JOIN papers USING (paper_id)""")
def j11(v):
    """Context rows for every answered turn."""
    requests = v.sql(_CONTEXT_REQUESTS)
    h = CP.hits(v).join(requests.select("turn_id"), "turn_id", "left_semi")
    # a concept's neighbours are the same for every turn that hits it
    roots = M.live(v.concepts).select(F.col("concept_id").alias("call_id"), "user_id", "concept_id")
    related = M.neighbours(roots, v.edges, v.concepts).select(
        "user_id", F.col("near").alias("concept_id"),
        F.col("far").alias("related_id"), "relationship_type",
        F.col("confidence").alias("edge_confidence"))
    prefs = CP.H.preferences(v.users).select("user_id", "depth", "preferred_style")
    decisions = v.decisions.drop("user_id").withColumnRenamed("concept_id", "callback_concept_id")
    timed = h.join(M.live(v.concepts).select("concept_id"), "concept_id", "left_semi").join(
        v.turns.select("turn_id", F.col("created_at").alias("at")), "turn_id")
    memory = asof.scored_at(timed, v.concept_history, v.concepts)
    out = J.context_rows(requests, v.messages, memory,
                         related, decisions, prefs, v.papers)
    line = lambda m: F.concat(
        m["ordinal"].cast("string"), F.lit(":"), m["speaker"], F.lit(":"), m["content"])
    record = lambda m: F.concat(
        m["concept_id"].cast("string"), F.lit("="), F.coalesce(F.round(m["score"], 4).cast("decimal(9,4)").cast("string"), F.lit("?")),
        F.lit(">"), F.array_join(F.transform(F.coalesce(
            m["near"], F.array()), lambda x: x["related_id"]), "+"))
    return out.select(
        "turn_id", F.md5(F.array_join(F.transform("history", line), "|")).alias("history"),
        F.array_join(F.transform("memory", record), ",").alias("memory"), "suppressed_reason",
        "callback_concept_id", "effective_style", "depth", "preferred_style", "title")
