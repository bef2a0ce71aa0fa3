"""Domain tables derived from the given Parquet tables.

The given tables hold documents, events, vectors and chats; the jobs need
papers, grants, turns, concepts and so on. Each view below says how one is
derived. Most are one SELECT that Spark and DuckDB both run (``<<...>>`` marks
the few spellings that differ); the ones that need a job are built with the
operators on the Spark side and spelled out in SQL for the comparison.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark import vocab as V
from quillmark.functions.shared import store

AS_OF = "2024-02-01 00:00:00"
BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
ACTIVE_MODEL = "embed-active"
DIM = 64

_SPARK = {
    "sha256": "sha2({0}, 256)",
    "div": "({0} div {1})",
    "ts": "TIMESTAMP_NTZ '{0}'",
    "arr": "array({0})",
    "explode": "explode(array({0}))",
    "bytes": "CAST({0} AS BINARY)",
    "at": "element_at({0}, CAST({1} AS INT))",
    "none": "CAST(array() AS ARRAY<BIGINT>)",
}
_DUCK = {
    "sha256": "sha256({0})",
    "div": "({0} // {1})",
    "ts": "TIMESTAMP '{0}'",
    "arr": "[{0}]",
    "explode": "unnest([{0}])",
    "bytes": "encode({0})",
    "at": "list_extract({0}, CAST({1} AS INTEGER))",
    "none": "CAST([] AS BIGINT[])",
}


def dialect(sql: str, table: dict[str, str]) -> str:
    def swap(m: re.Match) -> str:
        return table[m.group(1)].format(*re.split(r"(?<!\|)\|(?!\|)", m.group(2)))

    previous = None
    while previous != sql:
        previous, sql = sql, re.sub(r"<<(\w+) ((?:(?!<<|>>).)*)>>", swap, sql, flags=re.S)
    return sql


def words(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_ROLES = words(
    ("abstract", "introduction", "related_work", "method", "experiments", "results",
     "discussion", "conclusion", "appendix", "references")
)
_STYLES = words(V.EXPLANATION_STYLE)

SHARED: dict[str, str] = {}
SPARK_SQL: dict[str, str] = {}
DUCK_SQL: dict[str, str] = {}
BUILDERS: dict[str, Callable[["Views"], DataFrame]] = {}

SHARED["papers"] = f"""
SELECT doc_id AS paper_id, <<sha256 text>> AS content_hash,
  'paper ' || CAST(doc_id AS STRING) AS title,
  CASE doc_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'partially_ready' WHEN 2 THEN 'queued'
       ELSE 'ready' END AS processing_status,
  CASE WHEN doc_id % 10 = 2 THEN 'embed' END AS processing_phase,
  CASE WHEN doc_id % 20 = 0 THEN 'pdf_corrupt' WHEN doc_id % 10 = 0 THEN 'no_chunks' END
    AS error_code,
  CASE doc_id % 7 WHEN 0 THEN 'embed-old' WHEN 1 THEN NULL ELSE '{ACTIVE_MODEL}' END
    AS embedding_model,
  CAST(1880 + doc_id % 250 AS INT) AS year, CAST(doc_id % 12 AS INT) AS page_count,
  CAST(doc_id % 100 AS DOUBLE) / 90 AS extractable_text_ratio,
  <<ts 2024-01-01 00:00:00>> + INTERVAL '1' MINUTE * (doc_id % 5000) AS created_at,
  <<ts 2024-01-31 23:50:00>> + INTERVAL '1' MINUTE * (doc_id % 10) AS updated_at
FROM documents"""

SHARED["doc_count"] = "SELECT count(*) AS n FROM documents"

SHARED["user_paper_access"] = """
SELECT user_id, paper_id, min(ts) AS added_at,
  CASE WHEN (paper_id + user_id) % 3 <> 0 THEN max(ts) END AS last_opened_at,
  CASE WHEN (paper_id + user_id) % 7 = 0 THEN max(ts) END AS revoked_at
FROM (
  SELECT user_id, ts,
    <<explode (b % n), ((b + 1) % n), ((b + 2) % n), ((b + 3) % n), ((b + 4) % n)>> AS paper_id
  FROM (SELECT user_id, ts, event_id * 5 AS b, (SELECT max(n) FROM doc_count) AS n FROM events) q
) g GROUP BY user_id, paper_id"""

SHARED["chunks"] = f"""
SELECT vec_id AS chunk_id, vec_id % m AS paper_id, (vec_id % m) * 10 + label AS section_id,
  CAST(<<div vec_id|m>> AS INT) AS ordinal,
  'passage ' || CAST(vec_id AS STRING) AS content,
  md5(CAST(<<div vec_id|3>> AS STRING)) AS content_hash,
  CAST(1 + vec_id % 400 AS INT) AS token_count,
  CAST(1 + label AS INT) AS page_start, CAST(1 + label + vec_id % 3 AS INT) AS page_end,
  CASE WHEN vec_id % 53 <> 0 THEN embedding END AS embedding,
  label <> 9 AS is_indexable,
  <<at <<arr {_ROLES}>>|label + 1>> AS section_role
FROM (SELECT e.*, (SELECT greatest(1, <<div max(n)|20>>) FROM doc_count) AS m
      FROM embeddings e) q"""

SHARED["sections"] = """
SELECT section_id, max(paper_id) AS paper_id, CAST(section_id % 10 AS INT) AS ordinal,
  CAST(section_id % 10 + 1 AS STRING) || '.' || CAST(max(paper_id) % 4 AS STRING) AS section_path,
  max(section_role) AS section_role, min(page_start) AS page_start, max(page_end) AS page_end
FROM chunks GROUP BY section_id"""

SHARED["queries"] = f"""
SELECT e.vec_id AS query_id, v.user_id, v.ts AS asked_at, e.embedding AS query_vector,
  'query ' || CAST(e.vec_id AS STRING) AS query_text,
  CASE WHEN e.vec_id % 4 = 0 THEN <<at <<arr {_ROLES}>>|1 + (e.vec_id % 10)>>
       WHEN e.vec_id % 4 = 1 THEN 'no such role' END AS section_role,
  CAST(CASE WHEN e.vec_id % 3 = 0 THEN 5 WHEN e.vec_id % 3 = 1 THEN 40 END AS INT) AS top_k,
  CAST(CASE WHEN e.vec_id % 5 = 0 THEN 0.3 END AS DOUBLE) AS floor_arg
FROM embeddings e JOIN events v ON v.event_id = e.vec_id"""

SHARED["signals"] = f"""
SELECT event_id AS observation_id, user_id, user_id * 12 + event_id % 12 AS concept_id,
  event_id AS turn_id, ts AS observed_at,
  CASE event_type WHEN 'error' THEN 'explicit_confusion' WHEN 'view' THEN 'implicit_confusion'
    WHEN 'click' THEN CASE WHEN event_id % 5 = 0 THEN 'applied_correctly' ELSE 'reinforcement' END
    WHEN 'purchase' THEN CASE WHEN (user_id + event_id % 12) % 4 = 0 THEN 'user_stated_unknown'
                              ELSE 'explicit_understanding' END
    ELSE CASE WHEN (user_id + event_id % 12) % 4 = 0 THEN 'quiz_incorrect'
              ELSE 'quiz_correct' END END AS signal_type,
  <<at <<arr {_STYLES}>>|1 + (floor(value) % 7)>> AS style_in_play,
  CASE WHEN event_id % 3 = 0 THEN 'note ' || CAST(event_id AS STRING) END AS note
FROM events"""

SHARED["users"] = """
SELECT DISTINCT user_id, translate(
  '<"personalization_enabled":' || CASE WHEN user_id % 11 = 3 THEN 'false' ELSE 'true' END
  || CASE user_id % 6 WHEN 0 THEN ',"proactivity":"off"' WHEN 1 THEN ',"proactivity":"low"'
       WHEN 2 THEN ',"proactivity":"normal"' WHEN 3 THEN ',"proactivity":"high"'
       WHEN 4 THEN ',"proactivity":"loud"' ELSE '' END
  || CASE user_id % 5 WHEN 0 THEN ',"quiz_appetite":"off"' WHEN 1 THEN ',"quiz_appetite":"low"'
       WHEN 2 THEN ',"quiz_appetite":"high"' ELSE '' END
  || CASE user_id % 4 WHEN 0 THEN ',"depth":"expert"' WHEN 1 THEN ',"depth":"bogus"' ELSE '' END
  || CASE user_id % 3 WHEN 0 THEN ',"preferred_style":"code"' ELSE '' END
  || '>', '<>', chr(123) || chr(125)) AS preferences
FROM events"""

_TURN_COLUMNS = f"""
  event_id AS turn_id, user_id, user_id * 4 + event_id % 4 AS session_id,
  (event_id * 5) % n AS paper_id,
  CASE WHEN event_id % 10 = 9 THEN 'grade_quiz' WHEN event_id % 10 = 8 THEN 'refuse'
       WHEN event_id % 17 = 0 THEN 'callback' ELSE 'answer' END AS agent_action,
  CASE WHEN event_id % 17 = 0 AND event_id % 10 < 8 THEN user_id * 12 + (event_id + 1) % 12 END
    AS callback_concept_id,
  CASE WHEN event_id % 10 >= 8 OR event_id % 17 = 0 THEN NULL
       WHEN event_id % 3 = 0 THEN 'no_weak_candidate' WHEN event_id % 3 = 1 THEN 'rate_limited'
       ELSE 'no_memory' END AS callback_suppressed_reason,
  event_id % 17 = 0 OR event_id % 3 <> 2 AS memory_read,
  CASE WHEN event_id % 10 >= 8 THEN 'n/a' WHEN event_id % 4 = 1 THEN 'degraded'
       WHEN event_id % 4 = 2 THEN 'no_evidence' ELSE 'grounded' END AS grounding_status,
  CASE WHEN event_id % 17 = 0 THEN <<at <<arr {_STYLES}>>|1 + (event_id % 7)>> END
    AS explanation_style,
  CASE event_type
    WHEN 'purchase' THEN <<arr 'retrieve_paper_context', 'record_learning_signal'>>
    WHEN 'click' THEN <<arr 'retrieve_paper_context'>>
    WHEN 'error' THEN <<arr 'retrieve_paper_context', 'retrieve_paper_context', 'retrieve_learner_memory'>>
    WHEN 'signup' THEN <<arr 'retrieve_learner_memory', 'retrieve_paper_context', 'propose_check', 'retrieve_paper_context', 'record_learning_signal'>>
    END AS tools_called,
  CAST(event_id % 900 AS INT) AS input_tokens, CAST(event_id % 300 AS INT) AS output_tokens,
  CAST(floor(value * 10) AS INT) AS latency_ms,
  CASE WHEN event_id % 29 = 0 THEN 'model_timeout' END AS error_code, ts AS created_at
FROM (SELECT *, (SELECT max(n) FROM doc_count) AS n FROM events) q"""
SHARED["raw_turns"] = "SELECT" + _TURN_COLUMNS
DUCK_SQL["turns"] = """
SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY created_at, turn_id) - 1
  AS INT) AS ordinal FROM raw_turns"""

SHARED["sessions"] = """
SELECT session_id, max(user_id) AS user_id,
  CASE WHEN session_id % 6 <> 5 THEN max(paper_id) END AS active_paper_id,
  CASE session_id % 5 WHEN 0 THEN 'QUIZ_PENDING' WHEN 1 THEN 'EXPLAINING' ELSE 'FREE' END
    AS activity,
  CASE WHEN session_id % 5 = 0 THEN session_id END AS pending_quiz_id,
  CAST(count(*) AS INT) AS turn_count, min(created_at) AS started_at,
  max(created_at) AS last_activity_at
FROM raw_turns GROUP BY session_id"""

SHARED["messages"] = """
SELECT conv_id * 1000 + turn AS message_id, conv_id AS session_id, conv_id % u AS user_id,
  CAST(turn AS INT) AS ordinal, CASE role WHEN 'system' THEN 'summary' ELSE role END AS role,
  text AS content,
  <<ts 2023-12-01 00:00:00>> + INTERVAL '1' DAY * (conv_id % 60) + INTERVAL '1' MINUTE * turn
    AS created_at
FROM (SELECT c.*, (SELECT max(user_id) + 1 FROM events) AS u FROM conversations c) q"""

SHARED["feedback"] = f"""
SELECT event_id AS feedback_id, user_id, ts AS created_at,
  CASE event_id % 7 WHEN 0 THEN 'helpful' WHEN 1 THEN 'not_helpful' WHEN 2 THEN 'too_basic'
    WHEN 3 THEN 'too_advanced' WHEN 4 THEN 'wrong' WHEN 5 THEN 'style_preference'
    ELSE 'shrug' END AS feedback_type,
  CASE WHEN event_id % 3 <> 0 THEN event_id - event_id % 50 END AS target_turn_id,
  CASE WHEN event_id % 3 = 0 OR event_id % 41 = 0 THEN user_id * 12 + event_id % 12 END
    AS target_concept_id,
  CASE WHEN event_id % 4 = 0 THEN '  ' WHEN event_id % 4 = 1 THEN ' said ' || props END AS comment,
  CASE WHEN event_id % 9 <> 0 THEN <<at <<arr {_STYLES}>>|1 + (event_id % 7)>>
       ELSE 'loud' END AS preferred_style
FROM events WHERE event_type <> 'view'"""

SHARED["edges"] = """
SELECT user_id, source_concept_id, target_concept_id, relationship_type,
  min(relationship_id) AS relationship_id,
  0.5 + CAST(min(relationship_id) % 50 AS DOUBLE) / 100 AS confidence
FROM (
  SELECT event_id AS relationship_id, user_id, user_id * 12 + event_id % 12 AS source_concept_id,
    user_id * 12 + <<div event_id|12>> % 12 AS target_concept_id,
    <<at <<arr 'prerequisite_of', 'component_of', 'specialisation_of', 'contrasts_with', 'equivalent_notation', 'co_occurs_with'>>|1 + (event_id + <<div event_id|144>>) % 6>> AS relationship_type
  FROM events) q
WHERE source_concept_id <> target_concept_id
GROUP BY user_id, source_concept_id, target_concept_id, relationship_type"""

SHARED["answers"] = """
SELECT conv_id * 1000 + turn AS turn_id, conv_id AS session_id,
  CASE WHEN conv_id % 37 = 1 THEN '  ' ELSE
    text || ' [' || CAST(turn % 9 AS STRING) || '] , and [' || CAST(turn % 4 + 1 AS STRING) || '].'
    || CASE WHEN conv_id % 5 = 4 THEN ' See [01]  and [[17]9] .' ELSE '' END
    || CASE WHEN conv_id % 6 = 0 THEN ' [' || CAST(turn % 9 AS STRING) || ']' ELSE '' END
  END AS draft
FROM conversations WHERE role = 'assistant' AND conv_id % 11 <> 7
UNION ALL
SELECT conv_id * 1000 + turn, conv_id, text FROM conversations
WHERE role = 'assistant' AND conv_id % 11 = 7"""

SHARED["retrieval_sets"] = """
SELECT turn_id, rank_no, (turn_id * 7 + rank_no * 3) % v AS chunk_id,
  CAST(1.0 - 0.1 * rank_no AS DOUBLE) AS similarity
FROM (
  SELECT conv_id, conv_id * 1000 + turn AS turn_id, <<explode 1, 2, 3, 4>> AS rank_no,
    (SELECT max(vec_id) + 1 FROM embeddings) AS v
  FROM conversations WHERE role = 'assistant') q
WHERE rank_no <= conv_id % 5"""

SHARED["files"] = """
SELECT 'doc/' || CAST(doc_id AS STRING) AS path,
  <<bytes CASE doc_id % 10 WHEN 0 THEN text WHEN 1 THEN '' ELSE '%PDF-1.7 ' || text END>> AS content,
  CAST(CASE WHEN doc_id % 4 > 0 THEN doc_id % 250 + 1 END AS INT) AS page_count
FROM documents
UNION ALL
SELECT 'page/' || CAST(page_id AS STRING), <<bytes '%PDF-1.4 ' || html>>, CAST(3 AS INT)
FROM pages"""

SHARED["known_papers"] = """
SELECT content_hash, min(doc_id) AS paper_id,
  CASE min(doc_id) % 4 WHEN 0 THEN 'failed' ELSE 'ready' END AS processing_status
FROM (SELECT doc_id, <<sha256 <<bytes '%PDF-1.7 ' || text>>>> AS content_hash
      FROM documents WHERE source <> 'src0') q GROUP BY content_hash"""

SHARED["grant_events"] = """
SELECT user_id, (event_id * 3) % (SELECT max(n) FROM doc_count) AS paper_id,
  CASE WHEN event_type IN ('error', 'view') THEN 'revoke' ELSE 'grant' END AS kind,
  ts AS happened_at, event_id FROM events"""

SHARED["quizzes"] = """
SELECT conv_id AS quiz_id, user_id, user_id * 12 + conv_id % 12 AS concept_id,
  (conv_id * 5) % n AS paper_id,
  CASE conv_id % 5 WHEN 1 THEN <<arr 'the', 'of'>> WHEN 2 THEN <<arr 'und', 'Que', 'the'>>
    WHEN 3 THEN <<arr 'zzz'>> WHEN 4 THEN <<arr 'E', 'n', 'zzz'>> END AS must_mention,
  CASE conv_id % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'hard' WHEN 2 THEN 'brutal' END AS difficulty,
  <<ts 2024-01-01 00:00:00>> + INTERVAL '1' DAY * (conv_id % 30)
    + INTERVAL '1' MINUTE * (conv_id % 1440) AS created_at
FROM (SELECT DISTINCT conv_id, conv_id % (SELECT max(user_id) + 1 FROM events) AS user_id,
        (SELECT max(n) FROM doc_count) AS n FROM conversations) q"""

SHARED["attempts"] = """
SELECT conv_id * 1000 + turn AS attempt_id, conv_id AS quiz_id, conv_id % u AS user_id,
  CASE WHEN turn % 4 = 2 THEN '  ' ELSE text END AS answer_text,
  CASE (conv_id + turn) % 7 WHEN 5 THEN 'superb' WHEN 6 THEN NULL WHEN 0 THEN 'correct'
    WHEN 1 THEN 'partial' ELSE 'incorrect' END AS returned_grade,
  <<ts 2024-01-01 00:00:00>> + INTERVAL '1' DAY * (conv_id % 30) + INTERVAL '1' MINUTE * turn
    AS created_at
FROM (SELECT c.*, (SELECT max(user_id) + 1 FROM events) AS u FROM conversations c) q
WHERE role = 'user'"""

# Whole stored tables with every reference and checked column, some of them broken on purpose.
SHARED["full_users"] = """
SELECT user_id, 'sub-' || CAST(CASE WHEN user_id % 40 = 39 THEN user_id - 1 ELSE user_id END AS STRING)
    AS auth_subject,
  CASE WHEN user_id % 3 = 0 THEN 'reader' || CAST(user_id % 600 AS STRING) || '@mail' END AS email,
  preferences FROM users"""
SHARED["full_sessions"] = """
SELECT s.*, CASE WHEN session_id % 101 = 0 THEN -1 WHEN session_id % 3 = 0
    THEN user_id * 12 + session_id % 12 END AS active_concept_id FROM sessions s"""
SHARED["full_messages"] = """
SELECT m.*, CASE WHEN ordinal % 5 <> 4 THEN CAST(length(content) % 97 AS INT) END AS token_count,
  CASE WHEN role = 'assistant' THEN message_id WHEN ordinal % 7 = 3 THEN -message_id END AS turn_id
FROM messages m"""
SHARED["full_retrievals"] = """
SELECT turn_id, chunk_id, CAST(rank_no AS INT) AS rank, similarity, rank_no % 2 = 1 AS was_cited,
  CASE WHEN rank_no % 2 = 1 AND turn_id % 13 <> 0 THEN '[' || CAST(rank_no AS STRING) || ']' END
    AS citation_marker FROM retrieval_sets"""
SHARED["full_edges"] = """
SELECT e.*, CASE relationship_id % 4 WHEN 0 THEN 'embedding' WHEN 1 THEN 'model' WHEN 2 THEN 'user_stated'
    ELSE 'guess' END AS discovery_method,
  CASE WHEN relationship_id % 2 = 0 THEN relationship_id END AS evidence_turn_id FROM edges e"""
SHARED["full_quizzes"] = """
SELECT q.*, CASE WHEN quiz_id % 9 <> 4 THEN <<arr quiz_id % 7>> ELSE <<none >> END AS grounding_chunk_ids
FROM quizzes q"""
SHARED["full_attempts"] = """
SELECT attempt_id, quiz_id, user_id, CASE WHEN attempt_id % 3 = 0 THEN attempt_id + 1 END AS turn_id,
  answer_text, returned_grade AS grade,
  CASE WHEN returned_grade IS NULL OR attempt_id % 17 = 0 THEN 'model_timeout' END AS grading_error,
  CAST(attempt_id % 110 AS DOUBLE) / 100 AS grader_confidence,
  CAST(attempt_id % 1000 - attempt_id % 3 AS INT) AS attempt_no, created_at FROM attempts"""
SHARED["full_observations"] = """
SELECT o.*, user_id * 4 + observation_id % 5 AS session_id,
  CASE WHEN signal_type IN ('quiz_correct', 'quiz_incorrect') THEN observation_id * 1000 END
    AS quiz_attempt_id FROM observations o"""
SHARED["full_feedback"] = """
SELECT f.*, CASE WHEN feedback_id % 4 = 1 THEN feedback_id + 3 END AS applied_to_turn_id FROM feedback f"""
SHARED["turn_ids"] = "SELECT turn_id FROM raw_turns UNION SELECT turn_id FROM answers"
SHARED["merge_chains"] = """
SELECT event_id AS concept_id, CASE WHEN event_id % 40 <> 39 AND event_id + 1 <= (SELECT max(event_id) FROM events)
    THEN event_id + 1 END AS merged_into_id FROM events"""

SPARK_SQL["doc_pages"] = """
SELECT doc_id AS paper_id, CAST(p + 1 AS INT) AS page_no, body AS text FROM (
  SELECT doc_id, posexplode(array(
    concat('Abstract', chr(10), substr(text, 1, t), chr(10), '1', chr(10), 'Introduction', chr(10),
           substr(text, t + 1, t)),
    concat('2.1 Our Method', chr(10), substr(text, 2 * t + 1, t), chr(10), 'IV. Results', chr(10),
           '3 x = y + 2', chr(10), source),
    concat(substr(text, 3 * t + 1), chr(10), 'References', chr(10), lang, ' ', source)
  )) AS (p, body)
  FROM (SELECT *, CAST(length(text) div 4 AS INT) AS t FROM documents) q) z"""
DUCK_SQL["doc_pages"] = """
SELECT doc_id AS paper_id, CAST(p AS INT) AS page_no, body AS text FROM (
  SELECT doc_id, generate_subscripts(bodies, 1) AS p, unnest(bodies) AS body FROM (
  SELECT doc_id, [
    concat('Abstract', chr(10), substr(text, 1, t), chr(10), '1', chr(10), 'Introduction', chr(10),
           substr(text, t + 1, t)),
    concat('2.1 Our Method', chr(10), substr(text, 2 * t + 1, t), chr(10), 'IV. Results', chr(10),
           '3 x = y + 2', chr(10), source),
    concat(substr(text, 3 * t + 1), chr(10), 'References', chr(10), lang, ' ', source)
  ] AS bodies
  FROM (SELECT *, CAST(length(text) // 4 AS INT) AS t FROM documents) q)) z"""

_RUN = r"<[a-zA-Z0-9/!][^>]*>[^<]+"
_SPAN_COLUMNS = r"""
SELECT <<div page_id|3>> AS paper_id, CAST(page_id % 3 + 1 AS INT) AS page_no, page_id,
  600.0D AS page_width, 800.0D AS page_height,
  CAST(<<div i|4>> AS INT) AS block_id, CAST(CASE WHEN <<div i|4>> % 9 = 8 THEN 1 ELSE 0 END AS INT)
    AS block_type,
  CASE WHEN page_id % 2 = 0 THEN CAST((<<div i|4>> % 2) * 310 + 20 AS DOUBLE) ELSE 20.0D END AS bx0,
  CAST(<<div i|4>> * 10 AS DOUBLE) + (i % 4) * 0.0D AS by0,
  CASE WHEN page_id % 2 = 0 THEN CAST((<<div i|4>> % 2) * 310 + 270 AS DOUBLE) ELSE 580.0D END AS bx1,
  CAST(<<div i|4>> * 10 + 9 AS DOUBLE) AS by1,
  CAST(<<div i|2>> % 2 AS INT) AS line_no, CAST(i % 2 AS INT) AS span_no, body AS text,
  CASE tag WHEN 'h1' THEN 18.0D WHEN 'b' THEN 11.0D WHEN 'script' THEN 2.0D WHEN 'style' THEN 3.0D
    WHEN 'a' THEN 9.0D ELSE 10.0D END AS size,
  CAST(CASE WHEN tag = 'b' THEN 20 ELSE 4 END AS INT) AS flags,
  CAST(CASE WHEN i % 17 = 16 THEN 16777215 WHEN i % 19 = 18 THEN 16711680 ELSE 1315860 END AS INT)
    AS color,
  CAST(CASE WHEN i % 23 = 22 THEN 3 ELSE 0 END AS INT) AS render_mode,
  CASE WHEN i % 29 = 28 THEN -90.0D ELSE 30.0D END AS sx0,
  CAST(<<div i|4>> * 10 AS DOUBLE) AS sy0,
  CASE WHEN i % 29 = 28 THEN -10.0D WHEN i % 31 = 30 THEN 30.0D ELSE 90.0D END AS sx1,
  CAST(<<div i|4>> * 10 + 9 AS DOUBLE) AS sy1
FROM runs"""
SPARK_SQL["spans"] = rf"""
WITH runs AS (
  SELECT page_id, CAST(i AS BIGINT) AS i,
    lower(regexp_extract(m, r'^<([a-zA-Z0-9]*)', 1)) AS tag,
    regexp_replace(m, r'^<[^>]*>', '') AS body
  FROM (SELECT page_id, posexplode(regexp_extract_all(html, r'{_RUN}', 0)) AS (i, m) FROM pages) q)
{_SPAN_COLUMNS}"""
DUCK_SQL["spans"] = rf"""
WITH runs AS (
  SELECT page_id, CAST(i - 1 AS BIGINT) AS i,
    lower(regexp_extract(m, '^<([a-zA-Z0-9]*)', 1)) AS tag,
    regexp_replace(m, '^<[^>]*>', '') AS body
  FROM (SELECT page_id, generate_subscripts(ms, 1) AS i, unnest(ms) AS m FROM
    (SELECT page_id, regexp_extract_all(html, '{_RUN}') AS ms FROM pages) z) q)
{_SPAN_COLUMNS.replace('.0D', '.0::DOUBLE')}"""

# --- evidence with source, weight and pairing (E2, E3, E5 in SQL) ----------
DUCK_SQL["paired"] = f"""
WITH steps AS (
  SELECT observation_id, user_id, concept_id, observed_at,
    CASE WHEN signal_type IN ({words(V.STRUGGLES)}) THEN 1
         WHEN signal_type IN ({words(V.RESOLVING)}) THEN -1 ELSE 0 END AS d FROM signals),
s1 AS (SELECT *, sum(d) OVER w AS s FROM steps WHERE d <> 0
  WINDOW w AS (PARTITION BY user_id, concept_id ORDER BY observed_at, observation_id
               ROWS UNBOUNDED PRECEDING)),
s2 AS (SELECT *, least(0, min(s) OVER w) AS low,
    least(0, coalesce(min(s) OVER w2, 0)) AS low_before FROM s1
  WINDOW w AS (PARTITION BY user_id, concept_id ORDER BY observed_at, observation_id
               ROWS UNBOUNDED PRECEDING),
    w2 AS (PARTITION BY user_id, concept_id ORDER BY observed_at, observation_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, CASE WHEN d = 1 THEN s - low ELSE s - low + 1 END AS lvl FROM s2
       WHERE d = 1 OR s >= low_before),
s4 AS (SELECT *, lag(CASE WHEN d = 1 THEN observation_id END) OVER
    (PARTITION BY user_id, concept_id, lvl ORDER BY observed_at, observation_id) AS partner FROM s3)
SELECT observation_id, partner AS resolves_observation_id FROM s4
WHERE d = -1 AND partner IS NOT NULL"""

_SOURCE_CASE = "CASE signal_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in V.SOURCE_OF_SIGNAL.items()
) + " ELSE 'implicit' END"
_WEIGHT_CASE = (
    "CASE WHEN signal_type = 'applied_correctly' AND signal_source = 'implicit' THEN 0.75 "
    + " ".join(f"WHEN signal_source = '{k}' THEN {v}" for k, v in V.WEIGHT_OF_SOURCE.items())
    + " ELSE 0.4 END"
)
_TARGET_CASE = (
    "CASE WHEN resolves_observation_id IS NOT NULL AND signal_type IN "
    f"({words(V.ASSISTED_SIGNALS)}) THEN 0.7 "
    + " ".join(f"WHEN signal_type = '{k}' THEN {v}" for k, v in V.TARGET_OF_SIGNAL.items())
    + " ELSE 0.5 END"
)
DUCK_SQL["observations"] = f"""
SELECT *, CAST({_WEIGHT_CASE} AS DOUBLE) AS weight, CAST({_TARGET_CASE} AS DOUBLE) AS target
FROM (SELECT s.*, {_SOURCE_CASE} AS signal_source, p.resolves_observation_id
      FROM signals s LEFT JOIN paired p USING (observation_id)) q"""

DUCK_SQL["styles"] = """
SELECT user_id, concept_id, arg_max(style_in_play, (n, last, style_in_play)) AS effective_style
FROM (SELECT user_id, concept_id, style_in_play, count(*) AS n, max(observed_at) AS last
      FROM observations WHERE resolves_observation_id IS NOT NULL AND style_in_play IS NOT NULL
      GROUP BY ALL) q GROUP BY user_id, concept_id"""
DUCK_SQL["states"] = """
SELECT o.user_id, o.concept_id, o.total_weight, o.raw_score, o.evidence_count,
  o.last_reinforced_at, o.first_seen_at, s.effective_style,
  CASE WHEN o.total_weight > 0 THEN o.total_weight / (o.total_weight + 0.7) ELSE 0.0 END
    AS score_confidence
FROM (SELECT user_id, concept_id, sum(weight) AS total_weight,
        CASE WHEN sum(weight) > 0 THEN sum(weight * target) / sum(weight) END AS raw_score,
        CAST(least(32767, count(*)) AS INT) AS evidence_count,
        max(observed_at) AS last_reinforced_at, min(observed_at) AS first_seen_at
      FROM observations GROUP BY user_id, concept_id) o
LEFT JOIN styles s USING (user_id, concept_id)"""

_CONCEPT_NAMES = """
  user_id, concept_id,
  coalesce(p_name, 'concept') || ' ' || CAST(concept_id % 12 AS STRING) AS canonical_name,
  <<arr 'alias ' || CAST(concept_id % 5 AS STRING), 'Alias-' || CAST(concept_id % 12 AS STRING)>>
    AS aliases,"""
_CONCEPT_LINKS = """
  CAST(CASE WHEN concept_id % 13 = 0 THEN 0.9 WHEN concept_id % 31 = 0 THEN 0.2 END AS DOUBLE)
    AS user_override_score,
  CASE WHEN concept_id % 12 = 11 AND user_id % 2 = 0 THEN concept_id - 1
       WHEN concept_id % 12 = 10 AND user_id % 4 = 0 THEN concept_id - 4 END AS merged_into_id,
  <<arr (concept_id * 5) % n, (concept_id * 5 + 7) % n, (concept_id + user_id) % n>>
    AS source_paper_ids"""
_CONCEPT_COLUMNS = f"""{_CONCEPT_NAMES}
  round(raw_score, 6) AS understanding_score, round(score_confidence, 6) AS score_confidence,
  evidence_count, effective_style, last_reinforced_at, first_seen_at,{_CONCEPT_LINKS},
  e.embedding
FROM (SELECT s.*, (SELECT max(n) FROM doc_count) AS n,
        (SELECT max(vec_id) + 1 FROM embeddings) AS v FROM states s) q
LEFT JOIN part p ON p.p_partkey = q.concept_id + 1
LEFT JOIN embeddings e ON e.vec_id = q.concept_id % q.v"""
SHARED["concepts"] = "SELECT" + _CONCEPT_COLUMNS
# The same rows without what evidence and vectors give: nothing has to be paired, folded or written for them.
_CONCEPT_PAIRS = """
FROM (SELECT DISTINCT user_id, concept_id, (SELECT max(n) FROM doc_count) AS n FROM signals) q"""
SPARK_SQL["concept_links"] = f"SELECT user_id, concept_id,{_CONCEPT_LINKS}{_CONCEPT_PAIRS}"
SPARK_SQL["scored_concepts"] = "SELECT" + _CONCEPT_COLUMNS.replace(",\n  e.embedding", "").replace(
    "LEFT JOIN embeddings e ON e.vec_id = q.concept_id % q.v", "")
SPARK_SQL["access_keys"] = "SELECT DISTINCT user_id, paper_id" + SHARED["user_paper_access"].partition(
    "AS revoked_at")[2].rpartition(" GROUP BY")[0]
SPARK_SQL["concept_names"] = f"""SELECT{_CONCEPT_NAMES}{_CONCEPT_LINKS}{_CONCEPT_PAIRS}
LEFT JOIN part p ON p.p_partkey = q.concept_id + 1"""


def _observations(v: "Views") -> DataFrame:
    from quillmark.operators import learner

    return learner.evidence(v.signals)


def _states(v: "Views") -> DataFrame:
    from quillmark.operators import learner

    return learner.states(v.observations)


def _concept_history(v: "Views") -> DataFrame:
    from quillmark.operators import asof

    return asof.intervals(v.observations)


def _turns(v: "Views") -> DataFrame:
    from quillmark.operators import conversations

    return conversations.number_turns(v.raw_turns)


BUILDERS["observations"] = _observations
BUILDERS["states"] = _states
BUILDERS["concept_history"] = _concept_history
BUILDERS["turns"] = _turns

# Tables a deployment keeps on disk. They are derived once per session, written
# to the shared folder, and read from there by every job that needs them.
STORED = {"observations", "states", "concept_history", "turns", "concepts", "scored_concepts", "edges",
          "user_paper_access"}
_stored_paths: dict[tuple, tuple[str, DataFrame]] = {}

ORACLE_VIEWS = {k: dialect(s, _DUCK) for k, s in {**SHARED, **DUCK_SQL}.items()}
_SPARK_VIEWS = {k: dialect(s, _SPARK) for k, s in {**SHARED, **SPARK_SQL}.items()}
NAMES = set(BASE) | set(_SPARK_VIEWS) | set(BUILDERS)


def add_stored(name: str, build: Callable[["Views"], DataFrame]) -> None:
    BUILDERS[name] = build
    NAMES.add(name)
    STORED.add(name)



class Views:
    """Lazy access to base tables and derived views: ``views.turns`` and so on."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir.rstrip("/"), {}
        self._state, self._stored = None, STORED

    def once(self, *stored: str) -> "Views":
        """The same views for a job that reads each once: only ``stored`` ones are written on the way."""
        out = Views(self.spark, self.sf_dir)
        out._stored = set(stored)
        return out

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Views":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        # Spark takes a table for as large as its compressed files, and so sends tables of a hundred times the
        # broadcast limit through the driver; rows of ids and times take about this much more in memory.
        spark.conf.set("spark.sql.sources.fileCompressionFactor", "20.0")
        return cls(spark, sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in NAMES:
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._build(name)
        return self._made[name]

    def _build(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        key = self._key(name)
        if key in _stored_paths:
            return _stored_paths[key][1]
        if name in BUILDERS:
            df = BUILDERS[name](self)
        else:
            df = self.sql(_SPARK_VIEWS[name], skip=name)
        if name in self._stored:
            path = store(df, name)
            df = self.spark.read.schema(df.schema).parquet(path)
            _stored_paths[key] = (path, df)
        return df

    def path_of(self, name: str) -> str:
        """Folder of a stored table, for readers that stream it."""
        getattr(self, name)
        return _stored_paths[self._key(name)][0]

    def _key(self, name: str) -> tuple:
        """Names a stored table by session, source folder and the state of its files."""
        if self._state is None:
            root = self.spark._jvm.org.apache.hadoop.fs.Path(self.sf_dir)
            fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
            self._state = tuple(sorted(
                (s.getPath().getName(), s.getModificationTime(), s.getLen())
                for s in fs.listStatus(root)))
        return (self.spark.sparkContext.applicationId, self.sf_dir, self._state, name)

    def streamed(self, name: str) -> DataFrame:
        """A given table as a file stream."""
        schema = getattr(self, name).schema
        return self.spark.readStream.schema(schema).option(
            "pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 8).parquet(self.sf_dir)

    def sql(self, text: str, skip: str = "") -> DataFrame:
        """Spark SQL over the views it names."""
        used = {}

        def swap(m: re.Match) -> str:
            name = m.group(2)
            if name not in NAMES or name == skip:
                return m.group(0)
            used[name] = getattr(self, name)
            return f"{m.group(1)} {{{name}}}"

        text = re.sub(r"\b(FROM|JOIN)\s+([a-z_]+)\b", swap, text)
        text = re.sub(r"\{(?!\w+\})", "{{", text) if used else text
        return self.spark.sql(text, **used)

    def as_of(self):
        return F.lit(AS_OF).cast("timestamp_ntz")
