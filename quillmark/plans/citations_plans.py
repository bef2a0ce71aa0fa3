"""Section D queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import citations as D
from quillmark.plans.common import joined
from quillmark.plans.registry import query
from quillmark.plans.views import ORACLE_VIEWS

_STRIP = r"regexp_replace({0}, '^[ \n\t\r\x0b\x0c]+|[ \n\t\r\x0b\x0c]+$', '', 'g')"
ORACLE_VIEWS["said_markers"] = r"""
SELECT DISTINCT a.turn_id, m AS marker, CAST(m AS INTEGER) AS position, n
FROM (SELECT turn_id, unnest(regexp_extract_all(draft, '\[(\d{1,2})\]', 1)) AS m FROM answers) a
LEFT JOIN (SELECT turn_id, max(rank_no) AS n FROM retrieval_sets GROUP BY turn_id) r USING (turn_id)"""
ORACLE_VIEWS["flagged_sets"] = """
SELECT r.turn_id, r.rank_no, r.chunk_id, r.similarity, m.marker AS citation_marker,
  m.marker IS NOT NULL AS was_cited
FROM retrieval_sets r LEFT JOIN (SELECT turn_id, position, '[' || max(marker) || ']' AS marker
  FROM said_markers GROUP BY turn_id, position) m
ON m.turn_id = r.turn_id AND m.position = r.rank_no"""
ORACLE_VIEWS["marker_lists"] = """
SELECT turn_id,
  string_agg('[' || marker || ']', ',' ORDER BY '[' || marker || ']')
    FILTER (WHERE position BETWEEN 1 AND coalesce(n, 0)) AS good,
  string_agg('[' || marker || ']', ',' ORDER BY '[' || marker || ']')
    FILTER (WHERE NOT position BETWEEN 1 AND coalesce(n, 0)) AS bad,
  '\\[(' || string_agg(marker, '|') FILTER (WHERE NOT position BETWEEN 1 AND coalesce(n, 0))
    || ')\\]' AS pattern, max(n) AS n
FROM said_markers GROUP BY turn_id""".replace("\\\\", "\\")
_TIDY = (r"regexp_replace(regexp_replace(regexp_replace({0}, '[ \t]+([.,;:!?])', '\1', 'g'), "
         r"'[ \t]{{2,}}', ' ', 'g'), ' +\n', chr(10), 'g')")
_CLEAN = ("CASE WHEN bad IS NULL THEN draft ELSE regexp_replace(draft, pattern, '', 'g') END")


def _flagged(v):
    return D.flag_retrievals(v.retrieval_sets, D.resolve(v.answers, v.retrieval_sets))


@query("d1_extract_markers", r"""
SELECT turn_id, CAST(generate_subscripts(ms, 1) - 1 AS INTEGER) AS pos, unnest(ms) AS marker
FROM (SELECT turn_id, regexp_extract_all(draft, '\[(\d{1,2})\]', 1) AS ms FROM answers) q""")
def d1(v):
    return D.extract(v.answers)


@query("d2_resolve_markers", """
SELECT s.turn_id, '[' || marker || ']' AS marker, r.chunk_id, r.chunk_id IS NULL AS invented
FROM said_markers s LEFT JOIN retrieval_sets r ON r.turn_id = s.turn_id AND r.rank_no = s.position""")
def d2(v):
    return D.resolve(v.answers, v.retrieval_sets)


@query("d3_strip_invented", f"""
SELECT turn_id, coalesce(bad, '') AS stripped, {_CLEAN} AS text
FROM answers LEFT JOIN marker_lists USING (turn_id)""")
def d3(v):
    sized = v.answers.join(D.set_sizes(v.retrieval_sets), "turn_id", "left").withColumn(
        "n", F.coalesce("n", F.lit(0)))
    bad = F.filter(F.array_distinct(D.markers(F.col("draft"))),
                   lambda m: ~m.cast("int").between(1, F.col("n")))
    return sized.withColumn("bad", bad).select(
        "turn_id", D.strip_invented(F.col("draft"), F.col("bad")).alias("text"),
        F.array_join(F.array_sort(F.transform(
            "bad", lambda m: F.concat(F.lit("["), m, F.lit("]")))), ",").alias("stripped"))


@query("d4_tidy_text", f"""
SELECT turn_id, {_STRIP.format(_TIDY.format('draft'))} AS text FROM answers""")
def d4(v):
    return v.answers.select("turn_id", D.tidy(F.col("draft")).alias("text"))


@query("d5_verify_answers", f"""
SELECT turn_id, CASE WHEN blank THEN '' ELSE {_STRIP.format(_TIDY.format(_CLEAN))} END AS text,
  coalesce(good, '') AS cited_markers, coalesce(bad, '') AS stripped_markers,
  CASE WHEN blank OR size IS NULL THEN 'no_evidence' WHEN good IS NOT NULL THEN 'grounded'
    WHEN bad IS NOT NULL THEN 'no_evidence' ELSE 'degraded' END AS grounding_status
FROM (SELECT *, trim(draft) = '' AS blank FROM answers) a LEFT JOIN marker_lists USING (turn_id)
LEFT JOIN (SELECT turn_id, count(*) AS size FROM retrieval_sets GROUP BY turn_id) s USING (turn_id)""")
def d5(v):
    out = D.verify(v.answers, v.retrieval_sets)
    return out.select("turn_id", "text", joined("cited_markers", "cited_markers"),
                      joined("stripped_markers", "stripped_markers"), "grounding_status")


@query("d6_flag_retrievals", """
SELECT turn_id, CAST(rank_no AS BIGINT) AS rank_no, chunk_id, similarity, citation_marker, was_cited
FROM flagged_sets""")
def d6(v):
    return _flagged(v).withColumn("rank_no", F.col("rank_no").cast("bigint"))


@query("d7_turn_citations", """
SELECT turn_id, CAST(rank_no AS BIGINT) AS rank_no, citation_marker, chunk_id, c.paper_id,
  section_path, c.page_start, c.page_end
FROM flagged_sets f JOIN chunks c USING (chunk_id) JOIN sections s USING (section_id)
WHERE was_cited""")
def d7(v):
    return D.turn_citations(_flagged(v), v.chunks, v.sections).withColumn(
        "rank_no", F.col("rank_no").cast("bigint"))


_REQUESTS = """SELECT turn_id, chunk_id, CASE WHEN rank_no % 2 = 0 THEN 0 ELSE m.user_id END AS user_id
  FROM retrieval_sets r JOIN messages m ON m.message_id = r.turn_id"""


@query("d8_click_through", f"""
SELECT q.turn_id, q.user_id, q.chunk_id, citation_marker, title, section_path, c.content, c.page_start
FROM ({_REQUESTS}) q
JOIN messages m ON m.message_id = q.turn_id AND m.user_id = q.user_id
JOIN flagged_sets f ON f.turn_id = q.turn_id AND f.chunk_id = q.chunk_id AND f.was_cited
JOIN chunks c ON c.chunk_id = q.chunk_id JOIN sections s USING (section_id)
JOIN papers p ON p.paper_id = c.paper_id""")
def d8(v):
    turns = v.messages.select(F.col("message_id").alias("turn_id"), "user_id")
    return D.click_through(v.sql(_REQUESTS), _flagged(v), turns, v.chunks, v.sections,
                           v.papers).select(
        "turn_id", "user_id", "chunk_id", "citation_marker", "title", "section_path", "content",
        "page_start")


@query("d9_cited_by", "SELECT DISTINCT chunk_id, turn_id FROM flagged_sets WHERE was_cited")
def d9(v):
    return D.cited_by(_flagged(v))


@query("d9_citation_counts", """
SELECT chunk_id, count(DISTINCT turn_id) AS turns FROM flagged_sets WHERE was_cited GROUP BY chunk_id""")
def d9c(v):
    return D.citation_counts(_flagged(v))
