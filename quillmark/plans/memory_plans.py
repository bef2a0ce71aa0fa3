"""Section F queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import memory as M
from quillmark.operators import retrieval as R
from quillmark.plans.common import i64, r6, us
from quillmark.plans.learner_plans import SCORE, known_at
from quillmark.plans.registry import query
from quillmark.plans.views import ORACLE_VIEWS

ORACLE_VIEWS["live_concepts"] = f"""
SELECT *, coalesce(score < 0.4 AND score_confidence >= 0.3, false) AS is_weak
FROM (SELECT *, round({SCORE}, 9) AS score FROM concepts WHERE merged_into_id IS NULL) q"""
ORACLE_VIEWS["all_scored"] = f"SELECT *, round({SCORE}, 9) AS score FROM concepts"
ORACLE_VIEWS["near_concepts"] = """
SELECT * FROM (SELECT query_id, user_id, concept_id, sim, row_number() OVER (PARTITION BY query_id
    ORDER BY round(sim, 9) DESC, concept_id) AS rank_no
  FROM (SELECT q.query_id, q.user_id, c.concept_id, list_cosine_similarity(
      q.query_vector::DOUBLE[], c.embedding::DOUBLE[]) AS sim
    FROM queries q JOIN live_concepts c ON c.user_id = q.user_id AND c.embedding IS NOT NULL) a) b
WHERE rank_no <= 5 AND round(sim, 9) >= 0.25"""
ORACLE_VIEWS["prefetch_known"] = known_at("""
  SELECT query_id, concept_id, asked_at AS moment FROM near_concepts JOIN (SELECT query_id, asked_at FROM queries) q
    USING (query_id)""", "query_id")
ORACLE_VIEWS["graph"] = """
SELECT e.user_id, e.near, e.far, e.relationship_type, e.confidence, c.canonical_name AS far_name
FROM (SELECT user_id, source_concept_id AS near, target_concept_id AS far, relationship_type,
    confidence FROM edges UNION ALL SELECT user_id, target_concept_id, source_concept_id,
    relationship_type, confidence FROM edges) e
JOIN live_concepts c ON c.concept_id = e.far"""


@query("f1_nearest_concepts", """
SELECT query_id, concept_id, CAST(rank_no AS INTEGER) AS rank_no, round(sim, 6) AS similarity
FROM near_concepts""")
def f1(v):
    return M.nearest(v.queries, v.concepts).select(
        "query_id", "concept_id", "rank_no", r6("similarity"))


_NAMED = """SELECT query_id, user_id, query_vector, CASE query_id % 4 WHEN 0 THEN ' ALIAS 3 '
  WHEN 1 THEN 'Alias-5' WHEN 2 THEN 'unheard of' ELSE '  ' END AS concept_name FROM queries"""
_KEY = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


@query("f2_concept_by_name", f"""
WITH named AS (SELECT * REPLACE (trim(concept_name) AS concept_name) FROM ({_NAMED}) q
  WHERE trim(concept_name) <> ''),
hit AS (SELECT query_id, arg_min(concept_id, (kind, concept_id)) AS concept_id FROM (
  SELECT n.query_id, 0 AS kind, c.concept_id FROM named n JOIN live_concepts c ON
    c.user_id = n.user_id AND {_KEY.format('c.canonical_name')} = {_KEY.format('n.concept_name')}
  UNION ALL SELECT n.query_id, 1, c.concept_id FROM named n JOIN live_concepts c ON
    c.user_id = n.user_id AND list_contains(c.aliases, n.concept_name)) h GROUP BY query_id)
SELECT n.query_id, n.user_id, coalesce(h.concept_id, x.concept_id) AS concept_id,
  CASE WHEN h.concept_id IS NOT NULL THEN 'exact' WHEN x.concept_id IS NOT NULL THEN 'nearest'
    ELSE 'none' END AS how
FROM named n LEFT JOIN hit h USING (query_id)
LEFT JOIN near_concepts x ON x.query_id = n.query_id AND x.rank_no = 1""")
def f2(v):
    return M.by_name(v.sql(_NAMED), v.concepts)


def _roots(v):
    """Every concept, absorbed or not, as the root of a call of its own."""
    return v.concepts.select(F.col("concept_id").alias("call_id"), "user_id", "concept_id")


@query("f3_neighbours", """
WITH roots AS (SELECT concept_id AS call_id, user_id, concept_id AS near FROM concepts),
h1 AS (SELECT r.call_id, g.* FROM roots r JOIN graph g ON g.user_id = r.user_id AND g.near = r.near),
f2 AS (SELECT DISTINCT call_id, user_id, far AS near FROM h1 WHERE far <> call_id)
SELECT call_id, near, far, far_name, relationship_type, confidence, 1 AS hop FROM h1
UNION ALL SELECT f.call_id, g.near, g.far, g.far_name, g.relationship_type, g.confidence, 2
FROM f2 f JOIN graph g ON g.user_id = f.user_id AND g.near = f.near""")
def f3(v):
    return M.neighbours(_roots(v), v.edges, v.concepts, 2).drop("user_id")


@query("f4_prefetch", """
SELECT n.query_id, n.concept_id, CAST(rank_no AS INTEGER) AS rank_no,
  round(coalesce(k.score, c.user_override_score), 6) AS score, k.effective_style,
  g.far AS related_id, g.relationship_type, g.confidence AS edge_confidence
FROM near_concepts n JOIN live_concepts c ON c.concept_id = n.concept_id
LEFT JOIN prefetch_known k ON k.query_id = n.query_id AND k.concept_id = n.concept_id
LEFT JOIN graph g ON g.user_id = n.user_id AND g.near = n.concept_id""")
def f4(v):
    """Each hit with what was known of it when the query was asked."""
    return M.prefetch(v.queries, v.concepts, v.edges, v.concept_history).select(
        "query_id", "concept_id", "rank_no", r6("score"), "effective_style", "related_id", "relationship_type",
        "edge_confidence")


@query("f5_all_concepts", """
SELECT user_id, concept_id, CAST(rn AS INTEGER) AS rank_no, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY evidence_count DESC,
    understanding_score ASC NULLS LAST, canonical_name, concept_id) AS rn FROM live_concepts) q
WHERE rn <= 300""")
def f5(v):
    return M.all_for_reader(v.concepts, v.as_of()).select(
        "user_id", "concept_id", "rank_no", r6("score"))


_WEAKEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY
    understanding_score ASC NULLS LAST, concept_id) AS rn FROM live_concepts
  WHERE score_confidence >= 0.3) q WHERE rn <= 5"""


@query("f6_weakest_concepts", f"""
SELECT user_id, concept_id, CAST(rn AS INTEGER) AS rank_no, round(score, 6) AS score
FROM ({_WEAKEST}) w""")
def f6(v):
    return M.weakest(v.concepts, v.as_of()).select(
        "user_id", "concept_id", "rank_no", r6("score"))


@query("f7_only_weak", f"SELECT user_id, concept_id FROM ({_WEAKEST}) w WHERE is_weak")
def f7(v):
    return M.weakest(v.concepts, v.as_of(), only_weak=True).select("user_id", "concept_id")


@query("f8_latest_note", """
SELECT concept_id, arg_max(note, (observed_at, observation_id)) AS evidence_note
FROM signals WHERE note IS NOT NULL GROUP BY concept_id""")
def f8(v):
    return M.latest_note(v.signals)


@query("f9_evidence_trail", """
SELECT concept_id, observation_id, CAST(rn AS INTEGER) AS rank_no FROM (SELECT *, row_number() OVER
  (PARTITION BY concept_id ORDER BY observed_at DESC, observation_id DESC) AS rn FROM signals) q
WHERE rn <= 5""")
def f9(v):
    return M.trail(v.signals, 5).select("concept_id", "observation_id", "rank_no")


_VISIBLE = """SELECT DISTINCT x.user_id, x.concept_id, x.paper_id, p.title FROM (
    SELECT user_id, concept_id, unnest(source_paper_ids) AS paper_id FROM {0}) x
  JOIN user_paper_access a ON a.user_id = x.user_id AND a.paper_id = x.paper_id
    AND a.revoked_at IS NULL JOIN papers p ON p.paper_id = x.paper_id"""


@query("f10_visible_source_papers", _VISIBLE.format("concepts"))
def f10(v):
    return M.visible_papers(v.concepts, R.scope(v.user_paper_access), v.papers).select(
        "user_id", "concept_id", "paper_id", "title")


@query("f11_compact_record", """
SELECT user_id, c.concept_id, canonical_name, round(score, 2) AS understanding_score,
  round(score_confidence, 2) AS score_confidence, effective_style,
  strftime(last_reinforced_at, '%Y-%m-%d') AS last_seen, evidence_count, evidence_note
FROM live_concepts c LEFT JOIN (SELECT concept_id, arg_max(note, (observed_at, observation_id))
  AS evidence_note FROM signals WHERE note IS NOT NULL GROUP BY concept_id) n USING (concept_id)""")
def f11(v):
    return M.compact(v.concepts, v.signals, v.as_of())


@query("f12_concept_detail", f"""
SELECT c.concept_id, round(c.score, 6) AS score, c.is_weak, part, pos, item, resolved_a_struggle
FROM live_concepts c JOIN (
  SELECT concept_id, 'evidence' AS part, rn AS pos, signal_type AS item,
    resolves_observation_id IS NOT NULL AS resolved_a_struggle FROM (SELECT *, row_number() OVER
    (PARTITION BY concept_id ORDER BY observed_at DESC, observation_id DESC) AS rn
    FROM observations) o WHERE rn <= 20
  UNION ALL SELECT concept_id, 'paper', paper_id, title, NULL FROM ({_VISIBLE.format('concepts')}) v
  UNION ALL SELECT near, 'related', far, relationship_type, NULL FROM graph) p USING (concept_id)""")
def f12(v):
    return M.detail(v.concepts, v.observations, v.edges, R.scope(v.user_paper_access), v.papers,
                    v.as_of()).select("concept_id", r6("score"), "is_weak", "part", i64("pos"),
                                      "item", "resolved_a_struggle")


ORACLE_VIEWS["graph_first"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_seen_at, concept_id)
  AS rn FROM live_concepts) q WHERE rn <= 300"""


@query("f13_graph_nodes", """
SELECT user_id, concept_id, CAST(rn AS INTEGER) AS rank_no,
  round(CASE WHEN score_confidence >= 0.3 THEN score ELSE understanding_score END, 6) AS shown_score,
  CASE WHEN score_confidence >= 0.3 THEN is_weak ELSE false END AS shown_weak FROM graph_first""")
def f13(v):
    return M.graph_nodes(v.concepts, v.as_of()).select(
        "user_id", "concept_id", "rank_no", r6("shown_score"), "shown_weak")


@query("f13_graph_node_papers", _VISIBLE.format("graph_first"))
def f13p(v):
    nodes = M.graph_nodes(v.concepts, v.as_of())
    return M.visible_papers(nodes, R.scope(v.user_paper_access), v.papers).select(
        "user_id", "concept_id", "paper_id", "title")


@query("f13_graph_edges", """
SELECT relationship_id, source_concept_id, target_concept_id, relationship_type, confidence FROM edges
WHERE source_concept_id IN (SELECT concept_id FROM graph_first)
  AND target_concept_id IN (SELECT concept_id FROM graph_first)""")
def f13e(v):
    return M.graph_edges(M.graph_nodes(v.concepts, v.as_of()), v.edges).drop("user_id").select(
        "relationship_id", "source_concept_id", "target_concept_id", "relationship_type",
        "confidence")


@query("f14_concept_list", """
SELECT user_id, concept_id, canonical_name, evidence_count, epoch_us(last_reinforced_at)
  AS last_reinforced_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY evidence_count DESC, understanding_score ASC NULLS LAST, canonical_name, concept_id) AS rn
  FROM live_concepts) q WHERE rn <= 300 AND is_weak""")
def f14(v):
    return M.all_for_reader(v.concepts, v.as_of()).filter("is_weak").select(
        "user_id", "concept_id", "canonical_name", "evidence_count", us("last_reinforced_at"))


ORACLE_VIEWS["weak_prereqs"] = """
SELECT e.user_id, e.target_concept_id AS concept_id,
  arg_min(e.source_concept_id, (c.score, e.source_concept_id)) AS prerequisite_id
FROM edges e JOIN live_concepts c ON c.concept_id = e.source_concept_id AND c.is_weak
WHERE e.relationship_type = 'prerequisite_of' GROUP BY 1, 2"""


@query("f15_weak_prerequisite", "SELECT * FROM weak_prereqs")
def f15(v):
    return M.weak_prerequisite(v.concepts, v.edges, v.as_of())


@query("f16_review_targets", """
SELECT user_id, concept_id, unblocks, CAST(dense_rank() OVER (PARTITION BY user_id
  ORDER BY unblocks DESC) AS INTEGER) AS place
FROM (SELECT c.user_id, c.concept_id, count(DISTINCT target_concept_id) AS unblocks
  FROM live_concepts c JOIN edges e ON e.source_concept_id = c.concept_id
    AND e.relationship_type = 'prerequisite_of' WHERE c.is_weak GROUP BY 1, 2) q""")
def f16(v):
    return M.review_targets(v.concepts, v.edges, v.as_of())


@query("f17_relationship_mix", """
SELECT user_id, relationship_type, count(*) AS edges,
  round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share
FROM edges GROUP BY user_id, relationship_type""")
def f17(v):
    return M.type_mix(v.edges).select("user_id", "relationship_type", "edges", r6("share"))


@query("f18_callback_pair", """
SELECT user_id, near, far, relationship_type, confidence FROM (SELECT g.*, row_number() OVER
    (PARTITION BY g.user_id ORDER BY n.evidence_count DESC, g.confidence DESC, g.near DESC, g.far DESC,
     g.relationship_type DESC) AS rn
  FROM graph g JOIN live_concepts n ON n.concept_id = g.near
  JOIN live_concepts f ON f.concept_id = g.far
  WHERE len(list_filter(n.source_paper_ids, lambda p: NOT list_contains(f.source_paper_ids, p))) > 0
  ) q WHERE rn = 1""")
def f18(v):
    return M.callback_pairs(v.concepts, v.edges).select(
        "user_id", "near", "far", "relationship_type", "confidence")


_PAIRS = """SELECT DISTINCT user_id, (concept_id * 5) % n AS paper_a, (concept_id * 5 + 12) % n
  AS paper_b FROM (SELECT *, (SELECT max(n) FROM doc_count) AS n FROM signals) q"""


@query("f19_bridging_edges", f"""
SELECT p.user_id, paper_a, paper_b, count(*) AS bridging_edges,
  count(*) FILTER (WHERE relationship_type = 'component_of') AS component_edges
FROM ({_PAIRS}) p JOIN edges e ON e.user_id = p.user_id
JOIN live_concepts s ON s.concept_id = e.source_concept_id
JOIN live_concepts t ON t.concept_id = e.target_concept_id
WHERE list_contains(s.source_paper_ids, paper_b) AND NOT list_contains(s.source_paper_ids, paper_a)
  AND list_contains(t.source_paper_ids, paper_a) GROUP BY ALL""")
def f19(v):
    return M.bridges(v.sql(_PAIRS), v.concepts, v.edges)


@query("f19_shared_concepts", f"""
SELECT p.user_id, paper_a, paper_b, count(*) AS shared_concepts
FROM ({_PAIRS.replace('+ 12', '+ 7')}) p JOIN live_concepts c ON c.user_id = p.user_id
WHERE list_contains(source_paper_ids, paper_a) AND list_contains(source_paper_ids, paper_b)
GROUP BY ALL""")
def f19s(v):
    return M.shared_concepts(v.sql(_PAIRS.replace("+ 12", "+ 7")), v.concepts)
