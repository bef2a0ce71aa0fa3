"""Section G queries: one round over every reader's newest paper, and the full loop."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quillmark.functions import expr as X
from quillmark.operators import canonical as G
from quillmark.operators import chunking as C
from quillmark.plans.chunking_plans import hashed
from quillmark.plans.common import r6
from quillmark.plans.registry import query
from quillmark.functions.shared import materialise
from quillmark.plans.views import DIM, ORACLE_VIEWS, add_stored, dialect, _DUCK, _SPARK

_KEY = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"

_CANDIDATES = """
SELECT user_id, name, min(event_id) AS candidate_no, (user_id * 3) % max(n) AS paper_id,
  CASE min(event_id) % 5 WHEN 0 THEN <<arr 'Alias-3', 'nick ' || name>>
    WHEN 1 THEN <<arr 'other ' || name>> END AS aliases,
  <<arr 'novel idea ' || CAST((min(event_id) + 1) % 9 AS STRING)>> AS prerequisites
FROM (SELECT s.user_id, s.observation_id AS event_id, (SELECT max(n) FROM doc_count) AS n,
    CASE s.observation_id % 4 WHEN 0 THEN upper(c.canonical_name) || '!'
      WHEN 1 THEN c.canonical_name || ' extra'
      WHEN 2 THEN 'novel idea ' || CAST(s.observation_id % 9 AS STRING)
      ELSE 'strange notion ' || CAST(s.observation_id % 5 AS STRING) END AS name
  FROM signals s JOIN concepts c ON c.concept_id = s.concept_id
  WHERE s.signal_type IN ('explicit_understanding', 'quiz_correct')) q
GROUP BY user_id, name"""
_VERDICT_COLUMNS = """
  CASE candidate_no % 5 WHEN 0 THEN 'same' WHEN 1 THEN 'related' WHEN 2 THEN 'distinct'
    WHEN 3 THEN 'related' END AS verdict,
  CAST(0.6 + CAST(candidate_no % 8 AS DOUBLE) / 20 AS DOUBLE) AS verdict_confidence,
  CASE WHEN candidate_no % 3 = 0 THEN 'component_of' WHEN candidate_no % 3 = 1 THEN 'weird' END
    AS relationship_type"""

ORACLE_VIEWS["candidates"] = dialect(_CANDIDATES, _DUCK)
ORACLE_VIEWS["keyed_concepts"] = f"""
SELECT *, {_KEY.format('canonical_name')} AS normalized_name FROM concepts
WHERE merged_into_id IS NULL"""
ORACLE_VIEWS["concept_vectors"] = hashed("concept_id", "canonical_name", "keyed_concepts")
ORACLE_VIEWS["candidate_vectors"] = hashed("candidate_no", "name", "candidates")
ORACLE_VIEWS["exact_hits"] = f"""
SELECT candidate_no, arg_min(concept_id, (kind, concept_id)) AS exact_id FROM (
  SELECT s.candidate_no, 0 AS kind, c.concept_id FROM (
    SELECT user_id, candidate_no, unnest(list_concat([name], coalesce(aliases, []))) AS said
    FROM candidates) s
  JOIN keyed_concepts c ON c.user_id = s.user_id AND c.normalized_name = {_KEY.format('s.said')}
  UNION ALL SELECT s.candidate_no, 1, c.concept_id FROM candidates s JOIN keyed_concepts c
    ON c.user_id = s.user_id
    AND list_has_any(c.aliases, list_concat([s.name], coalesce(s.aliases, [])))) h
GROUP BY candidate_no"""
ORACLE_VIEWS["near_hits"] = """
SELECT candidate_no, concept_id AS nearest_id, sim FROM (SELECT *, row_number() OVER
    (PARTITION BY candidate_no ORDER BY round(sim, 9) DESC, concept_id) AS rn
  FROM (SELECT a.candidate_no, c.concept_id, list_cosine_similarity(v.vector, w.vector) AS sim
    FROM candidates a JOIN candidate_vectors v USING (candidate_no)
    JOIN keyed_concepts c ON c.user_id = a.user_id JOIN concept_vectors w
      ON w.concept_id = c.concept_id
    WHERE a.candidate_no NOT IN (SELECT candidate_no FROM exact_hits)) p) q WHERE rn = 1"""
ORACLE_VIEWS["judged_pairs"] = f"""
SELECT *, CASE WHEN verdict = 'same' AND verdict_confidence >= 0.85 THEN 'merge'
    WHEN verdict = 'related' AND verdict_confidence >= 0.7 THEN 'edge' ELSE 'distinct' END AS outcome,
  CASE WHEN verdict = 'related' AND verdict_confidence >= 0.7 THEN
    CASE WHEN relationship_type = 'component_of' THEN 'component_of' ELSE 'co_occurs_with' END END
    AS edge_type
FROM (SELECT candidate_no, nearest_id, {_VERDICT_COLUMNS} FROM near_hits
      WHERE round(sim, 9) >= 0.72) j"""
ORACLE_VIEWS["placed_candidates"] = f"""
SELECT r.*, coalesce(matched_id, t.concept_id) IS NULL AS created, coalesce(matched_id, t.concept_id,
  CAST(('0x' || left(md5(CAST(r.user_id AS VARCHAR) || '|' || name_key), 15)) AS BIGINT)) AS concept_id
FROM (SELECT c.*, left({_KEY.format('name')}, 200) AS name_key, e.exact_id, j.nearest_id, j.outcome,
    j.edge_type, j.verdict_confidence, coalesce(e.exact_id, CASE WHEN j.outcome = 'merge'
      THEN j.nearest_id END) AS matched_id
  FROM candidates c LEFT JOIN exact_hits e USING (candidate_no)
  LEFT JOIN judged_pairs j USING (candidate_no)) r
LEFT JOIN keyed_concepts t ON t.user_id = r.user_id AND t.normalized_name = r.name_key"""
ORACLE_VIEWS["proposed_edges"] = """
SELECT user_id, concept_id AS source_concept_id, nearest_id AS target_concept_id,
  edge_type AS relationship_type, verdict_confidence AS confidence, candidate_no AS seq
FROM placed_candidates WHERE outcome = 'edge' AND exact_id IS NULL
UNION ALL SELECT w.user_id, s.concept_id, w.concept_id, 'prerequisite_of', 0.7, w.candidate_no
FROM (SELECT *, unnest(prerequisites) AS wanted FROM placed_candidates) w
JOIN placed_candidates s ON s.user_id = w.user_id AND s.paper_id = w.paper_id AND s.name = w.wanted"""
ORACLE_VIEWS["added_edges"] = """
SELECT user_id, source_concept_id, target_concept_id, relationship_type,
  arg_min(confidence, seq) AS confidence
FROM proposed_edges p WHERE source_concept_id <> target_concept_id AND NOT EXISTS (
  SELECT 1 FROM edges e WHERE e.user_id = p.user_id AND e.source_concept_id = p.source_concept_id
  AND e.target_concept_id = p.target_concept_id AND e.relationship_type = p.relationship_type)
GROUP BY user_id, source_concept_id, target_concept_id, relationship_type"""


# Nothing here reads what evidence gives a concept, so nothing is paired or folded for it.
_SPARK_CANDIDATES = dialect(_CANDIDATES, _SPARK).replace("JOIN concepts", "JOIN concept_names")


def _candidates(v):
    base = bare_candidates(v)
    vectors = C.hash_vectors(base, "candidate_no", "name", DIM)
    return base.join(vectors, "candidate_no")


def bare_candidates(v):
    return v.sql(_SPARK_CANDIDATES)


def _named_concepts(v):
    """Concepts with a name key, and name vectors in place of passage vectors."""
    keyed = v.concept_names.withColumn("normalized_name", X.name_key(F.col("canonical_name")))
    vectors = C.hash_vectors(keyed, "concept_id", "canonical_name", DIM)
    return keyed.join(vectors.withColumnRenamed("vector", "embedding"), "concept_id")


add_stored("named_candidates", _candidates)
add_stored("named_concepts", _named_concepts)


def candidates(v):
    return v.named_candidates


def stored_concepts(v):
    return v.named_concepts


def judge(rows):
    """The stored verdicts for a set of candidates."""
    return rows.select("user_id", "candidate_no").selectExpr(
        "user_id", "candidate_no", *_split(_VERDICT_COLUMNS))


def _split(text):
    depth, parts, start = 0, [], 0
    for m in re.finditer(r"[(),]|\bCASE\b|\bEND\b", text):
        depth += {"(": 1, "CASE": 1, ")": -1, "END": -1}.get(m.group(0), 0)
        if m.group(0) == "," and depth == 0:
            parts.append(text[start:m.start()])
            start = m.end()
    return [p.strip() for p in [*parts, text[start:]]]


def _round(v):
    c = candidates(v)
    concepts = stored_concepts(v)
    return concepts, materialise(G.resolve_round(c, concepts, judge(c)), "resolved")


@query("g1_name_key", f"""
SELECT doc_id, md5({_KEY.format('text')}) AS name_key FROM documents""")
def g1(v):
    return v.documents.select("doc_id", F.md5(X.name_key(F.col("text"))).alias("name_key"))


@query("g2_exact_match", "SELECT candidate_no, exact_id AS concept_id FROM exact_hits")
def g2(v):
    concepts = v.concept_names.withColumn("normalized_name", X.name_key(F.col("canonical_name")))
    return G.exact_match(bare_candidates(v), concepts).select("candidate_no", "concept_id")


def _near(v):
    concepts, c = stored_concepts(v), candidates(v)
    rest = c.join(G.exact_match(c, concepts), G.CAND, "left_anti")
    return G.nearest_existing(rest, concepts)


@query("g3_nearest_existing", """
SELECT candidate_no, nearest_id AS concept_id, round(sim, 6) AS similarity FROM near_hits""")
def g3(v):
    return _near(v).select("candidate_no", "concept_id", r6("similarity"))


@query("g4_band_split", """
SELECT candidate_no, CASE WHEN round(sim, 9) >= 0.72 THEN 'ambiguous' ELSE 'new' END AS band
FROM near_hits""")
def g4(v):
    return _near(v).select("candidate_no", G.band(F.col("similarity")).alias("band"))


@query("g5_apply_verdicts", """
SELECT candidate_no, nearest_id, outcome, edge_type FROM judged_pairs""")
def g5(v):
    pairs = _near(v).filter(G.band(F.col("similarity")) == "ambiguous").select(
        "candidate_no", F.col("concept_id").alias("nearest_id"))
    return G.apply_verdicts(pairs, judge(bare_candidates(v))).select(
        "candidate_no", "nearest_id", "outcome", "edge_type")


@query("g6_verdict_completeness", """
SELECT user_id, paper_id, count(*) FILTER (WHERE candidate_no % 7 <> 3) AS pairs,
  count(*) FILTER (WHERE candidate_no % 6 <> 2) AS verdicts,
  count(*) FILTER (WHERE candidate_no % 7 <> 3 AND candidate_no % 6 = 2) AS unanswered,
  count(*) FILTER (WHERE candidate_no % 7 = 3 AND candidate_no % 6 <> 2) AS unasked
FROM candidates WHERE candidate_no % 7 <> 3 OR candidate_no % 6 <> 2 GROUP BY user_id, paper_id""")
def g6(v):
    c = bare_candidates(v)
    return G.verdict_gaps(c.filter("candidate_no % 7 <> 3"), c.filter("candidate_no % 6 <> 2"),
                          ["user_id", "paper_id"])


@query("g7_commit_matched", """
WITH g AS (SELECT concept_id, list(DISTINCT paper_id) AS papers, list_distinct(flatten(list(aliases
    ORDER BY candidate_no) FILTER (WHERE aliases IS NOT NULL))) AS extra
  FROM placed_candidates WHERE NOT created GROUP BY concept_id)
SELECT k.concept_id, CAST(len(list_distinct(list_concat(source_paper_ids, papers))) AS INTEGER)
    AS papers, array_to_string(list_sort(list_distinct(list_concat(aliases, coalesce(extra, [])))), '|')
    AS aliases
FROM keyed_concepts k JOIN g USING (concept_id)""")
def g7(v):
    concepts, resolved = _round(v)
    placed = G.locate(concepts, resolved)
    hit = placed.filter("NOT created").select("concept_id").distinct()
    after = G.commit_concepts(concepts, resolved).join(hit, "concept_id", "left_semi")
    return after.filter("merged_into_id IS NULL").select(
        "concept_id", F.size(F.array_distinct("source_paper_ids")).alias("papers"),
        F.array_join(F.array_sort("aliases"), "|").alias("aliases"))


@query("g8_commit_new", """
SELECT user_id, concept_id, left(arg_min(name, candidate_no), 200) AS canonical_name,
  min(name_key) AS normalized_name, CAST(count(DISTINCT paper_id) AS INTEGER) AS papers
FROM placed_candidates WHERE created GROUP BY user_id, concept_id""")
def g8(v):
    concepts, resolved = _round(v)
    after = G.commit_concepts(concepts, resolved)
    return after.join(concepts.select("concept_id"), "concept_id", "left_anti").select(
        "user_id", "concept_id", "canonical_name", "normalized_name",
        F.size("source_paper_ids").alias("papers"))


@query("g9_related_edges", """
SELECT user_id, source_concept_id, target_concept_id, relationship_type, round(confidence, 6)
  AS confidence FROM added_edges WHERE relationship_type <> 'prerequisite_of'""")
def g9(v):
    concepts, resolved = _round(v)
    out = G.new_edges(v.edges, G.related_edges(G.locate(concepts, resolved)))
    return out.select(*G.EDGE_KEY, r6("confidence"))


@query("g10_prerequisite_edges", """
SELECT user_id, source_concept_id, target_concept_id, relationship_type, round(confidence, 6)
  AS confidence FROM added_edges WHERE relationship_type = 'prerequisite_of'""")
def g10(v):
    concepts, resolved = _round(v)
    out = G.new_edges(v.edges, G.prerequisite_edges(G.locate(concepts, resolved)))
    return out.select(*G.EDGE_KEY, r6("confidence"))


@query("g11_run_result", """
SELECT user_id, count(*) FILTER (WHERE created AND nth = 1) AS created,
  count(*) FILTER (WHERE NOT created OR nth > 1) AS matched, coalesce(max(n), 0) AS edges
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, concept_id ORDER BY candidate_no) AS nth
      FROM placed_candidates) p
LEFT JOIN (SELECT user_id, count(*) AS n FROM added_edges GROUP BY user_id) a USING (user_id)
GROUP BY user_id""")
def g11(v):
    concepts, resolved = _round(v)
    placed = G.locate(concepts, resolved)
    proposed = G.related_edges(placed).unionByName(G.prerequisite_edges(placed))
    return G.run_result(placed, G.new_edges(v.edges, proposed))


@query("g12_merge_survivors", """
WITH RECURSIVE m AS (SELECT concept_id, merged_into_id FROM concepts),
walk AS (SELECT concept_id, concept_id AS cur FROM m
  UNION ALL SELECT w.concept_id, m.merged_into_id FROM walk w JOIN m ON m.concept_id = w.cur
  WHERE m.merged_into_id IS NOT NULL)
SELECT concept_id, cur AS survivor_id FROM walk WHERE NOT EXISTS (SELECT 1 FROM m
  WHERE m.concept_id = walk.cur AND m.merged_into_id IS NOT NULL)""")
def g12(v):
    return G.survivors(v.concept_links)


@query("g12_long_merge_chains", """
SELECT concept_id, min(CASE WHEN merged_into_id IS NULL THEN concept_id END) OVER (
    ORDER BY concept_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS survivor_id
FROM merge_chains""")
def g12_long(v):
    """Chains of up to forty merges."""
    return G.survivors(v.merge_chains)


_ROUND_VIEWS = ("candidates", "keyed_concepts", "concept_vectors", "candidate_vectors", "exact_hits", "near_hits",
                "judged_pairs", "placed_candidates", "proposed_edges", "added_edges", "edges")


def _unrolled(rounds: int) -> None:
    """Views of each round, every one over what the rounds before it left."""
    for r in range(1, rounds + 1):
        for name in _ROUND_VIEWS[2:-1]:
            text = ORACLE_VIEWS[name]
            for other in _ROUND_VIEWS:
                text = re.sub(rf"\b{other}\b", f"{other}_r{chr(96 + r)}", text)
            ORACLE_VIEWS[f"{name}_r{chr(96 + r)}"] = text
    for r in range(1, rounds + 1):
        this, past = f"_r{chr(96 + r)}", f"_r{chr(95 + r)}"
        ORACLE_VIEWS[f"candidates{this}"] = f"""
SELECT * REPLACE (paper_id + {r - 1} AS paper_id) FROM candidates WHERE candidate_no % 3 = {r - 1}"""
        if r == 1:
            ORACLE_VIEWS[f"keyed_concepts{this}"] = """
SELECT user_id, concept_id, canonical_name, normalized_name, aliases FROM keyed_concepts"""
            ORACLE_VIEWS[f"edges{this}"] = (
                "SELECT user_id, source_concept_id, target_concept_id, relationship_type FROM edges")
            continue
        ORACLE_VIEWS[f"keyed_concepts{this}"] = f"""
SELECT user_id, concept_id, canonical_name, normalized_name, list_concat(aliases, coalesce(extra, [])) AS aliases
FROM keyed_concepts{past} LEFT JOIN (SELECT concept_id, flatten(list(aliases)) AS extra FROM placed_candidates{past}
  WHERE NOT created AND aliases IS NOT NULL GROUP BY concept_id) g USING (concept_id)
UNION ALL SELECT user_id, concept_id, left(arg_min(name, candidate_no), 200), min(name_key),
  coalesce(arg_min(coalesce(aliases, []), candidate_no), [])
FROM placed_candidates{past} WHERE created GROUP BY user_id, concept_id"""
        ORACLE_VIEWS[f"edges{this}"] = f"""
SELECT * FROM edges{past} UNION ALL SELECT user_id, source_concept_id, target_concept_id, relationship_type
FROM added_edges{past}"""


_unrolled(4)


@query("g_canonicalise_rounds", """
SELECT c.user_id, absorbed + count(*) AS concepts, (sum(len(list_distinct(aliases))) + any_value(lost))::BIGINT AS aliases,
  any_value(e.edges) AS edges
FROM keyed_concepts_rd c
JOIN (SELECT user_id, count(*) FILTER (merged_into_id IS NOT NULL) AS absorbed,
    coalesce(sum(len(list_distinct(aliases))) FILTER (merged_into_id IS NOT NULL), 0) AS lost
  FROM concepts GROUP BY user_id) a USING (user_id)
JOIN (SELECT user_id, count(*) AS edges FROM edges_rd GROUP BY user_id) e USING (user_id)
GROUP BY c.user_id, absorbed""")
def rounds(v):
    """The full loop: three arrivals per reader, each seeing what the last one committed."""
    c = candidates(v).withColumn("arrival", F.col("candidate_no") % 3).withColumn(
        "paper_id", F.col("paper_id") + F.col("arrival"))
    grown = G.grow(c, G.unfold(stored_concepts(v), v.edges), judge)
    rows = grown.aliases.groupBy("user_id", "concept_id", "alias").count()
    names = rows.groupBy("user_id").agg(F.count("*").alias("aliases"))
    per = grown.edges.groupBy("user_id").agg(F.count("*").alias("edges"))
    return grown.concepts.groupBy("user_id").agg(F.count("*").alias("concepts")).join(names, "user_id").join(
        per, "user_id")


@query("a12_rebuild_concepts", f"""
WITH keyed AS (SELECT *, left({_KEY.format('name')}, 200) AS name_key FROM candidates WHERE user_id % 2 = 0),
links AS (SELECT DISTINCT w.user_id, s.name_key AS source_key, w.name_key AS target_key
  FROM (SELECT *, unnest(prerequisites) AS wanted FROM keyed) w
  JOIN keyed s ON s.user_id = w.user_id AND s.paper_id = w.paper_id AND s.name = w.wanted
  WHERE s.name_key <> w.name_key)
SELECT user_id, count(DISTINCT name_key) AS concepts, count(DISTINCT paper_id || '|' || name_key) AS sources,
  coalesce(any_value(n), 0) AS edges
FROM keyed LEFT JOIN (SELECT user_id, count(*) AS n FROM links GROUP BY user_id) l USING (user_id) GROUP BY user_id
UNION ALL SELECT c.user_id, count(*), sum(len(list_distinct(source_paper_ids)))::BIGINT, any_value(n)
FROM concepts c LEFT JOIN (SELECT user_id, count(*) AS n FROM edges GROUP BY user_id) e ON e.user_id = c.user_id
WHERE c.user_id % 2 = 1 GROUP BY c.user_id""")
def a12(v):
    """Forget every other reader's concepts and derive them again from stored candidates; the rest stay."""
    who = v.users.filter("user_id % 2 = 0").select("user_id")
    c = candidates(v).withColumn("arrival", F.lit(0))
    concepts, edges = G.rebuild(who, c, stored_concepts(v), v.edges, judge)
    per = edges.groupBy("user_id").agg(F.count("*").alias("edges"))
    return concepts.groupBy("user_id").agg(
        F.count("*").alias("concepts"), F.sum(F.size(F.array_distinct("source_paper_ids"))).alias("sources")).join(
        per, "user_id", "left").fillna({"edges": 0})
