"""Section C queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark import vocab as V
from quillmark.functions import expr as X
from quillmark.functions.shared import new_path
from quillmark.operators import ann as A
from quillmark.operators import chunking as C
from quillmark.operators import retrieval as R
from quillmark.plans.common import r6, us
from quillmark.plans.registry import query
from quillmark.plans.views import ACTIVE_MODEL, DIM, ORACLE_VIEWS, words

FLOOR = 0.25

ORACLE_VIEWS["live_scope"] = """
SELECT user_id, paper_id FROM user_paper_access WHERE revoked_at IS NULL"""
ORACLE_VIEWS["active_items"] = f"""
SELECT * FROM chunks WHERE is_indexable AND embedding IS NOT NULL AND paper_id IN
  (SELECT paper_id FROM papers WHERE embedding_model = '{ACTIVE_MODEL}')"""


def _retrieve_oracle(where: str = "1 = 1") -> str:
    return f"""
WITH asked AS (SELECT query_id, user_id, query_vector::DOUBLE[] AS qv,
    CASE WHEN section_role IN ({words(V.SECTION_ROLE)}) THEN section_role END AS role,
    least(10, greatest(1, coalesce(top_k, 8))) AS k, coalesce(floor_arg, {FLOOR}) AS floor
  FROM queries WHERE trim(query_text) <> ''),
scored AS (SELECT a.query_id, a.user_id, a.k, a.floor, c.chunk_id, c.paper_id, c.content_hash,
    c.section_role, list_cosine_similarity(a.qv, c.embedding::DOUBLE[]) AS sim
  FROM asked a JOIN live_scope s ON s.user_id = a.user_id
  JOIN active_items c ON c.paper_id = s.paper_id
  WHERE (a.role IS NULL OR a.role = c.section_role) AND {where}),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, chunk_id)
  AS near_rank FROM scored),
once AS (SELECT *, row_number() OVER (PARTITION BY query_id, content_hash ORDER BY near_rank)
  AS copy_no FROM near WHERE near_rank <= 3 * k AND round(sim, 9) >= floor),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY near_rank) AS rank_no
  FROM once WHERE copy_no = 1)
SELECT query_id, chunk_id, paper_id, section_role, CAST(rank_no AS INTEGER) AS rank_no,
  round(sim, 6) AS similarity FROM ranked WHERE rank_no <= k"""


_SHELVED: dict[tuple, R.Shelved] = {}


def _shelved(v):
    """The searchable chunks as a deployment keeps them, stored once a session."""
    key = v._key("shelved")
    if key not in _SHELVED:
        _SHELVED[key] = R.shelve(v.chunks, v.papers, ACTIVE_MODEL)
    return _SHELVED[key]


def _results(v, queries=None):
    scoped = R.scope(v.user_paper_access)
    return R.retrieve(v.queries if queries is None else queries, scoped, _shelved(v), ACTIVE_MODEL, FLOOR)


_SHOW = ("query_id", "chunk_id", "paper_id", "section_role", "rank_no", "similarity")
_REQUESTED = """SELECT DISTINCT user_id, (event_id * 3) % (SELECT max(n) FROM doc_count) AS paper_id
  FROM events"""


@query("c1_authorised_scope", f"""
SELECT user_id, paper_id FROM live_scope SEMI JOIN ({_REQUESTED}) r USING (user_id, paper_id)
WHERE paper_id IN (SELECT paper_id FROM papers WHERE embedding_model = '{ACTIVE_MODEL}')""")
def c1(v):
    return R.scope(v.user_paper_access, v.papers, v.sql(_REQUESTED), ACTIVE_MODEL)


@query("c2_stale_scope", f"""
SELECT user_id, paper_id FROM live_scope WHERE paper_id IN (SELECT paper_id FROM papers
  WHERE embedding_model IS DISTINCT FROM '{ACTIVE_MODEL}')""")
def c2(v):
    return R.stale_scope(v.user_paper_access, v.papers, ACTIVE_MODEL)


@query("c3_cosine", """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)
  AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def c3(v):
    """Each vector against its successor."""
    b = v.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return v.embeddings.join(b, "vec_id").select(
        "vec_id", r6(X.cosine(F.col("embedding"), F.col("next")), "similarity"))


@query("c4_filtered_top_k", _retrieve_oracle())
def c4(v):
    """Every stored query over everything its reader may see."""
    return _results(v).select(*_SHOW)


@query("c5_floor_precedence", """
SELECT query_id, coalesce(floor_arg, CASE WHEN query_id % 2 = 0 THEN 0.25 ELSE 0.58 END) AS floor
FROM queries""")
def c5(v):
    arg = F.col("floor_arg")
    return v.queries.select("query_id", F.when(
        F.col("query_id") % 2 == 0, R.floor_for(arg, None, "hashing")).otherwise(
        R.floor_for(arg, None, ACTIVE_MODEL)).alias("floor"))


@query("c6_role_restricted", _retrieve_oracle("a.role IS NOT NULL"))
def c6(v):
    """Only the queries that name a real role."""
    return _results(v, v.queries.filter(F.col("section_role").isin(*V.SECTION_ROLE))).select(*_SHOW)


@query("c7_scope_post_condition", "SELECT CAST(0 AS BIGINT) AS outside")
def c7(v):
    scoped = R.scope(v.user_paper_access)
    checked = R.assert_scoped(_results(v), scoped)
    return R.out_of_scope(checked, scoped).agg(F.count("*").alias("outside"))


@query("c8_citation_locator", """
SELECT chunk_id, section_path || ', ' || CASE WHEN c.page_start = c.page_end
  THEN 'p.' || CAST(c.page_start AS VARCHAR)
  ELSE 'pp.' || CAST(c.page_start AS VARCHAR) || '-' || CAST(c.page_end AS VARCHAR) END AS locator
FROM chunks c JOIN sections s USING (section_id)""")
def c8(v):
    s = v.sections.select("section_id", "section_path")
    return v.chunks.join(s, "section_id").select("chunk_id", X.locator(
        F.col("section_path"), F.col("page_start"), F.col("page_end")).alias("locator"))


def _open_search(v):
    return v.queries, R.searchable(v.chunks, v.papers, ACTIVE_MODEL)


_INDEXES: dict[tuple, A.Index | None] = {}


def _index(v):
    """The stored index over all searchable chunks, built once a session as a deployment keeps it."""
    key = v._key("ann_index")
    if key not in _INDEXES:
        _, items = _open_search(v)
        _INDEXES[key] = A.build(items, 8, F.col("section_role"))
    return _INDEXES[key]


@query("c9_approximate_search")
def c9(v):
    return A.search(v.queries, _index(v), 8)


@query("c9_widened_search", f"""
SELECT q.query_id, least(8, count(i.chunk_id)) AS found, count(i.chunk_id) > 0 AS answered
FROM queries q LEFT JOIN active_items i ON i.section_role = q.section_role
WHERE q.section_role IN ({words(V.SECTION_ROLE)}) GROUP BY q.query_id""")
def c9w(v):
    """Queries for one role: however few chunks have it, none of them is missed for want of probing."""
    asked = v.queries.filter(F.col("section_role").isin(*V.SECTION_ROLE))
    hits = A.search(asked, _index(v), 8, F.col("section_role"))
    roles = v.chunks.select("chunk_id", "section_role")
    right = hits.join(roles, "chunk_id").groupBy("query_id", "section_role").agg(F.count_distinct("chunk_id").alias("n"))
    return asked.select("query_id", "section_role").join(right, ["query_id", "section_role"], "left").select(
        "query_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("found"), F.col("n").isNotNull().alias("answered"))


@query("c10_exact_top_k", """
SELECT query_id, chunk_id, CAST(rank_no AS INTEGER) AS rank_no, round(sim, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, chunk_id) AS rank_no
  FROM (SELECT query_id, chunk_id,
      list_cosine_similarity(query_vector::DOUBLE[], embedding::DOUBLE[]) AS sim
    FROM queries, active_items) a) b WHERE rank_no <= 8""")
def c10e(v):
    q, items = _open_search(v)
    return R.exact_top_k(q, items, 8).select("query_id", "chunk_id", "rank_no", r6("similarity"))


def _recalls(v):
    q, items = _open_search(v)
    return R.recall(A.search(q, _index(v), 8), R.exact_top_k(q, items, 8))


@query("c10_recall_report")
def c10(v):
    return _recalls(v)


@query("c10_recall_reached", """
SELECT count(DISTINCT query_id) AS queries, count(*) AS wanted, true AS found_nine_tenths
FROM (SELECT query_id, chunk_id FROM queries, active_items
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) <= 8) e""")
def c10r(v):
    """Over all queries: at least 0.9 of the exact neighbours are found."""
    return _recalls(v).agg(
        F.count("*").alias("queries"), F.sum("wanted").alias("wanted"),
        (F.sum("found") >= 0.9 * F.sum("wanted")).alias("found_nine_tenths"))


_SEARCHES = """SELECT turn_id, search_no, rank_no, (chunk_id + 3 * (search_no - 1)) % v AS chunk_id,
  similarity FROM (SELECT *, <<explode 1, 2, 3>> AS search_no,
    (SELECT max(vec_id) + 1 FROM embeddings) AS v FROM retrieval_sets) q"""


def _both(text):
    from quillmark.plans.views import _DUCK, _SPARK, dialect

    return dialect(text, _SPARK), dialect(text, _DUCK)


_SEARCHES_SPARK, _SEARCHES_DUCK = _both(_SEARCHES)


@query("c11_turn_retrieval_set", f"""
SELECT turn_id, chunk_id, CAST(rank_no AS INTEGER) AS rank_no, similarity,
  '[' || CAST(rank_no AS VARCHAR) || ']' AS marker
FROM (SELECT turn_id, chunk_id, similarity,
    row_number() OVER (PARTITION BY turn_id ORDER BY search_no, pos) AS rank_no
  FROM (SELECT turn_id, chunk_id, search_no, rank_no AS pos, similarity,
      row_number() OVER (PARTITION BY turn_id, chunk_id ORDER BY search_no, rank_no) AS seen
    FROM ({_SEARCHES_DUCK}) s) a WHERE seen = 1) b""")
def c11(v):
    return R.turn_set(v.sql(_SEARCHES_SPARK))


@query("c13_widened_scope", """
SELECT t.turn_id, t.user_id, t.paper_id FROM (
  SELECT turn_id, user_id, paper_id FROM raw_turns
  UNION SELECT turn_id, user_id, (turn_id * 5 + 1) % (SELECT max(n) FROM doc_count) FROM raw_turns
  WHERE callback_concept_id IS NOT NULL) t SEMI JOIN live_scope USING (user_id, paper_id)""")
def c13(v):
    decisions = v.sql("""SELECT turn_id, user_id, CASE WHEN callback_concept_id IS NOT NULL THEN
      (turn_id * 5 + 1) % (SELECT max(n) FROM doc_count) END AS prior_paper_id FROM raw_turns""")
    return R.widen(v.raw_turns, decisions, R.scope(v.user_paper_access)).select(
        "turn_id", "user_id", "paper_id")


@query("c14_index_state", f"""
SELECT embedding_model, processing_status, count(*) AS papers,
  CASE WHEN embedding_model = '{ACTIVE_MODEL}' THEN 'ok' ELSE 'STALE' END AS state
FROM papers GROUP BY embedding_model, processing_status""")
def c14(v):
    return R.index_state(v.papers, ACTIVE_MODEL)


@query("c15_stale_set", f"""
SELECT paper_id, epoch_us(created_at) AS created_at FROM papers
WHERE processing_status IN ('ready', 'partially_ready')
  AND embedding_model IS DISTINCT FROM '{ACTIVE_MODEL}'""")
def c15(v):
    return R.reindex_set(v.papers, ACTIVE_MODEL).select("paper_id", us("created_at"))


@query("c15_reindex_rerun", f"""
SELECT count(*) FILTER (WHERE processing_status IN ('ready', 'partially_ready')
    AND embedding_model IS DISTINCT FROM '{ACTIVE_MODEL}') AS first_run,
  CAST(0 AS BIGINT) AS second_run FROM papers""")
def c15r(v):
    """Embed the stale papers again, store the outcome, and look for stale ones once more."""
    embed = lambda rows: C.hash_vectors(rows, "chunk_id", "content", DIM)
    papers, chunks = R.reindex(v.papers, v.chunks, ACTIVE_MODEL, embed)
    root = new_path(v.spark, "reindex")
    papers.write.parquet(f"{root}/papers")
    chunks.write.parquet(f"{root}/chunks")
    stored = v.spark.read.parquet(f"{root}/papers")
    first = R.reindex_set(v.papers, ACTIVE_MODEL).select(F.lit(1).alias("run"))
    second = R.reindex_set(stored, ACTIVE_MODEL).select(F.lit(2).alias("run"))
    return first.unionByName(second).agg(
        F.count_if(F.col("run") == 1).alias("first_run"),
        F.count_if(F.col("run") == 2).alias("second_run"))


@query("c16_listing_flags", f"""
SELECT paper_id, processing_status IN ('ready', 'partially_ready')
    AND embedding_model IS DISTINCT FROM '{ACTIVE_MODEL}' AS needs_reindex,
  processing_status IN ('queued', 'processing')
    AND TIMESTAMP '2024-02-01 00:00:00' - updated_at > INTERVAL 3 MINUTE AS stalled FROM papers""")
def c16(v):
    return R.listing_flags(v.papers, ACTIVE_MODEL, v.as_of()).select(
        "paper_id", "needs_reindex", "stalled")
