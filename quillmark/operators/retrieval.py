"""Permission-scoped similarity search and index upkeep (section C)."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark import vocab as V
from quillmark.functions import expr as X
from quillmark.functions.shared import materialise, new_path, store
from quillmark.functions.shelves import QUERIES, SHELF, lay, meet, shelf_of
from quillmark.functions.similarity import blocked_top_k, order_key

OVERFETCH = 3
SHELVES_A_BUCKET = 16
MAX_BUCKETS = 20_000


def scope(grants: DataFrame, papers: DataFrame | None = None, requested: DataFrame | None = None,
          model: str | None = None) -> DataFrame:
    """(user, paper) pairs a read may touch: live grants, narrowed but never widened."""
    live = grants.filter(F.col("revoked_at").isNull()).select("user_id", "paper_id")
    if requested is not None:
        live = live.join(requested.select("user_id", "paper_id").distinct(),
                         ["user_id", "paper_id"], "left_semi")
    if model is not None:
        current = papers.filter(F.col("embedding_model") == model).select("paper_id")
        live = live.join(current, "paper_id", "left_semi").select("user_id", "paper_id")
    return live


def is_stale(embedding_model: Column, active: str) -> Column:
    return ~embedding_model.eqNullSafe(F.lit(active))


def stale_scope(grants: DataFrame, papers: DataFrame, active: str) -> DataFrame:
    stale = papers.filter(is_stale(F.col("embedding_model"), active)).select("paper_id")
    return scope(grants).join(stale, "paper_id", "left_semi").select("user_id", "paper_id")


def floor_for(argument: Column, override: float | None, model: str) -> Column:
    """Argument, then configured override, then the model's own default."""
    return F.coalesce(argument, F.lit(override).cast("double"), F.lit(V.FLOOR_OF_MODEL[model]))


def clamp_requests(queries: DataFrame, override: float | None, model: str) -> DataFrame:
    """Bounded parameters; blank queries drop out, unknown roles restrict nothing."""
    text = F.substring(F.trim("query_text"), 1, V.QUERY_CHARS)
    return queries.withColumn("query_text", text).filter(F.col("query_text") != "").select(
        "query_id", "user_id", "query_vector",
        F.when(F.col("section_role").isin(*V.SECTION_ROLE), F.col("section_role")).alias("role"),
        F.least(F.lit(V.MAX_TOP_K), F.greatest(
            F.lit(1), F.coalesce("top_k", F.lit(V.DEFAULT_TOP_K)))).alias("k"),
        floor_for(F.col("floor_arg"), override, model).alias("floor"))


def searchable(chunks: DataFrame, papers: DataFrame, active: str) -> DataFrame:
    """Indexable, embedded chunks of papers embedded by the active model."""
    current = papers.filter(F.col("embedding_model") == active).select("paper_id")
    return chunks.filter(F.col("is_indexable") & F.col("embedding").isNotNull()).join(
        current, "paper_id", "left_semi")


class Shelved(NamedTuple):
    """Searchable chunks at rest: a table bucketed by shelf, and (cell, first, shelves) of each paper."""

    chunks: str
    papers: str


def shelve(chunks: DataFrame, papers: DataFrame, active: str, shelf: int = SHELF) -> Shelved:
    """Store the chunks a search may find, papers side by side on shelves, vectors scaled to length 1."""
    spark = chunks.sparkSession
    vec = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda acc, x: acc + x * x))
    items = searchable(chunks, papers, active).withColumn("_v", vec).filter(F.exists("_v", lambda x: x != 0)).withColumn(
        "_n", norm).withColumn("unit", F.transform("_v", lambda x: x / F.col("_n")))
    sizes = items.groupBy(F.col("paper_id").alias("cell")).agg(F.count("*").alias("rows"))
    laid = materialise(lay(sizes, shelf), "laid-papers")
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    buckets = max(8, min(MAX_BUCKETS, -(-total // (shelf * SHELVES_A_BUCKET))))
    name = f"shelved_{uuid.uuid4().hex}"
    placed = items.join(laid, F.col("paper_id") == F.col("cell")).select(
        shelf_of("chunk_id").alias("shelf"), "cell", "chunk_id", "unit", "section_role", "paper_id", "section_id",
        "content_hash", "page_start", "page_end")
    placed.repartition(buckets, "shelf").sortWithinPartitions("shelf").write.bucketBy(buckets, "shelf").sortBy(
        "shelf").option("path", new_path(spark, "shelved")).saveAsTable(name)
    return Shelved(name, store(laid, "laid"))


def retrieve(queries: DataFrame, scoped: DataFrame, shelved: Shelved, active: str,
             override: float | None = None) -> DataFrame:
    """Filtered top-k per query.

    Scope, visibility, model and role are applied before scoring. The nearest
    3k are kept first, then the floor, then one row per content, then k.

    A reader's papers become a list for each shelf they lie on, and a query
    goes once to every such shelf. Stored vectors stay in their buckets; only
    the best of a shelf leave it, and chunk details are joined for those alone.
    """
    spark = queries.sparkSession
    asked = clamp_requests(queries, override, active)
    stored, laid = spark.table(shelved.chunks), spark.read.parquet(shelved.papers)
    last = F.col("first") + F.col("shelves") - 1
    # at most a shelf's rows: a shelf holds no more papers than that
    views = scoped.distinct().join(laid, F.col("paper_id") == F.col("cell")).select(
        "user_id", "cell", F.explode(F.sequence("first", last)).alias("shelf")).groupBy("user_id", "shelf").agg(
        F.collect_list("cell").alias("probe"))
    some = F.exists(F.col("query_vector"), lambda x: x != 0)
    sent = asked.filter(F.col("query_vector").isNotNull() & some).join(views, "user_id").select(
        "shelf", F.col("query_id").alias("query_key"), F.col("role").alias("tag"),
        F.col("query_vector").cast("array<double>").alias("vec"), "probe")
    items = stored.select(
        "shelf", "cell", F.col("chunk_id").alias("item_key"), F.col("section_role").alias("tag"), "unit")
    near = meet(sent, items, OVERFETCH * V.MAX_TOP_K, QUERIES).withColumnsRenamed(
        {"query_key": "query_id", "item_key": "chunk_id"})
    by_query = Window.partitionBy("query_id").orderBy(
        F.desc(order_key(F.col("similarity"))), "chunk_id")
    limits = asked.select("query_id", "user_id", "k", "floor")
    cut = (
        near.withColumn("near_rank", F.row_number().over(by_query))
        .filter(F.col("near_rank") <= OVERFETCH * V.MAX_TOP_K)
        .join(limits, "query_id")
        .filter((F.col("near_rank") <= OVERFETCH * F.col("k"))
                & (F.round("similarity", 9) >= F.col("floor")))
    )
    detail = stored.select("chunk_id", "paper_id", "section_id", "content_hash", "section_role",
                           "page_start", "page_end")
    full = cut.join(detail, "chunk_id")
    copies = Window.partitionBy("query_id", "content_hash").orderBy("near_rank")
    final = Window.partitionBy("query_id").orderBy("near_rank")
    return (
        full.withColumn("copy_no", F.row_number().over(copies)).filter(F.col("copy_no") == 1)
        .withColumn("rank_no", F.row_number().over(final)).filter(F.col("rank_no") <= F.col("k"))
        .select("query_id", "user_id", "chunk_id", "paper_id", "section_id", "section_role",
                "page_start", "page_end", "rank_no", F.round("similarity", 6).alias("similarity"))
    )


def out_of_scope(results: DataFrame, scoped: DataFrame) -> DataFrame:
    return results.join(scoped, ["user_id", "paper_id"], "left_anti")


def assert_scoped(results: DataFrame, scoped: DataFrame) -> DataFrame:
    """Same rows; a row outside the scope fails the job when it runs."""
    marked = results.join(
        scoped.select("user_id", "paper_id").distinct().withColumn("_ok", F.lit(True)),
        ["user_id", "paper_id"], "left")
    guard = F.assert_true(F.col("_ok").isNotNull(), F.lit("retrieval left the authorised scope"))
    return marked.withColumn("_guard", guard).filter(F.col("_guard").isNull()).drop(
        "_ok", "_guard").select(*results.columns)


def exact_top_k(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Nearest k over all given chunks, scored block by block."""
    near = blocked_top_k(queries, chunks, [], "query_id", "chunk_id", "query_vector",
                         "embedding", k)
    return best(near, k)


def best(near: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(order_key(F.col("similarity"))), "chunk_id")
    return near.withColumn("rank_no", F.row_number().over(w)).filter(F.col("rank_no") <= k)


def recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Per query: share of the exact neighbours found, and how many were missed."""
    hit = approx.select("query_id", "chunk_id").withColumn("hit", F.lit(1))
    return exact.join(hit, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(
        F.count("*").alias("wanted"), F.count("hit").alias("found")).select(
        "query_id", "wanted", "found", (F.col("wanted") - F.col("found")).alias("missed"),
        (F.col("found") / F.col("wanted")).alias("recall"))


def turn_set(searches: DataFrame) -> DataFrame:
    """All passages of a turn: first sighting fixes the position, markers run on."""
    first = searches.groupBy("turn_id", "chunk_id").agg(
        F.min(F.struct("search_no", "rank_no")).alias("at"),
        F.min_by("similarity", F.struct("search_no", "rank_no")).alias("similarity"))
    w = Window.partitionBy("turn_id").orderBy("at")
    return first.withColumn("rank_no", F.row_number().over(w)).select(
        "turn_id", "chunk_id", "rank_no", "similarity",
        F.format_string("[%d]", F.col("rank_no")).alias("marker"))


def widen(active: DataFrame, decisions: DataFrame, authorised: DataFrame) -> DataFrame:
    """Scope of a turn plus the one earlier paper a callback may reach."""
    prior = decisions.filter(F.col("prior_paper_id").isNotNull()).select(
        "turn_id", "user_id", F.col("prior_paper_id").alias("paper_id"))
    both = active.select("turn_id", "user_id", "paper_id").unionByName(prior).distinct()
    return both.join(authorised, ["user_id", "paper_id"], "left_semi")


def index_state(papers: DataFrame, active: str) -> DataFrame:
    return papers.groupBy("embedding_model", "processing_status").agg(
        F.count("*").alias("papers")).withColumn(
        "state", F.when(is_stale(F.col("embedding_model"), active), "STALE").otherwise("ok"))


def reindex_set(papers: DataFrame, active: str) -> DataFrame:
    """Papers to embed again, oldest first."""
    stale = papers.filter(
        F.col("processing_status").isin("ready", "partially_ready")
        & is_stale(F.col("embedding_model"), active))
    return stale.select("paper_id", "created_at").orderBy("created_at", "paper_id")


def reindex(papers: DataFrame, chunks: DataFrame, active: str, embed) -> tuple[DataFrame, DataFrame]:
    """Fresh vectors for stale papers only; concepts are left alone.

    ``embed`` maps (chunk_id, content) rows to (chunk_id, vector).
    """
    todo = reindex_set(papers, active).select("paper_id")
    mine = chunks.filter("is_indexable").join(todo, "paper_id", "left_semi")
    vectors = embed(mine.select("chunk_id", "content")).withColumnRenamed("vector", "_new")
    cols = chunks.columns
    refreshed = chunks.join(vectors, "chunk_id", "left").withColumn(
        "embedding", F.coalesce(F.col("_new").cast("array<float>"), F.col("embedding"))
    ).select(*cols)
    hit = todo.withColumn("_hit", F.lit(True))
    done = papers.join(hit, "paper_id", "left").withColumn(
        "embedding_model", F.when(F.col("_hit"), F.lit(active)).otherwise(
            F.col("embedding_model"))).drop("_hit").select(*papers.columns)
    return done, refreshed


def listing_flags(papers: DataFrame, active: str, as_of: Column) -> DataFrame:
    """Needs new vectors; or has sat in a working state for three minutes."""
    working = F.col("processing_status").isin("queued", "processing")
    idle = X.micros(as_of) - X.micros(F.col("updated_at"))
    answerable = F.col("processing_status").isin("ready", "partially_ready")
    return papers.withColumns({
        "needs_reindex": answerable & is_stale(F.col("embedding_model"), active),
        "stalled": working & (idle > 180_000_000)})
