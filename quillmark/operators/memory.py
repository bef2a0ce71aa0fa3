"""Reading a learner's concepts and walking the concept graph (section F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark import vocab as V
from quillmark.functions import expr as X
from quillmark.functions.running import newest
from quillmark.functions.similarity import blocked_top_k, order_key
from quillmark.operators import asof, learner

PREFETCH = 5
LIST_LIMIT = 300


def live(concepts: DataFrame) -> DataFrame:
    return concepts.filter(F.col("merged_into_id").isNull())


def scored(concepts: DataFrame, as_of: Column) -> DataFrame:
    """Read-time score and weakness next to the stored columns."""
    score = X.effective_score(F.col("user_override_score"), F.col("understanding_score"),
                              F.col("last_reinforced_at"), as_of)
    return concepts.withColumn("score", F.round(score, 9)).withColumn(
        "is_weak", X.is_weak(F.col("score"), F.col("score_confidence")))


def nearest(queries: DataFrame, concepts: DataFrame, limit: int = PREFETCH,
            floor: float = 0.25) -> DataFrame:
    """Closest concepts of the asking reader: limit first, then the floor."""
    near = blocked_top_k(
        queries, live(concepts), ["user_id"], "query_id", "concept_id", "query_vector",
        "embedding", limit)
    w = Window.partitionBy("query_id").orderBy(
        F.desc(order_key(F.col("similarity"))), "concept_id")
    return near.withColumn("rank_no", F.row_number().over(w)).filter(
        (F.col("rank_no") <= limit) & (F.round("similarity", 9) >= floor))


def by_name(requests: DataFrame, concepts: DataFrame, floor: float = 0.25) -> DataFrame:
    """Exact name or alias, else the single nearest concept."""
    named = requests.filter(F.trim("concept_name") != "").withColumn(
        "concept_name", F.trim("concept_name"))
    exact = learner.recall(named.withColumnRenamed("query_id", "signal_id"), concepts)
    exact = exact.withColumnRenamed("signal_id", "query_id")
    missing = exact.filter(F.col("matched_concept_id").isNull())
    guess = nearest(missing, concepts, 1, floor).select(
        "query_id", F.col("concept_id").alias("near_id"))
    return exact.join(guess, "query_id", "left").select(
        "query_id", "user_id",
        F.coalesce("matched_concept_id", "near_id").alias("concept_id"),
        F.when(F.col("matched_concept_id").isNotNull(), "exact")
        .when(F.col("near_id").isNotNull(), "nearest").otherwise("none").alias("how"))


def both_ways(edges: DataFrame) -> DataFrame:
    kept = ("user_id", "relationship_type", "confidence")
    out = edges.select(*kept, F.col("source_concept_id").alias("near"),
                       F.col("target_concept_id").alias("far"))
    back = edges.select(*kept, F.col("target_concept_id").alias("near"),
                        F.col("source_concept_id").alias("far"))
    return out.unionByName(back)


def neighbours(roots: DataFrame, edges: DataFrame, concepts: DataFrame, depth: int = 1) -> DataFrame:
    """Edges around each call's roots, keyed by the near node; absorbed concepts drop out.

    The second hop starts from concepts not seen before, and may list the edge
    back to where it came from.
    """
    names = live(concepts).select(F.col("concept_id").alias("far"),
                                  F.col("canonical_name").alias("far_name"))
    graph = both_ways(edges).join(names, "far")
    frontier = roots.select("call_id", "user_id", F.col("concept_id").alias("near")).distinct()
    first = frontier.join(graph, ["user_id", "near"]).withColumn("hop", F.lit(1))
    if depth <= 1:
        return first
    fresh = first.select("call_id", "user_id", F.col("far").alias("near")).distinct().join(
        frontier, ["call_id", "user_id", "near"], "left_anti")
    second = fresh.join(graph, ["user_id", "near"]).withColumn("hop", F.lit(2))
    return first.unionByName(second)


def prefetch(queries: DataFrame, concepts: DataFrame, edges: DataFrame, history: DataFrame) -> DataFrame:
    """Nearest concepts, their score when the query was asked, and one row per related concept.

    Queries carry ``asked_at``; ``history`` is ``asof.intervals``.
    """
    names = concepts.select("concept_id", "canonical_name")
    near = nearest(queries, concepts).join(queries.select("query_id", "user_id", F.col("asked_at").alias("at")), "query_id")
    hits = asof.scored_at(near, history, concepts).join(names, "concept_id")
    roots = hits.select(F.col("query_id").alias("call_id"), "user_id", "concept_id")
    related = neighbours(roots, edges, concepts).select(
        F.col("call_id").alias("query_id"), F.col("near").alias("concept_id"),
        F.col("far").alias("related_id"), "relationship_type",
        F.col("confidence").alias("edge_confidence"))
    return hits.join(related, ["query_id", "concept_id"], "left")


def all_for_reader(concepts: DataFrame, as_of: Column, limit: int = LIST_LIMIT) -> DataFrame:
    order = [F.desc("evidence_count"), F.asc_nulls_last("understanding_score"),
             F.asc("canonical_name"), F.asc("concept_id")]
    return newest(scored(live(concepts), as_of), ["user_id"], order, limit)


def weakest(concepts: DataFrame, as_of: Column, limit: int = PREFETCH,
            only_weak: bool = False) -> DataFrame:
    """Confident concepts by stored score; decay and the weak filter come after the limit."""
    sure = live(concepts).filter(F.col("score_confidence") >= V.CONFIDENCE_FLOOR)
    order = [F.asc_nulls_last("understanding_score"), F.asc("concept_id")]
    out = scored(newest(sure, ["user_id"], order, limit), as_of)
    return out.filter("is_weak") if only_weak else out


def latest_note(observations: DataFrame) -> DataFrame:
    return observations.filter(F.col("note").isNotNull()).groupBy("concept_id").agg(
        F.max_by("note", F.struct("observed_at", "observation_id")).alias("evidence_note"))


def trail(observations: DataFrame, n: int = 5) -> DataFrame:
    return newest(observations, ["concept_id"],
                  [F.desc("observed_at"), F.desc("observation_id")], n)


def visible_papers(concepts: DataFrame, scoped: DataFrame, papers: DataFrame) -> DataFrame:
    """Source papers the reader may still read, one row each."""
    sources = concepts.select(
        "user_id", "concept_id", F.explode(F.array_distinct("source_paper_ids")).alias("paper_id"))
    return sources.join(scoped, ["user_id", "paper_id"], "left_semi").join(
        papers.select("paper_id", "title"), "paper_id")


def compact(concepts: DataFrame, observations: DataFrame, as_of: Column) -> DataFrame:
    """The record handed on: two decimals, a date, one note."""
    return scored(live(concepts), as_of).join(latest_note(observations), "concept_id", "left").select(
        "user_id", "concept_id", "canonical_name",
        F.round("score", 2).alias("understanding_score"),
        F.round("score_confidence", 2).alias("score_confidence"), "effective_style",
        F.date_format("last_reinforced_at", "yyyy-MM-dd").alias("last_seen"), "evidence_count",
        "evidence_note")


def detail(concepts: DataFrame, observations: DataFrame, edges: DataFrame, scoped: DataFrame,
           papers: DataFrame, as_of: Column, n: int = 20) -> DataFrame:
    """One concept's page as long rows: its evidence, papers and neighbours by ``part``."""
    base = scored(live(concepts), as_of).select("user_id", "concept_id", "score", "is_weak")
    seen = trail(observations, n).select(
        "concept_id", F.lit("evidence").alias("part"), F.col("rank_no").cast("bigint").alias("pos"),
        F.col("signal_type").alias("item"),
        F.col("resolves_observation_id").isNotNull().alias("resolved_a_struggle"))
    shown = visible_papers(concepts, scoped, papers).select(
        "concept_id", F.lit("paper").alias("part"), F.col("paper_id").alias("pos"),
        F.col("title").alias("item"), F.lit(None).cast("boolean").alias("resolved_a_struggle"))
    around = neighbours(base.select(F.col("concept_id").alias("call_id"), "user_id", "concept_id"),
                        edges, concepts).select(
        F.col("near").alias("concept_id"), F.lit("related").alias("part"),
        F.col("far").alias("pos"), F.col("relationship_type").alias("item"),
        F.lit(None).cast("boolean").alias("resolved_a_struggle"))
    parts = seen.unionByName(shown).unionByName(around)
    return base.join(parts, "concept_id")


def graph_nodes(concepts: DataFrame, as_of: Column, limit: int = LIST_LIMIT) -> DataFrame:
    """The first concepts met. Decay shows only where the stored score is trusted."""
    first = newest(live(concepts), ["user_id"], [F.asc("first_seen_at"), F.asc("concept_id")], limit)
    trusted = weakest(concepts, as_of, limit).select(
        "concept_id", F.col("score").alias("decayed"), F.col("is_weak").alias("weak_now"))
    raw_weak = X.is_weak(F.col("understanding_score"), F.col("score_confidence"))
    return first.join(trusted, "concept_id", "left").withColumns({
        "shown_score": F.when(F.col("weak_now").isNotNull(), F.col("decayed"))
        .otherwise(F.col("understanding_score")),
        "shown_weak": F.coalesce("weak_now", raw_weak)})


def graph_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    src = nodes.select(F.col("concept_id").alias("source_concept_id"))
    dst = nodes.select(F.col("concept_id").alias("target_concept_id"))
    return edges.join(src, "source_concept_id", "left_semi").join(
        dst, "target_concept_id", "left_semi")


def weak_prerequisite(concepts: DataFrame, edges: DataFrame, as_of: Column) -> DataFrame:
    """Per concept, the weakest of its weak prerequisites (then the lowest id)."""
    weak = scored(live(concepts), as_of).filter("is_weak").select(
        F.col("concept_id").alias("source_concept_id"), "score")
    incoming = edges.filter(F.col("relationship_type") == "prerequisite_of")
    return incoming.join(weak, "source_concept_id").groupBy(
        "user_id", F.col("target_concept_id").alias("concept_id")).agg(
        F.min_by("source_concept_id", F.struct("score", "source_concept_id"))
        .alias("prerequisite_id"))


def review_targets(concepts: DataFrame, edges: DataFrame, as_of: Column) -> DataFrame:
    """Weak concepts by how many others they hold up."""
    holds = edges.filter(F.col("relationship_type") == "prerequisite_of").groupBy(
        F.col("source_concept_id").alias("concept_id")).agg(
        F.count_distinct("target_concept_id").alias("unblocks"))
    weak = scored(live(concepts), as_of).filter("is_weak").join(holds, "concept_id").select(
        "user_id", "concept_id", "unblocks")
    # rank the few distinct counts of a reader, not the reader's concepts
    w = Window.partitionBy("user_id").orderBy(F.desc("unblocks"))
    places = weak.select("user_id", "unblocks").distinct().withColumn(
        "place", F.row_number().over(w))
    return weak.join(places, ["user_id", "unblocks"]).select(
        "user_id", "concept_id", "unblocks", "place")


def type_mix(edges: DataFrame) -> DataFrame:
    """Edges per reader and type with the type's share of that reader's graph."""
    w = Window.partitionBy("user_id")
    return edges.groupBy("user_id", "relationship_type").agg(F.count("*").alias("edges")).withColumn(
        "share", F.col("edges") / F.sum("edges").over(w))


def callback_pairs(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """Best (struggled, asked) pair per reader that spans two papers."""
    c = live(concepts)
    near = c.select(F.col("concept_id").alias("near"), "evidence_count",
                    F.col("source_paper_ids").alias("near_papers"))
    far = c.select(F.col("concept_id").alias("far"), F.col("source_paper_ids").alias("far_papers"))
    pairs = both_ways(edges).join(near, "near").join(far, "far").filter(
        (F.size("far_papers") > 0)
        & (F.size(F.array_except("near_papers", "far_papers")) > 0))
    order = [F.desc("evidence_count"), F.desc("confidence"), F.desc("near"), F.desc("far"),
             F.desc("relationship_type")]
    return newest(pairs, ["user_id"], order, 1)


def bridges(pairs: DataFrame, concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """For asked paper pairs: edges from second-paper-only material into the first paper."""
    c = live(concepts).select("concept_id", "source_paper_ids")
    src = c.select(F.col("concept_id").alias("source_concept_id"),
                   F.col("source_paper_ids").alias("src_papers"))
    dst = c.select(F.col("concept_id").alias("target_concept_id"),
                   F.explode(F.array_distinct("source_paper_ids")).alias("paper_a"))
    crossing = edges.join(src, "source_concept_id").join(dst, "target_concept_id").filter(
        ~F.array_contains("src_papers", F.col("paper_a")))
    return crossing.join(pairs, ["user_id", "paper_a"]).filter(
        F.array_contains("src_papers", F.col("paper_b"))).groupBy(
        "user_id", "paper_a", "paper_b").agg(
        F.count("*").alias("bridging_edges"),
        F.count_if(F.col("relationship_type") == "component_of").alias("component_edges"))


def shared_concepts(pairs: DataFrame, concepts: DataFrame) -> DataFrame:
    held = live(concepts).select(
        "user_id", "source_paper_ids", F.explode(F.array_distinct("source_paper_ids"))
        .alias("paper_a"))
    return held.join(pairs, ["user_id", "paper_a"]).filter(
        F.array_contains("source_paper_ids", F.col("paper_b"))).groupBy(
        "user_id", "paper_a", "paper_b").agg(F.count("*").alias("shared_concepts"))
