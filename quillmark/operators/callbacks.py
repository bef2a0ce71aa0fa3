"""When to bring up an earlier paper, and why not (section H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark import vocab as V
from quillmark.functions import expr as X
from quillmark.functions.running import PART, by_range, carried, earlier, with_carry
from quillmark.functions.shared import materialise
from quillmark.operators import asof
from quillmark.operators.memory import both_ways, live

PREFERENCES = (
    "personalization_enabled BOOLEAN, proactivity STRING, quiz_appetite STRING, depth STRING, "
    "preferred_style STRING"
)


def preferences(users: DataFrame) -> DataFrame:
    """Typed preferences with their defaults and the waits they imply."""
    p = F.from_json("preferences", PREFERENCES)
    typed = users.select("user_id", p.alias("p"))
    proactivity = F.coalesce("p.proactivity", F.lit("normal"))
    appetite = F.coalesce("p.quiz_appetite", F.lit("normal"))
    return typed.select(
        "user_id",
        F.coalesce("p.personalization_enabled", F.lit(True)).alias("personalization_enabled"),
        proactivity.alias("proactivity"), appetite.alias("quiz_appetite"),
        F.coalesce("p.depth", F.lit("normal")).alias("depth"),
        F.col("p.preferred_style").alias("preferred_style"),
        X.gap_needed(V.CALLBACK_MIN_GAP, proactivity).alias("callback_gap"),
        X.gap_needed(V.CHECK_MIN_GAP, appetite).alias("check_gap"))


def turns_since(turns: DataFrame, marks: DataFrame) -> DataFrame:
    """Per turn: turns of the reader strictly after the last mark and before this turn.

    Null when there was no mark yet. Marks are (user_id, at). Turns and marks
    become one ordered stream; a running count and the count at the last mark
    give the difference in one scan, carried over ranges so a busy reader is spread out.
    """
    steps = turns.select("user_id", F.col("created_at").alias("moment"), F.lit(1).alias("kind"),
                         "turn_id")
    flags = marks.select("user_id", F.col("at").alias("moment"), F.lit(0).alias("kind"),
                         F.lit(None).cast(turns.schema["turn_id"].dataType).alias("turn_id"))
    # a mark at the instant of a turn sorts after it: that turn does not count
    both = steps.unionByName(flags).withColumn(
        "seq", F.when(F.col("kind") == 1, 0).otherwise(1))
    order = ["moment", "seq", "turn_id"]
    placed = by_range(both, ["user_id"], order)
    here = Window.partitionBy(PART, "user_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("upto", F.sum("kind").over(here)).withColumn("at_mark", F.when(F.col("kind") == 0, F.col("upto")))
    # counts only grow, so the largest count at a mark is the count at the last mark
    ends = local.groupBy(PART, "user_id").agg(F.sum("kind").alias("turns"), F.max("at_mark").alias("mark"))
    past = F.coalesce(F.sum("turns").over(earlier(["user_id"])), F.lit(0))
    carry = carried(ends.withColumn("mark", past + F.col("mark")), ["user_id"],
                    {"past": F.sum("turns"), "past_mark": F.max("mark")})
    marked = with_carry(local.withColumn("base", F.max("at_mark").over(here)), carry, ["user_id"])
    past = F.coalesce("past", F.lit(0))
    base = F.coalesce(past + F.col("base"), F.col("past_mark"))
    return marked.filter("kind = 1").select(
        "turn_id", "user_id", (past + F.col("upto") - 1 - base).alias("turns_since"))


def callback_marks(turns: DataFrame) -> DataFrame:
    return turns.filter(F.col("callback_concept_id").isNotNull()).select(
        "user_id", F.col("created_at").alias("at"))


def rank_candidates(hits: DataFrame, turns: DataFrame, edges: DataFrame, concepts: DataFrame,
                    history: DataFrame) -> DataFrame:
    """Neighbours of the concepts in play that were weak, surely so, when the turn came; best first.

    Hits: turn_id, user_id, concept_id, rank_no (1 is the primary). The best
    edge per neighbour is kept; ties go to the earliest hit, then the type.
    Edges to concepts that never were weak are left out before the fan-out.
    """
    primary = hits.filter(F.col("rank_no") == 1).select(
        "turn_id", F.col("concept_id").alias("primary_id"))
    able = live(concepts).select("concept_id", "source_paper_ids").join(
        asof.ever_weak(history, concepts), "concept_id", "left_semi")
    graph = both_ways(edges).join(able.select(F.col("concept_id").alias("far")), "far", "left_semi")
    seen = hits.select("turn_id", "user_id", F.col("concept_id").alias("near"), "rank_no")
    reach = seen.join(graph, ["user_id", "near"]).join(primary, "turn_id").filter(
        F.col("far") != F.col("primary_id"))
    best = reach.groupBy("turn_id", "user_id", F.col("far").alias("concept_id")).agg(
        F.max_by(F.struct("relationship_type", "confidence"),
                 F.struct("confidence", -F.col("rank_no"), "relationship_type")).alias("e"))
    timed = best.join(turns.select("turn_id", F.col("created_at").alias("at")), "turn_id")
    weak = asof.scored_at(timed, history, concepts).filter("is_weak").join(able, "concept_id")
    weight = F.round(F.col("e.confidence") * (1 - F.col("score")), 9)
    w = Window.partitionBy("turn_id").orderBy(F.desc("weight"), "concept_id")
    return weak.withColumn("weight", weight).withColumn(
        "place", F.row_number().over(w)).select(
        "turn_id", "user_id", "concept_id", F.col("e.relationship_type").alias("relationship_type"),
        "weight", "score", "effective_style", "source_paper_ids", "place")


def prior_papers(ranked: DataFrame, turns: DataFrame, scoped: DataFrame) -> DataFrame:
    """Per candidate the smallest other source paper the reader may still open."""
    active = turns.select("turn_id", F.col("paper_id").alias("active_id"))
    sources = ranked.select("turn_id", "user_id", "concept_id", F.explode(
        "source_paper_ids").alias("paper_id")).join(active, "turn_id").filter(
        ~F.col("paper_id").eqNullSafe(F.col("active_id")))
    return sources.join(scoped, ["user_id", "paper_id"], "left_semi").groupBy(
        "turn_id", "concept_id").agg(F.min("paper_id").alias("prior_paper_id"))


def decide(turns: DataFrame, users: DataFrame, hits: DataFrame, edges: DataFrame,
           concepts: DataFrame, scoped: DataFrame, history: DataFrame) -> DataFrame:
    """Exactly one of a callback or a reason, for every answered turn, by what was known before it.

    Turns that a preference silences are not looked into.
    """
    answered = turns.filter(F.col("agent_action").isin("answer", "callback"))
    open_to = preferences(users).filter(
        F.col("personalization_enabled") & F.col("callback_gap").isNotNull()).select("user_id")
    asked = answered.join(open_to, "user_id", "left_semi").select("turn_id")
    # read for the ranking, the reason and the choice: written once
    ranked = materialise(rank_candidates(
        hits.join(asked, "turn_id", "left_semi"), turns, edges, concepts, history), "ranked-callbacks")
    allowed = ranked.join(prior_papers(ranked, turns, scoped), ["turn_id", "concept_id"])
    chosen = allowed.groupBy("turn_id").agg(F.min_by(
        F.struct("concept_id", "relationship_type", "prior_paper_id", "effective_style", "score"),
        F.col("place")).alias("c"))
    prefs = preferences(users).select(
        "user_id", "personalization_enabled", "proactivity", "callback_gap")
    has_memory = hits.select("turn_id").distinct().withColumn("has_memory", F.lit(True))
    has_weak = ranked.select("turn_id").distinct().withColumn("has_weak", F.lit(True))
    gaps = turns_since(turns, callback_marks(turns)).select("turn_id", "turns_since")
    joined = (
        answered.select("turn_id", "user_id").join(prefs, "user_id")
        .join(has_memory, "turn_id", "left").join(has_weak, "turn_id", "left")
        .join(gaps, "turn_id", "left").join(chosen, "turn_id", "left"))
    reason = (
        F.when(~F.col("personalization_enabled"), "personalization_off")
        .when(F.col("callback_gap").isNull(), "proactivity_off")
        .when(F.col("has_memory").isNull(), "no_memory")
        .when(F.col("has_weak").isNull(), "no_weak_candidate")
        .when(F.col("turns_since") < F.col("callback_gap"), "rate_limited")
        .when(F.col("c").isNull(), "grant_revoked"))
    fired = reason.isNull()
    return joined.select(
        "turn_id", "user_id", reason.alias("suppressed_reason"),
        *[F.when(fired, F.col(f"c.{x}")).alias(x) for x in (
            "concept_id", "relationship_type", "prior_paper_id", "effective_style")])


def outcome_counts(decisions: DataFrame) -> DataFrame:
    """Fired and suppressed turns by reader and reason, with subtotals."""
    return decisions.withColumn("outcome", F.coalesce("suppressed_reason", F.lit("fired"))).rollup(
        "user_id", "outcome").agg(F.count("*").alias("turns"),
                                  F.grouping_id().cast("int").alias("level"))
