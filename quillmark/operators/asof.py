"""What was known of a concept at a moment: intervals of state, and requests joined to them.

Every observation opens an interval of its reader's concept that the next one closes. A request at a moment takes the
interval it falls into; evidence of that very instant comes after it. Requests and intervals become one ordered
stream and the latest state is carried along it, so there is no range join, and a reader and concept with very many
rows is spread over partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark import vocab as V
from quillmark.functions import expr as X
from quillmark.functions.running import by_range, running, scan
from quillmark.operators.learner import ORDER, PAIR

STATE = ("raw_score", "score_confidence", "effective_style", "last_reinforced_at")
DIGITS = 9


def intervals(observations: DataFrame) -> DataFrame:
    """One row per observation: state from then (``valid_from``) until the next one (``valid_to``, open if null)."""
    style = F.when(F.col("resolves_observation_id").isNotNull(), F.col("style_in_play"))
    rows = observations.select(*PAIR, *ORDER, "weight", (F.col("weight") * F.col("target")).alias("aimed"),
                               style.alias("style"))
    counted = running(rows, [*PAIR, "style"], ORDER, {"times": ("sum", F.lit(1))})
    # a style's count only grows, so the largest (count, time, style) so far is that of the leading style now
    lead = F.when(F.col("style").isNotNull(), F.struct("times", "observed_at", "style"))
    placed = by_range(counted, PAIR, ORDER)
    known = scan(placed, PAIR, ORDER, {
        "w": ("sum", F.col("weight")), "wt": ("sum", F.col("aimed")), "lead": ("max", lead)})
    closed = scan(known, PAIR, ORDER, {"valid_to": ("last", F.col("observed_at"))}, inclusive=False, backward=True)
    raw = F.when(F.col("w") > 0, F.round(F.col("wt") / F.col("w"), DIGITS))
    return closed.select(
        *PAIR, "observation_id", F.col("observed_at").alias("valid_from"), "valid_to", raw.alias("raw_score"),
        F.round(X.confidence(F.col("w")), DIGITS).alias("score_confidence"),
        F.col("lead.style").alias("effective_style"), F.col("observed_at").alias("last_reinforced_at"))


def state_at(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Requests (with user_id, concept_id and ``at``) and the state of the concept before that moment, if it had any."""
    kind = history.select(F.struct(*STATE).alias("state")).schema["state"].dataType
    asked = requests.select(
        *PAIR, F.col("at").alias("moment"), F.lit(0).alias("seq"), F.monotonically_increasing_id().alias("tie"),
        F.struct(*requests.columns).alias("request"), F.lit(None).cast(kind).alias("state"))
    known = history.select(
        *PAIR, F.col("valid_from").alias("moment"), F.lit(1).alias("seq"), F.col("observation_id").alias("tie"),
        F.lit(None).cast(asked.schema["request"].dataType).alias("request"), F.struct(*STATE).alias("state"))
    out = running(asked.unionByName(known), PAIR, ["moment", "seq", "tie"], {"now": ("last", F.col("state"))})
    return out.filter(F.col("request").isNotNull()).select("request.*", *[F.col(f"now.{c}").alias(c) for c in STATE])


def scored_at(requests: DataFrame, history: DataFrame, concepts: DataFrame) -> DataFrame:
    """``state_at`` with ``score`` and ``is_weak`` at the moment. A reader's own correction stands at all times."""
    override = concepts.select("concept_id", "user_override_score")
    found = state_at(requests, history).join(override, "concept_id", "left")
    score = X.effective_score(F.col("user_override_score"), F.col("raw_score"), F.col("last_reinforced_at"), F.col("at"))
    return found.withColumn("score", F.round(score, DIGITS)).withColumn(
        "is_weak", X.is_weak(F.col("score"), F.col("score_confidence"))).drop("user_override_score")


def ever_weak(history: DataFrame, concepts: DataFrame) -> DataFrame:
    """Concepts that can have been weak at some moment: scores only fall within an interval, so its end decides."""
    override = concepts.select("concept_id", "user_override_score")
    lowest = F.when(F.col("valid_to").isNull(), F.col("raw_score") * V.DECAY_FLOOR).otherwise(
        F.col("raw_score") * X.decay(F.col("last_reinforced_at"), F.col("valid_to")))
    bottom: Column = F.round(F.coalesce("user_override_score", lowest), DIGITS)
    return history.join(override, "concept_id").filter(X.is_weak(bottom, F.col("score_confidence"))).select(
        "concept_id").distinct()
