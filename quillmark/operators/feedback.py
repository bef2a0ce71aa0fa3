"""Reader feedback and the standing preferences it moves (section K)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark import vocab as V
from quillmark.functions.running import PART, by_range, newest, running, scan

TOP = len(V.DEPTH_LEVELS) - 1


def validate(rows: DataFrame) -> DataFrame:
    one = F.col("target_turn_id").isNull() != F.col("target_concept_id").isNull()
    comment = F.substring(F.trim(F.coalesce("comment", F.lit(""))), 1, 2000)
    styled = F.coalesce(F.col("preferred_style").isin(*V.EXPLANATION_STYLE), F.lit(False))
    return rows.withColumns({
        "comment": F.when(comment != "", comment),
        "reject_reason": F.when(~F.col("feedback_type").isin(*V.FEEDBACK_TYPE), "unknown_type")
        .when(~one, "exactly_one_target")
        .when((F.col("feedback_type") == "style_preference") & ~styled, "unknown_style")})


def depth_steps(rows: DataFrame) -> DataFrame:
    move = F.when(F.col("feedback_type") == "too_basic", 1).when(
        F.col("feedback_type") == "too_advanced", -1)
    return rows.withColumn("move", move).filter(F.col("move").isNotNull())


def fold_depth(rows: DataFrame, start: DataFrame) -> DataFrame:
    """Depth after all nudges, each stopping at the ends.

    The nudges of a reader are one map from start to end level: shift by their sum, held between a low and a high.
    With ``after``, the sum of the nudges behind a point, that map follows from the extremes of ``after``: as long
    as they lie less than ``TOP`` apart only one end can be touched, and how far the start may come is the lowest and
    highest ``after``. Where they first lie ``TOP`` apart, seen from the end, every start has met that end, so low
    and high are one level. Sums and extremes are carried scans, so no list is gathered and a busy reader is spread.
    """
    key, order = ["user_id"], ["created_at", "feedback_id"]
    nudges = by_range(depth_steps(rows).select(*key, *order, "move"), key, order)
    behind = scan(nudges, key, order, {"after": ("sum", F.col("move"))}, inclusive=False, backward=True)
    # the point before the first nudge counts as well: its value is the sum with the nudge itself
    points = behind.withColumns({
        "lower": F.least("after", F.col("after") + F.col("move")),
        "upper": F.greatest("after", F.col("after") + F.col("move"))})
    seen = scan(points, key, order, {"least": ("min", F.col("lower")), "most": ("max", F.col("upper"))}, backward=True)
    wide = F.col("most") - F.col("least") >= TOP
    # the newest nudge with which the extremes lie TOP apart: it reached the later of the two ends
    turned = F.max_by(
        F.when(F.col("after") + F.col("move") == F.col("most"), F.lit(TOP) + F.col("least")).otherwise(F.col("most")),
        F.when(wide, F.struct(*order)))
    limits = seen.groupBy(*key).agg(
        F.min_by(F.col("after") + F.col("move"), F.struct(*order)).alias("shift"),
        F.min("least").alias("least"), F.max("most").alias("most"), turned.alias("turned"))
    maps = limits.select(
        *key, "shift", F.coalesce("turned", F.col("most")).alias("low"),
        F.coalesce("turned", F.lit(TOP) + F.col("least")).alias("high"))
    names = F.array(*[F.lit(x) for x in V.DEPTH_LEVELS])
    # a level outside the list starts again from normal, but only once it is moved
    at = F.array_position(names, F.col("depth")).cast("int") - 1
    begin = F.when(at >= 0, at).otherwise(V.DEPTH_LEVELS.index("normal"))
    end = F.least(F.greatest(begin + F.col("shift"), F.col("low")), F.col("high")).cast("int")
    joined = start.select("user_id", "depth").join(maps, "user_id", "left")
    return joined.select("user_id", F.when(F.col("shift").isNull(), F.col("depth")).otherwise(
        F.element_at(names, end + 1)).alias("depth"))


def preferred_style(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("feedback_type") == "style_preference").groupBy("user_id").agg(
        F.max_by("preferred_style", F.struct("created_at", "feedback_id")).alias("preferred_style"))


def stamp(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """Preference feedback with the reader's next answered turn, if there is one.

    A backward carried scan over one ordered stream of feedback and answered
    turns: each feedback takes the nearest turn after it.
    """
    kind = turns.schema["turn_id"].dataType
    key = rows.schema["feedback_id"].dataType
    asked = rows.filter(F.col("feedback_type").isin(*V.PREFERENCE_FEEDBACK)).select(
        "user_id", "created_at", "feedback_id", F.lit(None).cast(kind).alias("turn_id"))
    answered = turns.filter(F.col("agent_action").isin("answer", "callback")).select(
        "user_id", "created_at", F.lit(None).cast(key).alias("feedback_id"), "turn_id")
    # a turn at the very instant of the feedback counts as before it
    both = asked.unionByName(answered).withColumn(
        "seq", F.when(F.col("turn_id").isNotNull(), 0).otherwise(1))
    out = running(both, ["user_id"], ["created_at", "seq", "turn_id", "feedback_id"],
                  {"applied_to_turn_id": ("last", F.col("turn_id"))}, inclusive=False,
                  backward=True)
    return out.filter(F.col("feedback_id").isNotNull()).select("feedback_id", "applied_to_turn_id")


def recent(rows: DataFrame, n: int = 50) -> DataFrame:
    return newest(rows, ["user_id"], [F.desc("created_at"), F.desc("feedback_id")], n)


def not_owned(rows: DataFrame, turns: DataFrame, concepts: DataFrame) -> DataFrame:
    """Feedback whose target is missing or belongs to someone else."""
    by_turn = rows.filter(F.col("target_turn_id").isNotNull()).join(
        turns.select("user_id", F.col("turn_id").alias("target_turn_id")),
        ["user_id", "target_turn_id"], "left_anti").select("feedback_id")
    by_concept = rows.filter(F.col("target_concept_id").isNotNull()).join(
        concepts.select("user_id", F.col("concept_id").alias("target_concept_id")),
        ["user_id", "target_concept_id"], "left_anti").select("feedback_id")
    return by_turn.unionByName(by_concept).distinct()
