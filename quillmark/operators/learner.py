"""Learner state from the append-only evidence log (section E)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark import vocab as V
from quillmark.functions import expr as X
from quillmark.functions.running import PART, by_range, carried, earlier, running, with_carry
from quillmark.operators.canonical import new_id

PAIR = ["user_id", "concept_id"]
ORDER = ["observed_at", "observation_id"]


def clean_name(raw: Column) -> Column:
    calm = F.regexp_replace(F.coalesce(raw, F.lit("")), r"[\x00-\x1f\x7f]", " ")
    return F.substring(F.trim(F.regexp_replace(calm, r"\s+", " ")), 1, 200)


def validate(signals: DataFrame) -> DataFrame:
    """Clean each signal; malformed ones carry a ``reject_reason`` instead of failing."""
    name = clean_name(F.col("concept_name"))
    note = F.substring(F.trim(F.coalesce("note", F.lit(""))), 1, 500)
    return signals.withColumns({
        "concept_name": name,
        "style_in_play": F.when(F.col("style_in_play").isin(*V.EXPLANATION_STYLE),
                                F.col("style_in_play")),
        "note": F.when(note != "", note),
        "reject_reason": F.when(
            ~F.coalesce(F.col("signal_type").isin(*V.SIGNAL_TYPE), F.lit(False)),
            "unknown_signal_type")
        .when(name == "", "empty_name"),
    })


def source_of(signal_type: Column) -> Column:
    return X.lookup(signal_type, V.SOURCE_OF_SIGNAL, "implicit")


def weight_of(signal_type: Column, source: Column) -> Column:
    pair = F.lit(None).cast("double")
    for (kind, src), w in V.WEIGHT_OF_PAIR.items():
        pair = F.when((signal_type == kind) & (source == src), F.lit(w)).otherwise(pair)
    return F.coalesce(pair, X.lookup(source, V.WEIGHT_OF_SOURCE),
                      F.lit(V.WEIGHT_OF_SOURCE["implicit"]))


def target_of(signal_type: Column, resolves: Column) -> Column:
    assisted = resolves.isNotNull() & signal_type.isin(*V.ASSISTED_SIGNALS)
    return F.when(assisted, F.lit(V.ASSISTED_TARGET)).otherwise(
        X.lookup(signal_type, V.TARGET_OF_SIGNAL, V.UNKNOWN_TARGET))


def pair_struggles(signals: DataFrame) -> DataFrame:
    """Which open struggle each resolving signal closes: the latest one still open.

    Openers count +1, closers -1. Measured above the running floor, an opener
    sits at the level it creates and its closer at the level it leaves, so
    partners are neighbours within one level. Every step is a carried running
    aggregate, so one reader and concept with very many rows stays spread out.
    """
    sign = F.when(F.col("signal_type").isin(*V.STRUGGLES), 1).when(
        F.col("signal_type").isin(*V.RESOLVING), -1)
    steps = by_range(
        signals.select(*PAIR, *ORDER, sign.alias("step")).filter(F.col("step").isNotNull()), PAIR, ORDER)
    inside = Window.partitionBy(PART, *PAIR).orderBy(*ORDER)
    local = steps.withColumn("run", F.sum("step").over(inside)).withColumn(
        "run_low", F.min("run").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    # one row for each partition of a key carries the height and the lowest point reached before it
    net = local.groupBy(PART, *PAIR).agg(F.sum("step").alias("net"), F.min("run").alias("dip"))
    base = F.coalesce(F.sum("net").over(earlier(PAIR)), F.lit(0))
    carry = carried(net.withColumn("low", base + F.col("dip")), PAIR,
                    {"base": F.sum("net"), "past_low": F.min("low")})
    here = F.coalesce("base", F.lit(0))
    low = with_carry(local, carry, PAIR).select(
        *PAIR, *ORDER, "step", (here + F.col("run")).alias("total"),
        F.least("past_low", here + F.col("run_low")).alias("seen_low"))
    floor_before = F.least(F.lit(0), F.coalesce("seen_low", F.lit(0)))
    floor_now = F.least(floor_before, F.col("total"))
    opens = F.col("step") == 1
    level = low.filter(opens | (F.col("total") >= floor_before)).withColumn(
        "level", F.when(opens, F.col("total") - floor_now)
        .otherwise(F.col("total") - floor_now + 1))
    marked = level.select(*PAIR, "level", *ORDER, "step")
    # within a level openers and closers alternate: the partner is the last opener
    matched = running(
        marked, [*PAIR, "level"], ORDER,
        {"partner": ("last", F.when(opens, F.col("observation_id")))}, inclusive=False)
    return matched.filter((F.col("step") == -1) & F.col("partner").isNotNull()).select(
        "observation_id", F.col("partner").alias("resolves_observation_id"))


def evidence(signals: DataFrame) -> DataFrame:
    """Signals with source, weight, pairing and target."""
    source = source_of(F.col("signal_type"))
    paired = signals.join(pair_struggles(signals), "observation_id", "left")
    return paired.withColumn("signal_source", source).withColumns({
        "weight": weight_of(F.col("signal_type"), F.col("signal_source")),
        "target": target_of(F.col("signal_type"), F.col("resolves_observation_id")),
    })


def states(observations: DataFrame) -> DataFrame:
    """Score, confidence, count, style and clock per reader and concept.

    One pre-aggregated shuffle on (reader, concept, style); the second grouping
    refines the same keys over at most eight rows each.
    """
    style = F.when(F.col("resolves_observation_id").isNotNull(), F.col("style_in_play"))
    per_style = observations.groupBy(*PAIR, style.alias("style")).agg(
        F.sum("weight").alias("w"),
        F.sum(F.col("weight") * F.col("target")).alias("wt"),
        F.count("*").alias("n"),
        F.max("observed_at").alias("last"),
        F.min("observed_at").alias("first"),
    )
    rank = F.when(F.col("style").isNotNull(), F.struct("n", "last", "style"))
    folded = per_style.groupBy(*PAIR).agg(
        F.sum("w").alias("total_weight"),
        F.sum("wt").alias("weighted"),
        F.least(F.lit(V.SMALLINT_MAX), F.sum("n")).cast("int").alias("evidence_count"),
        F.max("last").alias("last_reinforced_at"),
        F.min("first").alias("first_seen_at"),
        F.max_by("style", rank).alias("effective_style"),
    )
    return folded.select(
        *PAIR, "total_weight",
        F.when(F.col("total_weight") > 0, F.col("weighted") / F.col("total_weight"))
        .alias("raw_score"),
        X.confidence(F.col("total_weight")).alias("score_confidence"),
        "evidence_count", "effective_style", "last_reinforced_at", "first_seen_at",
    )


def style_counts(observations: DataFrame) -> DataFrame:
    """Resolutions per style with their rank, for choosing another explanation."""
    counted = (
        observations.filter(F.col("resolves_observation_id").isNotNull()
                            & F.col("style_in_play").isNotNull())
        .groupBy(*PAIR, "style_in_play").agg(F.count("*").alias("resolutions"),
                                             F.max("observed_at").alias("last_at"))
    )
    w = Window.partitionBy(*PAIR).orderBy(F.desc("resolutions"))
    return counted.withColumn("place", F.dense_rank().over(w))


def score_at(states_df: DataFrame, as_of: Column, override: Column | None = None) -> DataFrame:
    override = F.lit(None).cast("double") if override is None else override
    score = X.effective_score(override, F.col("raw_score"), F.col("last_reinforced_at"), as_of)
    return states_df.withColumn("score", score).withColumn(
        "is_weak", X.is_weak(F.col("score"), F.col("score_confidence")))


def refresh(concepts: DataFrame, states_df: DataFrame) -> DataFrame:
    """Write derived state onto concepts; overrides stay, no evidence empties the cache."""
    cached = ["understanding_score", "score_confidence", "evidence_count", "effective_style",
              "last_reinforced_at"]
    fresh = states_df.select(
        *PAIR, F.col("raw_score").alias("understanding_score"), "score_confidence",
        "evidence_count", "effective_style", "last_reinforced_at")
    merged = concepts.drop(*cached).join(fresh, PAIR, "left")
    return merged.fillna({"score_confidence": 0.0, "evidence_count": 0})


def timeline(observations: DataFrame) -> DataFrame:
    """State after every observation: carried running sums, never one task per key."""
    w, t = F.col("weight"), F.col("weight") * F.col("target")
    out = running(observations, PAIR, ORDER, {
        "cum_weight": ("sum", w), "cum_target": ("sum", t), "cum_count": ("sum", F.lit(1))})
    return out.withColumns({
        "score_after": F.when(F.col("cum_weight") > 0, F.col("cum_target") / F.col("cum_weight")),
        "confidence_after": X.confidence(F.col("cum_weight")),
    })


def project(observations: DataFrame, pending: DataFrame) -> DataFrame:
    """State if the pending signals of each reader and concept had landed."""
    cols = [*PAIR, "observed_at", "style_in_play", "resolves_observation_id", "weight", "target"]
    touched = pending.select(*PAIR).distinct()
    base = observations.join(touched, PAIR, "left_semi").select(*cols)
    return states(base.unionByName(pending.select(*cols)))


def recall(signals: DataFrame, concepts: DataFrame) -> DataFrame:
    """Existing concept for each named signal, or null when one must be created.

    A name matches by its key or by a raw alias. Both sides become key rows so
    the match is an equality join; the lowest (kind, id) hit wins.
    """
    live = concepts.filter(F.col("merged_into_id").isNull())
    keys = live.select(
        "user_id", "concept_id", F.lit(0).alias("kind"), X.name_key(F.col("canonical_name"))
        .alias("key")
    ).unionByName(live.select(
        "user_id", "concept_id", F.lit(1).alias("kind"), F.explode("aliases").alias("key")))
    best = keys.groupBy("user_id", "kind", "key").agg(F.min("concept_id").alias("concept_id"))
    asked = signals.withColumn("probe", F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), X.name_key(F.col("concept_name")).alias("key")),
        F.struct(F.lit(1).alias("kind"), F.col("concept_name").alias("key")))))
    hits = asked.select("signal_id", "user_id", "probe.kind", "probe.key").join(
        best, ["user_id", "kind", "key"])
    chosen = hits.groupBy("signal_id").agg(
        F.min_by("concept_id", F.struct("kind", "concept_id")).alias("matched_concept_id"))
    return signals.join(chosen, "signal_id", "left")


def create_missing(recalled: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """One new concept for each name key that no signal of the reader could be matched to.

    The first signal gives the name and the first paper; ``vectors`` maps name keys to embeddings.
    """
    missing = recalled.filter(F.col("matched_concept_id").isNull()).withColumn(
        "normalized_name", F.substring(X.name_key(F.col("concept_name")), 1, 200))
    made = missing.groupBy("user_id", "normalized_name").agg(
        F.substring(F.min_by("concept_name", "signal_id"), 1, 200).alias("canonical_name"),
        F.min_by("paper_id", "signal_id").alias("first_paper_id"), F.count("*").alias("signals"))
    made = made.withColumn("concept_id", new_id(F.col("user_id"), F.col("normalized_name")))
    return made if vectors is None else made.join(vectors, "normalized_name", "left")


def placed_signals(recalled: DataFrame) -> DataFrame:
    """Every signal with the concept it counts for: the matched one, or the one made for its name."""
    key = F.substring(X.name_key(F.col("concept_name")), 1, 200)
    return recalled.withColumn(
        "concept_id", F.coalesce("matched_concept_id", new_id(F.col("user_id"), key)))


def add_sources(concepts: DataFrame, matched: DataFrame) -> DataFrame:
    """Append the papers signals came from to the provenance of their concepts."""
    new = matched.filter(F.col("paper_id").isNotNull()).groupBy(
        F.col("matched_concept_id").alias("concept_id")
    ).agg(F.array_sort(F.collect_set("paper_id")).alias("_new"))
    both = concepts.join(new, "concept_id", "left")
    return both.withColumn(
        "source_paper_ids",
        F.when(F.col("_new").isNull(), F.col("source_paper_ids"))
        .otherwise(F.array_union("source_paper_ids", "_new"))).drop("_new")


def backstop(turns: DataFrame, signals: DataFrame, memory_hits: DataFrame) -> DataFrame:
    """A weightless reminder for answered turns that read memory and recorded nothing."""
    answered = turns.filter(F.col("agent_action").isin("answer", "callback")
                            & F.col("memory_read") & F.col("error_code").isNull())
    silent = answered.join(signals.select("turn_id").distinct(), "turn_id", "left_anti")
    first = memory_hits.groupBy("turn_id").agg(
        F.min_by("concept_id", F.struct("rank_no", "concept_id")).alias("concept_id"))
    return silent.join(first, "turn_id").select(
        "turn_id", "user_id", "concept_id", F.lit("reinforcement").alias("signal_type"),
        F.lit("system").alias("signal_source"), F.lit(0.0).alias("weight"),
        F.lit("Revisited without an explicit signal.").alias("note"),
        F.col("created_at").alias("observed_at"))


def persisted(signals: DataFrame, turns: DataFrame) -> DataFrame:
    """Buffered signals land only with a turn that was stored."""
    return signals.join(turns.select("turn_id").distinct(), "turn_id", "left_semi")


def corrections(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reader corrections: the override that stands, and one signal per correction."""
    standing = requests.groupBy(*PAIR).agg(
        F.max_by("score", F.struct("created_at", "request_id")).alias("user_override_score"))
    kind = F.when(F.col("score") >= V.WEAK_BELOW, "user_stated_known").otherwise(
        "user_stated_unknown")
    note = F.trim(F.coalesce("note", F.lit("")))
    signals = requests.select(
        F.col("request_id").alias("signal_id"), *PAIR, kind.alias("signal_type"),
        F.when(note != "", note).otherwise("Corrected by the reader.").alias("note"))
    return standing, signals
