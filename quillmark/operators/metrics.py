"""Turn metrics: where time goes, tools, tokens, audiences (section L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def span_breakdown(spans: DataFrame, totals: DataFrame, digits: int | None = 1) -> DataFrame:
    """Milliseconds, calls and share per span of a turn, and the turn's unmeasured rest."""
    per = spans.groupBy("turn_id", "span").agg(
        F.sum("ms").alias("ms"), F.sum("calls").alias("calls"))
    joined = per.join(totals.select("turn_id", "total_ms"), "turn_id")

    def shown(c):
        return c if digits is None else F.bround(c, digits)

    w = Window.partitionBy("turn_id")
    pct = F.when(F.col("total_ms") == 0, 0.0).otherwise(100 * F.col("ms") / F.col("total_ms"))
    return joined.select(
        "turn_id", "span", shown(F.col("ms")).alias("ms"), "calls", shown(pct).alias("pct"),
        (shown(F.col("total_ms")) - F.sum(shown(F.col("ms"))).over(w)).alias("unaccounted_ms"))


def exact_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median, least, most and count per key without sorting a key in one task.

    Equal values are counted first. Whole-number bins say which one or two bins
    hold the middle; only the values of those bins are then put in order.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count("*").alias("n")).withColumn("bin", F.floor(value))
    bins = counted.groupBy(*keys, "bin").agg(
        F.sum("n").alias("in_bin"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = bins.withColumns({
        "before": F.coalesce(F.sum("in_bin").over(upto), F.lit(0)),
        "total": F.sum("in_bin").over(whole), "least": F.min("lo").over(whole),
        "most": F.max("hi").over(whole)})
    left, right = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)

    def covers(rank, before, n):
        return (rank > before) & (rank <= before + n)

    middle = placed.filter(
        covers(left, F.col("before"), F.col("in_bin"))
        | covers(right, F.col("before"), F.col("in_bin"))
    ).select(*keys, "bin", "before", "total", "least", "most")
    inside = Window.partitionBy(*keys, "bin").orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1)
    ranked = counted.join(middle, [*keys, "bin"]).withColumn(
        "below", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))

    def at(rank):
        return F.max(F.when(covers(rank, F.col("below"), F.col("n")), F.col(value)))

    return ranked.groupBy(*keys).agg(
        ((at(left) + at(right)) / 2).alias("median"), F.max("least").alias("least"),
        F.max("most").alias("most"), F.max("total").alias("rows"))


def span_medians(spans: DataFrame) -> DataFrame:
    return exact_median(spans, ["span"], "ms").select(
        "span", F.col("median").alias("median_ms"), F.col("least").alias("min_ms"),
        F.col("most").alias("max_ms"), F.col("rows").alias("turns"))


def latency_summary(turns: DataFrame) -> DataFrame:
    one = turns.withColumn("_all", F.lit(0))
    return exact_median(one, ["_all"], "latency_ms").select(
        F.col("median").alias("median_ms"), F.col("least").alias("min_ms"),
        F.col("most").alias("max_ms"), F.col("rows").alias("turns"))


def approximate_latency(turns: DataFrame) -> DataFrame:
    return turns.groupBy("grounding_status").agg(
        F.percentile_approx("latency_ms", 0.5, 10000).alias("median_ms"))


def tool_usage(turns: DataFrame) -> DataFrame:
    calls = turns.select("turn_id", F.explode("tools_called").alias("tool"))
    return calls.groupBy("tool").agg(
        F.count("*").alias("calls"), F.count_distinct("turn_id").alias("turns"))


def tool_calls_per_turn(turns: DataFrame) -> DataFrame:
    calls = turns.select("turn_id", F.explode("tools_called").alias("tool"))
    return calls.groupBy("turn_id", "tool").agg(F.count("*").alias("calls"))


def latency_by_tool_count(turns: DataFrame) -> DataFrame:
    n = F.coalesce(F.size("tools_called"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    return turns.withColumn("tools", n.cast("int")).groupBy("tools").agg(
        F.count("*").alias("turns"), F.avg("latency_ms").alias("avg_ms"))


def latency_tool_correlation(turns: DataFrame) -> DataFrame:
    n = F.greatest(F.coalesce(F.size("tools_called"), F.lit(0)), F.lit(0))
    return turns.agg(F.corr(n.cast("double"), F.col("latency_ms").cast("double")).alias("corr"))


def usage_cube(turns: DataFrame) -> DataFrame:
    """Tokens, latency and errors by reader, day and grounding, with every subtotal."""
    day = F.date_format("created_at", "yyyy-MM-dd")
    return turns.withColumn("day", day).cube("user_id", "day", "grounding_status").agg(
        F.count("*").alias("turns"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("latency_ms").alias("latency_ms"),
        F.count("error_code").alias("errors"), F.grouping_id().cast("int").alias("level"))


def daily_audience(observations: DataFrame) -> DataFrame:
    """Exact distinct readers and concepts per day.

    Two-step: distinct pairs first (map-side combined), then counts, so one day
    with a third of all rows costs its distinct values only.
    """
    day = F.date_format("observed_at", "yyyy-MM-dd").alias("day")
    readers = observations.select(day, "user_id").distinct().groupBy("day").agg(
        F.count("*").alias("readers"))
    concepts = observations.select(day, "concept_id").distinct().groupBy("day").agg(
        F.count("*").alias("concepts"))
    return readers.join(concepts, "day")


def daily_audience_sketch(observations: DataFrame) -> DataFrame:
    day = F.date_format("observed_at", "yyyy-MM-dd").alias("day")
    return observations.groupBy(day).agg(
        F.approx_count_distinct("user_id").alias("readers"),
        F.hll_sketch_estimate(F.hll_sketch_agg("concept_id")).alias("concepts"))


def audience_sketches(observations: DataFrame) -> DataFrame:
    """One small row a day that any span of days can be put together from: who read, and what was touched."""
    day = F.to_date("observed_at").alias("day")
    return observations.groupBy(day).agg(
        F.hll_sketch_agg("user_id", 14).alias("readers"), F.hll_sketch_agg("concept_id", 14).alias("concepts"))


def audience_over(sketches: DataFrame, spans: DataFrame) -> DataFrame:
    """Distinct readers and concepts of each span (first_day, last_day), from the stored days alone."""
    return _days(spans).join(sketches, "day").groupBy("first_day", "last_day").agg(
        F.hll_sketch_estimate(F.hll_union_agg("readers")).alias("readers"),
        F.hll_sketch_estimate(F.hll_union_agg("concepts")).alias("concepts"))


def latency_sketches(turns: DataFrame) -> DataFrame:
    """One quantile sketch of the latencies of each day."""
    return turns.filter(F.col("latency_ms").isNotNull()).groupBy(F.to_date("created_at").alias("day")).agg(
        F.kll_sketch_agg_bigint(F.col("latency_ms").cast("long")).alias("latency"))


def latency_over(sketches: DataFrame, spans: DataFrame, share: float = 0.5) -> DataFrame:
    """A quantile of the latencies of each span, and their number, from the stored days alone."""
    merged = F.kll_merge_agg_bigint("latency")
    return _days(spans).join(sketches, "day").groupBy("first_day", "last_day").agg(merged.alias("latency")).select(
        "first_day", "last_day", F.kll_sketch_get_n_bigint("latency").alias("turns"),
        F.kll_sketch_get_quantile_bigint("latency", F.lit(share)).alias("quantile_ms"))


def _days(spans: DataFrame) -> DataFrame:
    return spans.withColumn("day", F.explode(F.sequence("first_day", "last_day")))
