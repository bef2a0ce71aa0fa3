"""Section L queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import metrics as L
from quillmark.plans.common import r6
from quillmark.plans.registry import query
from quillmark.plans.views import ORACLE_VIEWS, add_stored

_SPANS = """SELECT event_id - event_id % 3 AS turn_id, CASE event_type WHEN 'error' THEN 'scope'
    WHEN 'view' THEN 'history' ELSE 'agent' END AS span, value AS ms, 1 AS calls FROM events"""
_TOTALS = """SELECT event_id - event_id % 3 AS turn_id, sum(CAST(floor(value) AS BIGINT)) + 5.5
  AS total_ms FROM events GROUP BY 1"""
_TOTALS = _TOTALS.replace("+ 5.5", "+ CAST(5.5 AS DOUBLE)")

def _spans(v):
    return v.sql(_SPANS)


@query("l1_span_breakdown", f"""
SELECT turn_id, span, round(ms, 6) AS ms, CAST(calls AS BIGINT) AS calls,
  round(CASE WHEN total_ms = 0 THEN 0 ELSE 100 * ms / total_ms END, 6) AS pct,
  round(total_ms - sum(ms) OVER (PARTITION BY turn_id), 6) AS unaccounted_ms
FROM (SELECT turn_id, span, sum(ms) AS ms, sum(calls) AS calls FROM ({_SPANS}) s GROUP BY 1, 2) p
JOIN ({_TOTALS}) t USING (turn_id)""")
def l1(v):
    """Unrounded here so both engines can be compared; the report shows one decimal."""
    out = L.span_breakdown(_spans(v), v.sql(_TOTALS), digits=None)
    return out.select("turn_id", "span", r6("ms"), "calls", r6("pct"), r6("unaccounted_ms"))


@query("l2_span_medians", f"""
SELECT span, round(median(ms), 6) AS median_ms, round(min(ms), 6) AS min_ms,
  round(max(ms), 6) AS max_ms, count(*) AS turns FROM ({_SPANS}) s GROUP BY span""")
def l2(v):
    return L.span_medians(_spans(v)).select(
        "span", r6("median_ms"), r6("min_ms"), r6("max_ms"), "turns")


@query("l2_latency_summary", """
SELECT round(median(latency_ms), 6) AS median_ms, min(latency_ms) AS min_ms,
  max(latency_ms) AS max_ms, count(latency_ms) AS turns FROM raw_turns""")
def l2s(v):
    return L.latency_summary(v.raw_turns).withColumn("median_ms", F.round("median_ms", 6))


@query("l2_latency_approximate")
def l2a(v):
    return L.approximate_latency(v.raw_turns)


@query("l3_tool_usage", """
SELECT tool, count(*) AS calls, count(DISTINCT turn_id) AS turns
FROM (SELECT turn_id, unnest(tools_called) AS tool FROM raw_turns) q GROUP BY tool""")
def l3(v):
    return L.tool_usage(v.raw_turns)


@query("l3_tool_calls_per_turn", """
SELECT turn_id, tool, count(*) AS calls
FROM (SELECT turn_id, unnest(tools_called) AS tool FROM raw_turns) q GROUP BY turn_id, tool""")
def l3t(v):
    return L.tool_calls_per_turn(v.raw_turns)


@query("l3_latency_by_tool_count", """
SELECT CAST(coalesce(len(tools_called), 0) AS INTEGER) AS tools, count(*) AS turns,
  round(avg(latency_ms), 6) AS avg_ms FROM raw_turns GROUP BY 1""")
def l3l(v):
    return L.latency_by_tool_count(v.raw_turns).withColumn("avg_ms", F.round("avg_ms", 6))


@query("l3_latency_tool_correlation", """
SELECT round(corr(CAST(coalesce(len(tools_called), 0) AS DOUBLE), CAST(latency_ms AS DOUBLE)), 6)
  AS corr FROM raw_turns""")
def l3c(v):
    return L.latency_tool_correlation(v.raw_turns).select(r6("corr"))


@query("l4_usage_cube", """
SELECT user_id, day, grounding_status, count(*) AS turns, CAST(sum(input_tokens) AS BIGINT)
    AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(latency_ms) AS BIGINT) AS latency_ms, count(error_code) AS errors,
  CAST(grouping_id(user_id, day, grounding_status) AS INTEGER) AS level
FROM (SELECT *, strftime(created_at, '%Y-%m-%d') AS day FROM raw_turns) q
GROUP BY CUBE (user_id, day, grounding_status)""")
def l4(v):
    return L.usage_cube(v.raw_turns)


@query("l5_daily_audience", """
SELECT strftime(observed_at, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS readers,
  count(DISTINCT concept_id) AS concepts FROM signals GROUP BY 1""")
def l5(v):
    return L.daily_audience(v.signals)


@query("l5_daily_audience_sketch")
def l5s(v):
    return L.daily_audience_sketch(v.signals)


add_stored("audience_sketches", lambda v: L.audience_sketches(v.signals))
add_stored("latency_sketches", lambda v: L.latency_sketches(v.raw_turns))
#: Spans of one to thirty days over the given month.
_SPANS_OF_DAYS = "(VALUES (1, 1), (3, 9), (8, 14), (15, 21), (1, 30), (29, 30)) s(low, high)"
ORACLE_VIEWS["day_spans"] = f"""
SELECT make_date(2024, 1, low) AS first_day, make_date(2024, 1, high) AS last_day FROM {_SPANS_OF_DAYS}"""


def _spans_of_days(v):
    return v.spark.sql(f"SELECT make_date(2024, 1, low) AS first_day, make_date(2024, 1, high) AS last_day FROM "
                       f"{_SPANS_OF_DAYS.replace('s(low', 'AS s(low')}")


@query("l5_audience_over_spans", """
SELECT strftime(first_day, '%Y-%m-%d') AS first_day, strftime(last_day, '%Y-%m-%d') AS last_day,
  count(DISTINCT user_id) AS readers, count(DISTINCT concept_id) AS concepts, true AS close
FROM day_spans JOIN signals ON observed_at::DATE BETWEEN first_day AND last_day GROUP BY 1, 2""")
def l5u(v):
    """Exact counts of each span, and whether the united daily sketches lie within three per cent of them."""
    spans = _spans_of_days(v)
    exact = L._days(spans).join(v.signals.withColumn("day", F.to_date("observed_at")), "day").groupBy(
        "first_day", "last_day").agg(F.count_distinct("user_id").alias("r"), F.count_distinct("concept_id").alias("c"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1 + 0.03 * F.col(b)
    return L.audience_over(v.audience_sketches, spans).join(exact, ["first_day", "last_day"]).select(
        F.date_format("first_day", "yyyy-MM-dd").alias("first_day"), F.date_format("last_day", "yyyy-MM-dd").alias("last_day"),
        F.col("r").alias("readers"), F.col("c").alias("concepts"),
        (near("readers", "r") & near("concepts", "c")).alias("close"))


@query("l2_latency_over_spans", """
SELECT strftime(first_day, '%Y-%m-%d') AS first_day, strftime(last_day, '%Y-%m-%d') AS last_day,
  count(latency_ms) AS turns, true AS close
FROM day_spans JOIN raw_turns ON created_at::DATE BETWEEN first_day AND last_day GROUP BY 1, 2""")
def l2u(v):
    """Turns of each span, and whether the merged daily sketches' median has a rank within three per cent of a half."""
    spans = _spans_of_days(v)
    found = L.latency_over(v.latency_sketches, spans)
    rows = L._days(spans).join(v.raw_turns.select(F.to_date("created_at").alias("day"), "latency_ms"), "day")
    at = rows.join(found, ["first_day", "last_day"]).groupBy("first_day", "last_day", "turns").agg(
        F.avg((F.col("latency_ms") <= F.col("quantile_ms")).cast("double")).alias("upto"),
        F.avg((F.col("latency_ms") < F.col("quantile_ms")).cast("double")).alias("below"))
    return at.select(
        F.date_format("first_day", "yyyy-MM-dd").alias("first_day"), F.date_format("last_day", "yyyy-MM-dd").alias("last_day"),
        "turns", ((F.col("upto") >= 0.47) & (F.col("below") <= 0.53)).alias("close"))
