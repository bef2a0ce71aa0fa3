"""Section M queries: streams over the given tables, run to their end."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from quillmark import vocab as V
from quillmark.plans.common import r6, us
from quillmark.plans.registry import query
from quillmark.plans.views import Views, words
from quillmark.streaming import jobs as S

_TURN = """SELECT event_id AS turn_id, user_id, {ts} AS created_at,
  CAST(floor(value * 10) AS INT) AS latency_ms,
  CASE event_type WHEN 'error' THEN 'no_evidence' WHEN 'view' THEN 'degraded' ELSE 'grounded' END
    AS grounding_status,
  event_id % 17 = 0 AND event_id % 10 < 8 AS fired FROM events"""
_TURN_SQL = _TURN.format(ts="ts")


def _live(v: Views, name: str, text: str):
    """A view over the events stream instead of the events table."""
    live = Views(v.spark, v.sf_dir)
    live._made["events"] = v.streamed("events")
    return live.sql(text) if text else getattr(live, name)


def _turn_stream(v):
    return _live(v, "", _TURN_SQL).withColumn("created_at", F.col("created_at").cast("timestamp"))


def _rocks(v):
    v.spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKS)


@query("m1_incremental_state", """
SELECT user_id, concept_id, round(total_weight, 6) AS total_weight, round(raw_score, 6) AS raw_score,
  evidence_count, epoch_us(last_reinforced_at) AS last_reinforced_at, effective_style FROM states""")
def m1(v):
    """Many small batches over the evidence log; must equal the batch job."""
    log = v.spark.readStream.schema(v.observations.schema).option("maxFilesPerTrigger", 2).parquet(
        v.path_of("observations"))
    out = S.drain_batches(log, "m1", S.state_partials(fan=3))
    return S.state_from_partials(S.current_partials(v.spark, out)).select(
        "user_id", "concept_id", r6("total_weight"), r6("raw_score"), "evidence_count",
        us("last_reinforced_at"), "effective_style")


def _passed(column: str, newest: str) -> str:
    """Rows that the last watermark of a run has passed: those of hours that closed an hour before the newest row."""
    return f"epoch_ms(time_bucket(INTERVAL 1 HOUR, {column})) + 3600000 <= epoch_ms(({newest})) - 3600000"


_NEWEST_STEP = f"SELECT max(observed_at) FROM signals WHERE signal_type IN ({words(V.STRUGGLES + V.RESOLVING)})"
_PAIRS = f"""SELECT p.observation_id, p.resolves_observation_id FROM paired p
JOIN signals c ON c.observation_id = p.observation_id
JOIN signals o ON o.observation_id = p.resolves_observation_id
WHERE {_passed('c.observed_at', _NEWEST_STEP)}"""


def _signal_stream(v):
    return _live(v, "signals", "").withColumn("observed_at", F.col("observed_at").cast("timestamp"))


@query("m2_stateful_pairing", _PAIRS)
def m2(v):
    _rocks(v)
    return S.drain(S.pair_stream(_signal_stream(v)), "m2")


@query("m2_expiring_pairing", _PAIRS + " AND c.observed_at - o.observed_at < INTERVAL 60 HOUR")
def m2x(v):
    """Struggles are forgotten after sixty hours of event time."""
    _rocks(v)
    return S.drain(S.pair_stream(_signal_stream(v), timedelta(hours=60)), "m2x")


@query("m3_rolling_intake", """
WITH acc AS (SELECT path, sha256(content) AS content_hash FROM files
  WHERE octet_length(content) BETWEEN 1 AND 31457280 AND left(hex(content), 10) = '255044462D'
    AND coalesce(page_count, 0) <= 200)
SELECT content_hash, count(*) AS uploads, count(*) FILTER (WHERE rn = 1 AND (paper_id IS NULL
    OR processing_status = 'failed')) AS ingested
FROM (SELECT a.*, k.paper_id, k.processing_status,
    row_number() OVER (PARTITION BY a.content_hash ORDER BY path) AS rn
  FROM acc a LEFT JOIN known_papers k USING (content_hash)) q GROUP BY content_hash""")
def m3(v):
    """Files arrive in four batches; every content is taken in once."""
    path, width = S.new_path(v.spark, "uploads"), -(-v.spark.sparkContext.defaultParallelism // 4)
    v.files.repartition(4 * width, "path").write.parquet(path)
    stream = v.spark.readStream.schema(v.files.schema).option("maxFilesPerTrigger", width).parquet(path)
    _rocks(v)
    return S.drain(S.intake_stream(stream, v.known_papers), "m3").groupBy("content_hash").agg(
        F.count("*").alias("uploads"), F.count_if(F.col("action") == "ingest").alias("ingested"))


def _windows(length: str, slide: str) -> str:
    return f"""
SELECT epoch_us(start) AS window_start, epoch_us(start + INTERVAL {length}) AS window_end,
  grounding_status, count(*) AS turns, CAST(sum(latency_ms) AS BIGINT) AS latency_ms,
  max(latency_ms) AS max_ms
FROM (SELECT *, unnest([time_bucket(INTERVAL {slide}, created_at) - INTERVAL {slide} * k
    FOR k IN range(CAST(epoch(INTERVAL {length}) / epoch(INTERVAL {slide}) AS BIGINT))]) AS start
  FROM ({_TURN_SQL}) t) w
WHERE start + INTERVAL {length} <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
GROUP BY start, grounding_status"""


@query("m4_tumbling_turns", _windows("1 HOUR", "1 HOUR"))
def m4(v):
    out = S.drain(S.turn_windows(_turn_stream(v)), "m4")
    return out.select(us("window_start"), us("window_end"), "grounding_status", "turns",
                      "latency_ms", "max_ms")


@query("m4_sliding_turns", _windows("6 HOUR", "2 HOUR"))
def m4s(v):
    out = S.drain(S.turn_windows(_turn_stream(v), "6 hours", "2 hours"), "m4s")
    return out.select(us("window_start"), us("window_end"), "grounding_status", "turns",
                      "latency_ms", "max_ms")


@query("m4_late_rows", """
WITH t AS (SELECT ts, event_id % 3 = 0 AS second FROM events),
mark AS (SELECT max(ts) - INTERVAL 1 HOUR AS closed_at FROM t WHERE NOT second)
SELECT second AS late_batch, count(*) AS rows, CAST(count(*) FILTER (WHERE second AND
  time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= closed_at) AS BIGINT) AS late
FROM t, mark GROUP BY second""")
def m4_late(v):
    """A third of the turns arrives after the others: what the watermark turns away, by batch."""
    path = S.new_path(v.spark, "turns")
    turns = v.sql(_TURN_SQL).withColumn("created_at", F.col("created_at").cast("timestamp"))
    for part in ("turn_id % 3 <> 0", "turn_id % 3 = 0"):
        turns.filter(part).repartition(4).write.mode("append").parquet(path)
    stream = v.spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 4).parquet(path)
    out = S.drain_batches(stream, "m4l", S.late_batches())
    return v.spark.read.parquet(out).select((F.col("batch_id") == 1).alias("late_batch"), "rows", "late")


@query("m5_reading_sessions", """
SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts) + INTERVAL 12 HOUR) AS session_end,
  count(*) AS turns
FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
    AS no FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
      < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events) a) b
GROUP BY user_id, no
HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def m5(v):
    out = S.drain(S.reading_sessions(_turn_stream(v)), "m5")
    return out.select("user_id", us("session_start"), us("session_end"), "turns")


@query("m6_rate_limiter", """
SELECT turn_id, coalesce(seen - 1 - last_value(CASE WHEN fired THEN seen END IGNORE NULLS) OVER
    (PARTITION BY user_id ORDER BY ts, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)
  AS turns_since
FROM (SELECT event_id AS turn_id, user_id, ts, event_id % 17 = 0 AND event_id % 10 < 8 AS fired,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seen FROM events) q
WHERE """ + _passed("ts", "SELECT max(ts) FROM events"))
def m6(v):
    _rocks(v)
    return S.drain(S.rate_limit_stream(_turn_stream(v)), "m6")


@query("m7_streaming_retention", """
SELECT message_id, session_id, ordinal FROM messages
WHERE created_at >= (SELECT max(created_at) FROM messages) - INTERVAL 30 DAY""")
def m7(v):
    path = S.new_path(v.spark, "chat")
    v.messages.repartition(3, "session_id").write.parquet(path)
    stream = v.spark.readStream.schema(v.messages.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = S.drain_batches(stream, "m7", S.retain_batches())
    stored = v.spark.read.parquet(out)
    dated = v.spark.sql("SELECT *, (SELECT max(created_at) FROM {m}) AS newest FROM {m}", m=stored)
    return S.kept_messages(dated, F.col("newest")).select("message_id", "session_id", "ordinal")
