"""Column expressions used by more than one job, and their SQL twins.

All of these are plain Catalyst expressions, so they stay inside whole-stage
code generation wherever they are used.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quillmark import vocab as V


def lookup(col: Column, mapping: dict, default=None) -> Column:
    """A small closed mapping as one literal map; missing keys give ``default``."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), col)
    return found if default is None else F.coalesce(found, F.lit(default))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def days_between(earlier: Column, later: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(86_400_000_000.0)


def confidence(weight: Column) -> Column:
    return F.when(weight > 0, weight / (weight + V.CONFIDENCE_HALF_WEIGHT)).otherwise(0.0)


def decay(last_seen: Column, as_of: Column) -> Column:
    d = days_between(last_seen, as_of)
    return F.when(last_seen.isNull() | (d <= 0), F.lit(1.0)).otherwise(
        F.greatest(F.lit(V.DECAY_FLOOR), F.pow(F.lit(0.5), d / V.HALF_LIFE_DAYS))
    )


def effective_score(override: Column, raw: Column, last_seen: Column, as_of: Column) -> Column:
    """The reader's own correction first, undecayed; then the decayed inference."""
    return F.coalesce(override, raw * decay(last_seen, as_of))


def is_weak(score: Column, conf: Column) -> Column:
    return F.coalesce((score < V.WEAK_BELOW) & (conf >= V.CONFIDENCE_FLOOR), F.lit(False))


def name_key(name: Column) -> Column:
    kept = F.regexp_replace(F.lower(name), "[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(kept, " +", " "))


def token_estimate(text: Column) -> Column:
    """About four characters per token, half-to-even, at least one, small-int clamp."""
    est = F.greatest(F.lit(1), F.bround(F.length(text) / 4.0).cast("int"))
    return F.least(est, F.lit(V.SMALLINT_MAX))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def locator(path: Column, first: Column, last: Column) -> Column:
    pages = F.when(
        first == last, F.concat(F.lit("p."), first.cast("string"))
    ).otherwise(F.concat(F.lit("pp."), first.cast("string"), F.lit("-"), last.cast("string")))
    return F.concat(path, F.lit(", "), pages)


def gap_needed(base: int, level: Column) -> Column:
    """Turns to wait for a preference level; null when the level is ``off``."""
    scaled = F.bround(F.lit(float(base)) * lookup(level, V.GAP_MULTIPLIER, 1.0)).cast("int")
    return F.when(level != "off", F.greatest(F.lit(1), scaled))


SQL_FUNCTIONS = {
    "cosine_sim": (
        "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN "
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / "
        "(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)))"
    ),
    "evidence_confidence": (
        "(w DOUBLE) RETURNS DOUBLE RETURN "
        f"CASE WHEN w > 0 THEN w / (w + {V.CONFIDENCE_HALF_WEIGHT}D) ELSE 0D END"
    ),
    "score_decay": (
        "(last_seen TIMESTAMP, as_of TIMESTAMP) RETURNS DOUBLE RETURN "
        "CASE WHEN last_seen IS NULL OR as_of <= last_seen THEN 1D ELSE "
        f"greatest({V.DECAY_FLOOR}D, pow(0.5D, (unix_micros(as_of) - unix_micros(last_seen)) "
        f"/ 86400000000D / {V.HALF_LIFE_DAYS}D)) END"
    ),
    "concept_key": (
        "(name STRING) RETURNS STRING RETURN trim(regexp_replace("
        "regexp_replace(lower(name), '[^a-z0-9 ]+', ' '), ' +', ' '))"
    ),
    "token_estimate": (
        "(t STRING) RETURNS INT RETURN "
        f"least({V.SMALLINT_MAX}, greatest(1, CAST(bround(length(t) / 4D) AS INT)))"
    ),
}


def register(spark: SparkSession) -> None:
    """Expose the shared expressions to SQL users; the optimiser inlines them."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
