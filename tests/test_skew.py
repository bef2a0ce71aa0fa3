"""One reader, one conversation and one text hold a third of all rows."""

import check
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from suite_paths import SMALL

HOT = (
    "a3_dedup_routing", "a4_grant_upsert", "c4_filtered_top_k", "d5_verify_answers",
    "e5_struggle_pairing", "e6_learner_state", "e13_score_timeline", "f1_nearest_concepts",
    "f5_all_concepts", "f16_review_targets", "g3_nearest_existing", "h3_turn_gap",
    "h5_callback_decision", "i1_check_gate", "i5_attempt_numbers", "j1_append_exchange",
    "j2_context_window", "j6_session_listing", "j7_paper_listing", "k2_depth_fold",
    "k4_applied_to_turn", "l2_span_medians", "m2_stateful_pairing", "m5_reading_sessions",
    "m6_rate_limiter",
)


@pytest.fixture(scope="module")
def hot_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("hot")
    third = {
        "events": ("event_id", "user_id", F.lit(1).cast("bigint")),
        "documents": ("doc_id", "text", F.lit("One text.\nCopied very often, and again.")),
    }
    for name in check.Path(SMALL).glob("*.parquet"):
        table = name.stem
        df = spark.read.parquet(str(name))
        if table in third:
            ident, col, value = third[table]
            df = df.withColumn(col, F.when(F.col(ident) % 3 == 0, value).otherwise(F.col(col)))
        if table == "conversations":
            # one long conversation: fresh turn numbers, alternating speakers
            long = df.filter("conv_id % 3 = 0").selectExpr(
                "0L AS conv_id", "row_number() OVER (ORDER BY conv_id, turn) - 1 AS turn", "text")
            long = long.selectExpr("conv_id", "CAST(turn AS BIGINT) AS turn",
                                   "CASE turn % 2 WHEN 0 THEN 'user' ELSE 'assistant' END AS role",
                                   "text")
            df = long.unionByName(df.filter("conv_id % 3 <> 0"))
        df.toPandas().to_parquet(root / f"{table}.parquet", coerce_timestamps="us",
                                 allow_truncated_timestamps=True, index=False)
    return str(root)


@pytest.mark.parametrize("name", HOT)
def test_hot_key(spark, hot_dir, name):
    problem, _ = check.compare(spark, check.connect(hot_dir), entry.queries()[name],
                               entry.oracle_sql()[name], hot_dir)
    assert problem is None
