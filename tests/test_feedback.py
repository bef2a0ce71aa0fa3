"""The depth fold against a plain loop."""

import random

from quillmark import vocab as V
from quillmark.operators import feedback as K


def test_depth_fold_matches_a_loop(spark):
    rng = random.Random(5)
    rows, starts = [], []
    for user in range(120):
        starts.append((user, rng.choice([*V.DEPTH_LEVELS, "strange", None])))
        for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 40])):
            rows.append((user, rng.randrange(6), len(rows), rng.choice(["too_basic", "too_advanced", "too_basic", "helpful"])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "user_id INT, s INT, feedback_id INT, feedback_type STRING").selectExpr(
        "user_id", "timestamp_seconds(s) AS created_at", "feedback_id", "feedback_type")
    got = dict(map(tuple, K.fold_depth(df, spark.createDataFrame(starts, "user_id INT, depth STRING")).collect()))
    for user, depth in starts:
        for _, _, _, kind in sorted((r for r in rows if r[0] == user), key=lambda r: r[1:3]):
            step = {"too_basic": 1, "too_advanced": -1}.get(kind)
            if step:
                at = V.DEPTH_LEVELS.index(depth) if depth in V.DEPTH_LEVELS else V.DEPTH_LEVELS.index("normal")
                depth = V.DEPTH_LEVELS[max(0, min(K.TOP, at + step))]
        assert got[user] == depth, user
