import random
from collections import Counter

import numpy as np

from quillmark.llm import near_copies


def spread(count, length, changes):
    """Near copies of one text whose similarities lie closely around 0.8, so that links are few and borderline."""
    chance = random.Random(9)
    base = [f"w{i}" for i in range(length)]
    rows = []
    for doc_id in range(count):
        changed = list(base)
        for at in chance.sample(range(length), changes):
            changed[at] = f"x{doc_id}x{at}"
        rows.append((doc_id, " ".join(changed)))
    return rows


def exact(rows, size, percent):
    sets = [{tuple(w[j : j + size]) for j in range(len(w) - size + 1)} for w in (t.split() for _, t in rows)]
    shared = {s: k for k, s in enumerate(s for s, n in Counter(x for s in sets for x in s).items() if n > 1)}
    held = np.zeros((len(sets), len(shared)), np.float32)
    for i, s in enumerate(sets):
        held[i, [shared[x] for x in s if x in shared]] = 1
    both, n = held @ held.T, np.array([len(s) for s in sets])
    linked = 100 * both >= percent * (n[:, None] + n - both)
    group = np.arange(len(sets))
    while True:  # the smallest id within reach
        low = np.where(linked, group, len(sets)).min(1)
        if (low == group).all():
            return {doc_id: int(g) for (doc_id, _), g in zip(rows, group)}
        group = low


def test_a_dense_group_around_the_threshold_is_whole(spark):
    rows = spread(2000, 400, 8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.groups(df, 4, 80).collect()}
    want = exact(rows, 4, 80)
    assert 20 < len(set(want.values())) < len(rows) - 20
    assert got == want


def test_the_last_pass_cuts_regions_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 40)
    rows = spread(500, 400, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.groups(df, 4, 80).collect()}
    assert got == exact(rows, 4, 80)
