"""Shifted CholeskyQR whitening against numpy's eigendecomposition of the covariance."""

import numpy as np
import pandas as pd
import pytest

from quillmark.llm import whitening as W

KIND = "vec_id long, embedding array<double>, whitened string, note string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "old", f"n{i}") for i, v in enumerate(vectors)], KIND).repartition(3)


def brute(vectors, wanted=4):
    ok = [(i, v) for i, v in enumerate(vectors)
          if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    sizes = [len(v) for v in {tuple(np.floor(256 * np.array(v)).astype(int)) for _, v in ok} if len(v)]
    dims = min(set(sizes), key=lambda s: (-sizes.count(s), s))
    ok = [(i, v) for i, v in ok if len(v) == dims]
    x = np.array([np.floor(256 * np.array(v)) for _, v in ok]).astype(np.int64)
    u = np.unique(x, axis=0)
    n, total = len(u), [sum(map(int, c)) for c in u.T]
    mean = np.array(total) / n
    _, spread, axes = np.linalg.svd(u - mean, full_matrices=False)
    trace, values, axes = (spread**2).sum() / n, spread[:wanted] ** 2 / n, axes[:wanted].T
    off = [sum((n * int(a) - s) ** 2 for a, s in zip(row, total)) for row in x]
    return [i for i, _ in ok], off, n, values, (x - mean) @ axes, trace


def check(spark, vectors, rank=4, exact=1e-9):
    out = W.whiten(table(spark, vectors)).orderBy("vec_id", "component").toPandas()
    ids, off, n, values, scores, trace = brute(vectors)
    width = min(4, scores.shape[1])
    assert out.vec_id.tolist() == list(np.repeat(ids, width)) and set(out.n) == {n}
    assert out.component.tolist() == list(range(1, width + 1)) * len(ids)
    held = np.repeat([v if v < 1 << 63 else None for v in off], width)
    assert all(pd.isna(a) if b is None else a == b for a, b in zip(out.deviation.tolist(), held))
    got = out.whitened.to_numpy().reshape(-1, width)
    assert np.allclose(out.explained.to_numpy()[:rank], values[:rank] / trace, rtol=exact)
    for j in range(width):
        if j >= rank:
            assert (got[:, j] == 0).all() and out.explained[j] == 0
            continue
        want = scores[:, j] / np.sqrt(values[j])
        assert np.allclose(got[:, j], want * np.sign(want @ got[:, j]), atol=1e-6)
    assert out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9
    assert out.note.tolist() == [f"n{i}" for i in np.repeat(ids, width)]
    return out


def test_messy_rows(spark):
    chance = np.random.default_rng(1)
    vectors = [v.tolist() for v in chance.normal(size=(90, 7)) * np.arange(1, 8)]
    vectors[3:6] = [vectors[2]] * 3  # one vector in several rows counts once
    vectors += [None, [], [1.0, None] * 3 + [0.0], [float("nan")] * 7, [1.0] * 6 + [float("-inf")], [0.5, 0.25], [-0.0] * 7]
    check(spark, vectors)


@pytest.mark.parametrize("spread", [1e3, 1e7])
def test_far_from_round(spark, spread):
    """Condition numbers that would leave nothing of the small directions in a plain Cholesky factor."""
    chance = np.random.default_rng(2)
    base = chance.normal(size=(400, 5)) * np.array([spread, spread / 10, 30, 3, 1.0])
    turn, _ = np.linalg.qr(chance.normal(size=(5, 5)))
    check(spark, [v.tolist() for v in base @ turn + 1e4], exact=1e-7)


def test_fewer_directions_than_components(spark):
    chance = np.random.default_rng(3)
    flat = np.round(chance.normal(size=(60, 2)) * 100) @ np.array([[1, 2, 0, 1, 0], [0, 1, 3, -1, 0]])
    check(spark, [list(map(float, v)) for v in flat], rank=2)
    same = W.whiten(table(spark, [[1.0, 2.0]] * 4)).toPandas()
    assert len(same) == 8 and (same.whitened == 0).all() and (same.n == 1).all() and (same.identity_error == 0).all()


def test_long_sums_stay_exact(spark):
    big = 2.0**40
    vectors = [[big, 1.0], [-big, 2.0], [big / 2, 3.0]]
    out = W.whiten(table(spark, vectors)).orderBy("vec_id", "component").toPandas()
    assert out.deviation.isna().all()  # no long holds them
    x = np.array([[3_000_000, 1], [-3_000_000, 2], [7, 3]], object)
    total = list(x.sum(axis=0))
    want = [sum((3 * a - s) ** 2 for a, s in zip(row, total)) for row in x]
    assert W.deviations(x.astype(np.int64), 3, total, 3_000_000) == want
    assert W.deviations(x.astype(np.int64), 3, total, 1 << 61) == want


def test_no_usable_rows(spark):
    for vectors in ([], [None, [None], []]):
        out = W.whiten(table(spark, vectors))
        assert out.count() == 0 and out.columns == ["vec_id", "note", *W.RESULT]
