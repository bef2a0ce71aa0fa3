"""Whitening of embeddings by shifted CholeskyQR.

Entries become whole numbers (floor of 256 times the entry). The distinct vectors are the rows of a matrix that is
centred, never gathered, and orthogonalised in place: each pass sums the d x d Gram matrix of the rows solved through
all triangular factors so far, and its Cholesky factor is the next one. The first pass adds a shift, so that the
factor exists at any condition number; later ones do so only where the Gram matrix is singular. Passes end when the
rows are orthonormal to within the square root of a rounding, which the last factor takes away (three, as a rule). The product R of the factors has the singular values and right vectors of
the centred matrix, so a singular value decomposition of this d x d matrix gives the components without ever squaring
the condition number. Only sums by dimension and d x d matrices reach the driver.

Cases: a null vector or one with a null or non-finite entry is dropped, as is one of another length than the most
frequent (of equally frequent ones the shortest); repeated vectors count once in the fit and each get rows; entries
beyond 2**61 / 256 are taken as that; fewer distinct directions than asked for give components that are all zero and
explain nothing; a ``deviation`` beyond a long is null; an empty table, or one without a usable vector, gives no rows;
other columns are carried along, those called like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.shared import materialise
from quillmark.llm.common import plain

RESULT = ("component", "n", "deviation", "whitened", "explained", "identity_error")
PASSES = 8
_UNIT = np.finfo(np.float64).eps / 2
_CLIP = float(1 << 61)
_FAN = 512  # partial matrices summed at once


class Model(NamedTuple):
    n: int
    sums: list[int]
    most: int  # largest absolute entry
    components: np.ndarray  # a row for each component
    values: np.ndarray  # eigenvalues of the covariance, falling
    trace: float
    identity_error: float
    passes: int


def quantised(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are usable, and the lengths and entries (as long) of those."""
    lengths = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    usable = column.is_valid().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    bad = ~np.isfinite(values)
    usable[row[bad]] = False
    chosen = usable[row]
    return usable, lengths[usable], np.floor(np.clip(values[chosen] * 256, -_CLIP, _CLIP)).astype(np.int64)


def whole_numbers(rows: DataFrame, column: str) -> DataFrame:
    """``x`` of all usable rows."""
    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, lengths, x = quantised(batch.column(0))
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(x))], ["x"])

    return rows.select(F.col(column).cast("array<double>")).mapInArrow(turn, "x array<long>")


def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy().reshape(-1, dims)


def sums(fit: DataFrame, dims: int) -> tuple[int, list[int], int]:
    """Rows, sum of each dimension and largest absolute entry, all exact."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, most = [0] * dims, 0, 0
        for batch in batches:
            x = matrix(batch, dims)
            if len(x):
                high = int(np.abs(x).max())
                part = x if high * len(x) < 1 << 62 else x.astype(object)
                total = [a + int(b) for a, b in zip(total, part.sum(axis=0), strict=True)]
                n, most = n + len(x), max(most, high)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dims), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)),
             pa.array([n] * dims, pa.int64()), pa.array([most] * dims, pa.int64())], ["i", "total", "n", "most"])

    found = fit.mapInArrow(add, "i int, total decimal(38,0), n long, most long").groupBy("i").agg(
        F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n"), F.max("most").alias("most")).orderBy("i").collect()
    return found[0]["n"], [int(r["total"]) for r in found], found[0]["most"]


def centring(n: int, total: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """x - S/n in double: the whole part of the mean goes off exactly, before anything is rounded."""
    whole = np.array([t // n for t in total], np.int64)
    rest = np.array([(t % n) / n for t in total])
    return lambda x: (x - whole).astype(np.float64) - rest


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of an upper triangular matrix, column by column."""
    out = np.empty(rows.shape, order="F")
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def gram(fit: DataFrame, dims: int, width: int, turn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of y'y over the rows y = turn(x), ``width`` wide; partial matrices are added in a fixed order."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch, dims)
            for at in range(0, len(x), 4096):
                y = turn(x[at : at + 4096])
                total += y.T @ y
        yield partial(np.arange(width), np.full(width, TaskContext.get().partitionId()), total)

    def partial(i: np.ndarray, part: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(part, pa.int64()), pa.array(list(rows), pa.list_(pa.float64()))],
            ["i", "part", "line"])

    def together(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("part").to_numpy(), kind="stable")
        lines = table.column("line").combine_chunks().flatten().to_numpy().reshape(-1, width)[order]
        first = table.column("part").to_numpy().min() // _FAN
        return pa.Table.from_batches([partial(
            table.column("i").to_numpy()[:1], np.array([first]), lines.sum(axis=0, keepdims=True))])

    kind = "i int, part long, line array<double>"
    parts = fit.mapInArrow(add, kind).groupBy("i", F.floor(F.col("part") / _FAN)).applyInArrow(together, kind)
    lines = parts.groupBy("i").applyInArrow(together, kind).orderBy("i").collect()  # d rows
    return np.array([r["line"] for r in lines])


def fit_model(fit: DataFrame, dims: int, wanted: int) -> Model:
    n, total, most = sums(fit, dims)
    centre = centring(n, total)
    factors: list[np.ndarray] = []
    trace = 0.0
    for _ in range(PASSES):
        def turn(x: np.ndarray, factors: tuple = tuple(factors)) -> np.ndarray:
            y = centre(x)
            for factor in factors:
                y = solved(y, factor)
            return y

        g = gram(fit, dims, dims, turn)
        low = np.linalg.eigvalsh(g)
        if not factors:
            trace = float(np.trace(g)) / n
        # blockwise sums err by a few units for each dimension, not for each row
        shift = 11 * dims * (dims + 1) * _UNIT * np.trace(g)
        if not factors or low[0] <= shift:
            g = g + (shift or 1.0) * np.eye(dims)
        factors.append(np.linalg.cholesky(g).T)
        # nearly orthonormal rows, but for directions without spread, are orthonormal after one more factor
        if len(factors) >= 3 and np.abs(low * (low - 1)).max() < 1e-8:
            break
    r = np.eye(dims)
    for factor in factors:
        r = factor @ r
    _, spread, axes = np.linalg.svd(r)
    known = (spread > 1e-10 * spread[0]) if trace else np.zeros(dims, np.bool_)
    values = np.where(known, spread**2 / n, 0.0)
    axes = axes * np.sign(axes[np.arange(dims), np.abs(axes).argmax(axis=1)])[:, None]
    model = Model(n, total, most, axes[:wanted], values[:wanted], trace, 0.0, len(factors))
    return model._replace(identity_error=identity_error(fit, dims, model))


def projecting(model: Model) -> Callable[[np.ndarray], np.ndarray]:
    centre = centring(model.n, model.sums)
    scale = np.divide(1.0, np.sqrt(model.values), out=np.zeros(len(model.values)), where=model.values > 0)
    return lambda x: centre(x) @ (model.components.T * scale)


def identity_error(fit: DataFrame, dims: int, model: Model) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, measured on the rows themselves."""
    project, width = projecting(model), len(model.values)
    both = gram(fit, dims, width + 1, lambda x: np.column_stack((project(x), np.ones(len(x)))))
    mean = both[:width, width] / model.n
    off = both[:width, :width] / model.n - np.outer(mean, mean) - np.diag((model.values > 0).astype(float))
    return float(np.abs(off).max(initial=0.0))


def deviations(x: np.ndarray, n: int, total: list[int], most: int) -> list[int | None]:
    """Sum of (n x - S) ** 2 of each row, exact; null where a long cannot hold it.

    With S = n q + r it is n n sum(y y) - 2 n sum(y r) + sum(r r) for y = x - q, which needs few large numbers."""
    whole, rest = [t // n for t in total], [t % n for t in total]
    room = 1 << 62
    small = 4 * most * most * len(total) < room and 2 * most * n * len(total) < room
    y = x - np.array(whole) if small else x.astype(object) - np.array(whole, object)
    r = np.array(rest, np.int64 if small else object)
    squares, cross = (y * y).sum(axis=1).tolist(), (y * r).sum(axis=1).tolist()
    base = sum(v * v for v in rest)
    found = (n * n * a - 2 * n * b + base for a, b in zip(squares, cross, strict=True))
    return [v if v < 1 << 63 else None for v in found]


def whiten(rows: DataFrame, column: str = "embedding", wanted: int = 4) -> DataFrame:
    """A row for each usable row and component: component, n, deviation, whitened, explained, identity_error."""
    kept = plain(rows, *RESULT)
    names = [c for c in kept.columns if c != column]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*names).schema.fields]
    schema = ", ".join([*kinds, "component int, n long, deviation long, whitened double, explained double, identity_error double"])
    distinct = materialise(whole_numbers(kept, column).distinct(), "fit-vectors")
    lengths = distinct.groupBy(F.size("x").alias("dims")).count().filter("dims > 0").orderBy(F.desc("count"), "dims").first()
    if lengths is None:
        return rows.sparkSession.createDataFrame([], schema)
    dims = lengths["dims"]
    model = fit_model(distinct.filter(F.size("x") == dims), dims, wanted)
    project, width = projecting(model), len(model.values)
    explained = (model.values / model.trace) if model.trace else model.values

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, size, x = quantised(batch.column(batch.num_columns - 1))
            right = size == dims
            x = x[np.repeat(right, size)].reshape(-1, dims)
            at = np.repeat(np.flatnonzero(usable)[right], width)
            m = len(x)
            off = pa.array(deviations(x, model.n, model.sums, model.most), pa.int64())
            yield pa.RecordBatch.from_arrays([
                *(c.take(pa.array(at)) for c in batch.columns[:-1]),
                pa.array(np.tile(np.arange(1, width + 1), m), pa.int32()), pa.array(np.full(m * width, model.n)),
                off.take(pa.array(np.repeat(np.arange(m), width))), pa.array(project(x).ravel()),
                pa.array(np.tile(explained, m)), pa.array(np.full(m * width, model.identity_error))], [*names, *RESULT])

    return kept.select(*names, F.col(column).cast("array<double>").alias("_vector")).mapInArrow(turn, schema)
