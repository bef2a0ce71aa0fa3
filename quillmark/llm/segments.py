"""Runs of neighbouring windows that share a minimiser, packed by bucket, and the removal of marked spans.

Every window of a text belongs to the run of windows around it that have the same smallest hash, and equal windows
have equal smallest hashes. So a run's string, sent once to the bucket of its minimiser, carries all its windows to
the task that sees every equal window. Within a chunk of input a string that occurs many times is sent once with
its places, which keeps common passages small before the shuffle.
"""

from __future__ import annotations

import array
import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import hinted

#: Rows with a null id come after all others.
LAST = 9223372036854775807
SMALL = 1_000_000  # repeated ids up to which they are sent to every task
CHUNK_BYTES = 12 << 20
BUCKET_BYTES = 4 << 20
MARKS = "_ord long, _key long, start long, stop long"
_MARK = (1 << 24) - 1  # bits of a minimiser that travel beside its bucket; equal ones always meet
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` items, by doubling the length covered."""
    base, have, whole = np.uint64(0x9E3779B97F4A7C15), 1, h
    while have < size:
        step = min(have, size - have)
        power = np.uint64(pow(int(base), step, 1 << 64))
        whole = whole[: len(whole) - step] * power + (whole[step:] if step == have else _tail(h, base, step, have))
        have += step
    return mixed(whole)


def _tail(h: np.ndarray, base: np.uint64, step: int, have: int) -> np.ndarray:
    part = h[have:]
    out = part[: len(part) - step + 1].copy()
    for i in range(1, step):
        out = out * base + part[i : len(part) - step + 1 + i]
    return out


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        h = np.minimum(h[: len(h) - step], h[step:])
        have += step
    return h


def runs(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, end and minimum of each run of windows of ``width`` hashes with one minimum."""
    low = sliding_min(h, width)
    first = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
    return first, np.append(first[1:], len(low)), low[first]


class Packer:
    """Strings of one chunk by bucket, each once, with all its places."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.bytes = buckets, {}, 0

    def add(self, order: int, key: int, value: int, string: bytes, start: int, several: bool = False) -> None:
        """``several``: the string may hold one window twice."""
        strings, marks, places = self.held.setdefault(
            value % self.buckets, ({}, array.array("q"), array.array("q")))
        at = strings.get(string)
        if at is None:
            at = strings[string] = len(strings)
            marks.append((value // self.buckets & _MARK) << 1 | several)
        places.extend((at, order, key, start))

    def flush(self) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        rows = []
        for bucket, (strings, marks, places) in self.held.items():
            spots = np.frombuffer(places, np.int64).reshape(-1, 4)
            spots = spots[np.argsort(spots[:, 0], kind="stable")]
            parts = (
                np.fromiter(map(len, strings), np.int32, len(strings)).tobytes(), b"".join(strings),
                np.frombuffer(marks, np.int64).astype(np.int32).tobytes(),
                np.bincount(spots[:, 0], minlength=len(strings)).astype(np.int32).tobytes(),
                np.diff(spots[:, 1], prepend=0).tobytes(), spots[:, 2].tobytes(), spots[:, 3].tobytes())
            rows.append((bucket, squeeze.compress(pickle.dumps(parts))))
        self.held, self.bytes = {}, 0
        for i in range(0, len(rows), 64):
            cut = rows[i : i + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in cut], pa.int64()), pa.array([p for _, p in cut], pa.binary())],
                ["bucket", "payload"])


class Bucket:
    """The strings of a bucket that can share a window with another, each once, with places sorted by string.

    A string whose minimiser has no other place in the bucket is left out before it is unpacked."""

    def __init__(self, payloads: list[bytes]):
        parts = [pickle.loads(zstandard.ZstdDecompressor().decompress(p)) for p in payloads]
        marks = [np.frombuffer(p[2], np.int32) for p in parts]
        tallies = [np.frombuffer(p[3], np.int32) for p in parts]
        line = np.concatenate(marks)
        _, inverse = np.unique(line >> 1, return_inverse=True)
        seen = np.bincount(inverse, weights=np.concatenate(tallies))[inverse]
        wanted = (seen > 1) | (line & 1 > 0)
        known: dict[bytes, int] = {}
        places, at = [], 0
        for part, tally in zip(parts, tallies, strict=True):
            keep = wanted[at : at + len(tally)]
            at += len(tally)
            chosen = np.flatnonzero(keep)
            if not len(chosen):
                continue
            lengths = np.frombuffer(part[0], np.int32).astype(np.int64)
            ends = np.cumsum(lengths)
            own = np.zeros(len(tally), np.int64)
            own[chosen] = [
                known.setdefault(part[1][a:b], len(known))
                for a, b in zip((ends - lengths)[chosen].tolist(), ends[chosen].tolist(), strict=True)]
            spots = np.column_stack((
                np.repeat(own, tally), np.cumsum(np.frombuffer(part[4], np.int64)),
                np.frombuffer(part[5], np.int64), np.frombuffer(part[6], np.int64)))
            places.append(spots[np.repeat(keep, tally)])
        spots = np.concatenate(places) if places else np.empty((0, 4), np.int64)
        self.strings = list(known)
        self.places = spots[np.lexsort((spots[:, 3], spots[:, 2], spots[:, 1], spots[:, 0]))]
        self.count = np.bincount(self.places[:, 0], minlength=len(known))
        self.offset = np.concatenate(([0], np.cumsum(self.count)))


def dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def keyed(docs: DataFrame, text: Column) -> DataFrame:
    """Add ``_ord`` and ``_key``, which tells rows that share an id (or have none) apart by their texts."""
    twice = docs.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("doc_id").alias("_twice"))
    own = F.when(F.col("doc_id").isNull() | F.col("_twice").isNotNull(), F.xxhash64(text)).otherwise(F.lit(0))
    return (
        docs.join(hinted(twice, SMALL), F.col("doc_id") == F.col("_twice"), "left")
        .withColumns({"_ord": F.coalesce(F.col("doc_id"), F.lit(LAST)), "_key": own}).drop("_twice"))


def buckets_for(docs: DataFrame, text: Column) -> int:
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(16, math.ceil(total / BUCKET_BYTES))


def marks(
    docs: DataFrame, text: Column, cut: Callable[[Packer, int, int, bytes], None],
    judge: Callable[[Bucket], list[np.ndarray]],
) -> DataFrame:
    """Spans to remove from keyed rows: ``cut`` packs a text's runs, ``judge`` returns (order, key, start, stop) arrays of a bucket."""
    buckets = buckets_for(docs, text)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets)
        for batch in batches:
            for order, key, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cut(packer, order, key, data)
                packer.bytes += len(data)
                if packer.bytes >= CHUNK_BYTES:
                    yield from packer.flush()
        yield from packer.flush()

    def settle(table: pa.Table) -> pa.Table:
        found = judge(Bucket(table.column("payload").to_pylist()))
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("_ord", "_key", "start", "stop"), found, strict=True)})

    packed = docs.select("_ord", "_key", text.cast("binary").alias("_text")).mapInArrow(
        pack, "bucket long, payload binary")
    return packed.groupBy("bucket").applyInArrow(settle, MARKS)


def places_of(bucket: Bucket, string: int) -> np.ndarray:
    return bucket.places[bucket.offset[string] : bucket.offset[string + 1]]


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Keyed rows with ``_spans``, the marked spans of each row; a row has at most as many as it has windows."""
    own = found.groupBy("_ord", "_key").agg(F.collect_list(F.struct("start", "stop")).alias("_spans"))
    return docs.join(own, ["_ord", "_key"], "left").drop("_ord", "_key")


def covered(starts: np.ndarray, stops: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` items some span holds."""
    depth = np.zeros(size + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, stops, -1)
    return np.cumsum(depth[:-1]) > 0


def flags_of(found: list[dict] | None, size: int) -> np.ndarray:
    found = found or []
    return covered(
        np.array([s["start"] for s in found], np.int64), np.array([s["stop"] for s in found], np.int64), size)
