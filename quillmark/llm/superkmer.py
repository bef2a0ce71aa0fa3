"""Remove word passages that an earlier document already has, by super-k-mer partitioning.

A window is ``size`` consecutive words. Windows next to each other whose smallest hash of ``gram`` words is the same
travel as one packed string to the bucket of that minimiser, where ranks of 2, 4, 8 and ``size`` words sort equal
windows together without hashing. A word goes if a window over it also starts in a document with a smaller doc_id.

Cases: null texts have no words; texts under ``size`` words keep all; rows of one doc_id do not remove each other's
words; rows with a null doc_id come last, after every id; repeated rows get the same result; an empty table gives
an empty result; input columns called like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from quillmark.llm import segments
from quillmark.llm.common import plain, text_of

RESULT = ("n_words", "n_removed", "kept")
_PIECE = 1 << 18


def cutter(size: int, gram: int):
    def cut(packer: segments.Packer, order: int, key: int, data: bytes) -> None:
        words = data.split()
        if len(words) < size:
            return
        line = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begin = np.concatenate(([0], np.cumsum(lengths))).tolist()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        grams = segments.gram_hashes(hashes, gram)
        width = size - gram + 1
        for at in range(0, len(words) - size + 1, _PIECE):
            firsts, stops, lows = segments.runs(grams[at : at + _PIECE + width - 1], width)
            for a, b, low in zip((firsts + at).tolist(), (stops + at).tolist(), lows.tolist(), strict=True):
                packer.add(order, key, low, line[begin[a] : begin[b + size - 1] - 1], a)

    return cut


def judge(size: int):
    def settle(bucket: segments.Bucket) -> list[np.ndarray]:
        """Windows of a bucket that start in an earlier document, as word spans of every place they occur at."""
        if not bucket.strings:
            return [np.empty(0, np.int64)] * 4
        ids: dict[bytes, int] = {}
        split = [s.split(b" ") for s in bucket.strings]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        words = np.fromiter(
            (ids.setdefault(w, len(ids)) for s in split for w in s), np.int64, int(lengths.sum()))
        del split
        rank, have = words, 1
        while have < size:
            step = min(have, size - have)
            rank = segments.dense((rank[: len(rank) - step] << 32) | rank[step:])
            have += step
        ends = np.cumsum(lengths)
        counts = lengths - size + 1
        string = np.repeat(np.arange(len(lengths)), counts)
        within = np.arange(len(string)) - np.repeat(np.cumsum(counts) - counts, counts)
        group = rank[(ends - lengths)[string] + within]
        first = bucket.places[bucket.offset[:-1], 1]
        last = bucket.places[bucket.offset[1:] - 1, 1]
        lowest = np.full(int(group.max()) + 1, segments.LAST, np.int64)
        np.minimum.at(lowest, group, first[string])
        low = lowest[group]
        out: list[list[np.ndarray]] = [[], [], [], []]
        edges = np.concatenate(([0], np.cumsum(counts)))
        for s in np.unique(string[low < last[string]]).tolist():
            own = low[edges[s] : edges[s + 1]]
            for bound in np.unique(own).tolist():
                places = segments.places_of(bucket, s)
                later = places[places[:, 1] > bound]
                if len(later):
                    for a, b in zip(*segments.spans(own == bound), strict=True):
                        out[0].append(later[:, 1])
                        out[1].append(later[:, 2])
                        out[2].append(later[:, 3] + a)
                        out[3].append(later[:, 3] + b + size - 1)
        return [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]

    return settle


def deduplicate(docs: DataFrame, size: int = 13, gram: int = 3) -> DataFrame:
    """``docs`` with n_words, n_removed and ``kept``, the words left, one space apart."""
    rows = plain(docs, *RESULT)
    text = text_of()
    named = segments.keyed(rows, text)
    found = segments.marks(named, text, cutter(size, gram), judge(size))
    joined = segments.with_spans(named, found)
    names = rows.columns
    at = names.index("text")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for data, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                words = (data or "").encode().split()
                flags = segments.flags_of(spans, len(words))
                n.append(len(words))
                gone.append(int(flags.sum()))
                kept.append(b" ".join([w for w, f in zip(words, flags.tolist(), strict=True) if not f]).decode())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                [*names, *RESULT])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    return joined.select(*names, "_spans").mapInArrow(
        strip, ", ".join([*kinds, "n_words long", "n_removed long", "kept string"]))
