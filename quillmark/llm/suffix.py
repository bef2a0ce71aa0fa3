"""Remove byte strings of some length that occur more than once, by longest previous factors.

Windows of ``size`` bytes travel with the others around them that share a minimiser, so each bucket holds every
place of its windows. There the strings are laid end to end and their suffixes are sorted by prefix doubling (the
first ``size`` bytes decide). With the common prefixes of neighbours in that order, the previous and next smaller
positions give each suffix its longest previous factor, cut at ``size`` bytes: where it has that length, an earlier
copy exists and the bytes of the window go. The first place has none and stays. Without ``keep_first`` the longest
factors at later positions are taken as well, so that all places of a repeated string go.

Cases: null texts have no bytes; texts under ``size`` bytes keep all; matches never cross rows, and two rows with
one doc_id are two texts; rows with a null doc_id come last; repeated rows are copies of each other and get the
same result (with ``keep_first`` too, as they cannot be told apart: both keep the first place); an empty table gives
an empty result; input columns called like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmark.llm import segments
from quillmark.llm.common import plain, text_of

RESULT = ("n_bytes", "n_removed", "n_spans", "kept")
_PIECE = 1 << 18


def cutter(size: int, gram: int):
    width = size - gram + 1

    def cut(packer: segments.Packer, order: int, key: int, data: bytes) -> None:
        line = np.frombuffer(data, np.uint8)
        for at in range(0, len(data) - size + 1, _PIECE):
            grams = segments.gram_hashes(line[at : at + _PIECE + size - 1].astype(np.uint64) + np.uint64(1), gram)
            firsts, stops, lows = segments.runs(grams, width)
            for a, b, low in zip(firsts.tolist(), stops.tolist(), lows.tolist(), strict=True):
                several = np.count_nonzero(grams[a : b - 1 + width] == low) > 1
                packer.add(order, key, low, data[at + a : at + b - 1 + size], at + a, several)

    return cut


def suffix_ranks(line: np.ndarray, size: int, words: np.ndarray | None = None) -> np.ndarray:
    """The place of each suffix's group in the order of suffixes told apart by their first ``size`` bytes.

    Prefix doubling: a rank is the index at which the group begins, so refining a group keeps it in its place, and
    suffixes already alone are not sorted again. ``line`` must have ``size`` more bytes after the last position of
    interest; positions nearer to its end sort as if zeros followed. ``words``: ``words_of(line)``, if at hand.
    """
    n, have = len(line), min(8, size)
    words = words_of(line) if words is None else words
    rank, active = _refined(words >> np.uint64(64 - 8 * have), np.arange(n, dtype=np.int32), None, n)
    while have < size and len(active):
        step = min(have, size - have)
        after = active + np.int32(step)
        behind = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        fresh, still = _refined(rank[active] * np.int64(n + 1) + behind, active, rank[active], n)
        rank[active] = fresh
        active, have = still, have + step
    return rank


def words_of(line: np.ndarray) -> np.ndarray:
    """The next eight bytes of each position as one number, zeros after the end."""
    padded = np.concatenate((line, np.zeros(8, np.uint8)))
    keys = np.zeros(len(line), np.uint64)
    for i in range(8):
        keys <<= np.uint64(8)
        keys |= padded[i : i + len(line)]
    return keys


def _refined(keys: np.ndarray, where: np.ndarray, group: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """New group starts of positions ``where`` (in that order), and the positions that are not alone yet. ``keys``
    order positions by their old group first; without groups all are one."""
    order = np.argsort(keys)
    key = keys[order]
    index = np.arange(len(order), dtype=np.int32)
    parts = np.concatenate(([True], key[1:] != key[:-1]))
    del key
    first = np.maximum.accumulate(np.where(parts, index, 0))
    if group is not None:
        old = group[order]
        opens = np.concatenate(([True], old[1:] != old[:-1]))
        first += (old - np.maximum.accumulate(np.where(opens, index, 0))).astype(np.int32)
    fresh = np.empty(len(order), np.int32)
    fresh[order] = first
    several = ~(parts & np.concatenate((parts[1:], [True])))
    return fresh, np.sort(where[order[several]])


def common_prefixes(words: np.ndarray, one: np.ndarray, two: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each pair of suffixes, at most ``most``; both must have as many bytes."""
    length = np.zeros(len(one), np.int64)
    left = np.arange(len(one))
    for at in range(0, most, 8):
        differ = words[one[left] + at] ^ words[two[left] + at]
        same = differ == 0
        length[left[same]] = at + 8
        apart = differ[~same]
        equal = np.zeros(len(apart), np.int64)
        for byte in range(7):  # leading bytes that are equal
            equal += (apart >> np.uint64(56 - 8 * byte) == 0)
        length[left[~same]] = at + equal
        left = left[same]
        if not len(left):
            break
    return np.minimum(length, most)


def smaller_factors(position: np.ndarray, lcp: np.ndarray, floor: int = 0) -> np.ndarray:
    """Longest match of each suffix with one at a smaller position, by previous and next smaller positions.

    ``position`` lists suffixes in suffix order, ``lcp[i]`` is the common prefix of suffix i - 1 and i (0 for the
    first). Pointers to the left and to the right skip to their neighbour's pointer until they reach a smaller
    position, keeping the least common prefix on the way; a match that falls under ``floor`` is given up and counts 0.
    """
    n = len(position)
    best = np.zeros(n, np.int64)
    for side in (1, -1):
        order, common = (position, lcp) if side == 1 else (position[::-1], np.concatenate(([0], lcp[1:][::-1])))
        point = np.arange(n) - 1
        reach = common.copy()
        live = (point >= 0) & (reach >= max(1, floor))
        reach[~live] = 0
        active = np.flatnonzero(live)
        while True:
            active = active[order[point[active]] > order[active]]
            if not len(active):
                break
            through = point[active]
            least = np.minimum(reach[active], reach[through])
            onward = point[through]
            reach[active], point[active] = np.where((onward < 0) | (least < max(1, floor)), 0, least), onward
            active = active[reach[active] > 0]
        best = np.maximum(best, reach if side == 1 else reach[::-1])
    return best


def judge(size: int, keep_first: bool):
    def settle(bucket: segments.Bucket) -> list[np.ndarray]:
        strings = bucket.strings
        if not strings:
            return [np.empty(0, np.int64)] * 4
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        line = np.frombuffer(b"".join(strings), np.uint8)
        words = words_of(line)
        rank = suffix_ranks(line, size, words)
        counts = lengths - size + 1
        string = np.repeat(np.arange(len(lengths), dtype=np.int32), counts)
        within = np.arange(len(string)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = (np.cumsum(lengths) - lengths)[string] + within
        # a suffix alone in its group shares less than ``size`` bytes with every other: its factors count for nothing
        own = rank[start]
        kept = np.flatnonzero(np.bincount(own, minlength=len(line))[own] > 1)
        start, own, inside = start[kept], own[kept], within[kept]
        # suffixes in suffix order, and where in the whole corpus each has its first place
        head = bucket.places[bucket.offset[:-1]][string[kept]]
        place = np.empty(len(kept), np.int64)
        place[np.lexsort((head[:, 3] + inside, head[:, 2], head[:, 1]))] = np.arange(len(kept))
        order = np.lexsort((place, own))
        lcp = np.concatenate(([0], common_prefixes(words, start[order[:-1]], start[order[1:]], size)))[: len(kept)]
        earlier, later = np.zeros(len(string), np.bool_), np.zeros(len(string), np.bool_)
        earlier[kept[order]] = smaller_factors(place[order], lcp, size) >= size
        again = bucket.count[string] > 1
        if not keep_first:
            later[kept[order]] = smaller_factors(-place[order], lcp, size) >= size
        edges = np.concatenate(([0], np.cumsum(counts)))
        out: list[list[np.ndarray]] = [[], [], [], []]
        for s in np.unique(string[earlier | later | again]).tolist():
            span = slice(edges[s], edges[s + 1])
            spots = segments.places_of(bucket, s)
            if keep_first:  # all places of a string but its first have that one before them
                parts = [(spots[:1], earlier[span]), (spots[1:], np.ones(counts[s], np.bool_))]
            else:
                parts = [(spots, earlier[span] | later[span] | again[span])]
            for rows, flags in parts:
                for a, b in zip(*segments.spans(flags), strict=True):
                    out[0].append(rows[:, 1])
                    out[1].append(rows[:, 2])
                    out[2].append(rows[:, 3] + a)
                    out[3].append(rows[:, 3] + b + size - 1)
        return [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]

    return settle


def deduplicate(docs: DataFrame, size: int = 400, gram: int = 64, keep_first: bool = True) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and ``kept``, the bytes left (a cut may fall inside a character)."""
    rows = plain(docs, *RESULT)
    text = text_of()
    named = segments.keyed(rows, text)
    found = segments.marks(named, text, cutter(size, min(gram, size)), judge(size, keep_first))
    joined = segments.with_spans(named, found)
    names = rows.columns
    at = names.index("text")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, runs, kept = [], [], [], []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                data = (text or "").encode()
                flags = segments.flags_of(spans, len(data))
                n.append(len(data))
                gone.append(int(flags.sum()))
                runs.append(len(segments.spans(flags)[0]))
                kept.append(np.frombuffer(data, np.uint8)[~flags].tobytes() if spans else data)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in (n, gone, runs)), pa.array(kept, pa.binary())],
                [*names, *RESULT])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    return joined.select(*names, "_spans").mapInArrow(
        strip, ", ".join([*kinds, "n_bytes long", "n_removed long", "n_spans long", "kept binary"]))
