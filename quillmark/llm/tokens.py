"""Token ids in files of directly addressable codes.

Texts are encoded in ascending doc_id order and cut into segments of about a million tokens. A segment stores its
ids level by level: eight bits of every id, then eight more of those ids that continue, and so on. Each level has
a bitmap of the ids that continue and a rank directory (ones before every 512 bits), so token i is found by one
rank per level, without decoding a block. Segments are rows of a Parquet table, written by Spark's committer.

Cases: null texts are empty and hold the end id alone; rows with a null doc_id come last; rows of one doc_id are
ordered by a hash of their text; an empty table gives an empty file set; other input columns are not stored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import text_of

MAGIC, BITS, SUPER = b"DAC1", 8, 512
SEGMENT_TOKENS = 1 << 20
CACHE = 300_000
#: A single space between two characters that are not white space always starts a token of its own.
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Letters are one token's border to any ASCII mark after them.
_WORD = re.compile(r"( ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-/:-@\[-`{-~].*)?", re.DOTALL)
#: White space other than a space and a line feed.
_RARE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
SCHEMA = "part int, seq int, n_tokens long, doc_ids binary, nulls binary, ends binary, code binary"


class Memory(dict):
    """Values made on first use, in two bounded generations: what was asked for lately outlives a clearing."""

    def __init__(self, make: Callable[[str], bytes], limit: int = CACHE):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


def byte_letters() -> dict[int, str]:
    """The characters byte-level models spell bytes with: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """The tokenizer with a memory for pieces of text whose borders tokens never cross.

    The borders hold for byte-level models without a normalizer; other models encode whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # each task has one core
        self.whole = Tokenizer.from_file(path)
        self.model, self.letters = self.whole.model, byte_letters()
        self.pieces, self.words, self.others = Memory(self._piece), Memory(self._word), Memory(self._whole)
        parts = json.loads(self.whole.to_str())
        first = parts["pre_tokenizer"] or {}
        self.cuts = (
            first.get("type") == "ByteLevel" and not first["add_prefix_space"]
            and first.get("use_regex", True) and parts["normalizer"] is None)

    def ids(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.cuts:
            return self._whole(text)
        first, *rest = text.split(" ")
        # white space next to a space: find the borders one by one
        if "" in rest or not first or any(c in text for c in _RARE) or "\n " in text or " \n" in text:
            pieces = _CUT.split(text)
        else:
            pieces = [first, *map(" ".__add__, rest)]
        return b"".join(map(self.pieces.__getitem__, pieces))

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """A bare word is one token border to the next, so the model takes it as it is."""
        spelt = word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(spelt)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        """A word and the marks after it, each by itself; anything else goes through the whole tokenizer."""
        m = _WORD.fullmatch(piece)
        if m is None:
            return self.others[piece]
        return self.words[m[1]] + self.others[m[2]] if m[2] else self.words[m[1]]


def encoder(path: str) -> Encoder:
    """The encoder of this worker process. Workers run one task after another, so what one task has met need not be
    encoded again by the next; it hangs on an imported module, as this one is loaded anew for each task."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_kept_encoders", {})
    if path not in kept:
        kept.clear()
        kept[path] = Encoder(path)
    return kept[path]


def pack(ids: np.ndarray) -> bytes:
    """Directly addressable code of unsigned 32-bit ids."""
    levels = []
    rest = ids.astype(np.uint32)
    while True:
        more = rest >> BITS > 0
        counts = np.add.reduceat(more, np.arange(0, len(more), SUPER)) if len(more) else np.empty(0, np.int64)
        before = np.concatenate(([0], np.cumsum(counts))).astype("<u8")
        levels.append((
            (rest & ((1 << BITS) - 1)).astype(np.uint8).tobytes(),
            np.packbits(more, bitorder="little").tobytes(), before.tobytes()))
        rest = rest[more] >> BITS
        if not len(rest):
            break
    head = struct.pack("<4sBQ", MAGIC, len(levels), len(ids))
    sizes = b"".join(struct.pack("<QQQ", *map(len, level)) for level in levels)
    return head + sizes + b"".join(b"".join(level) for level in levels)


class Codes:
    """Random access to a packed code."""

    def __init__(self, data: bytes):
        magic, count, self.size = struct.unpack_from("<4sBQ", data)
        if magic != MAGIC:
            raise ValueError("not a directly addressable code")
        at = struct.calcsize("<4sBQ")
        sizes = [struct.unpack_from("<QQQ", data, at + 24 * k) for k in range(count)]
        at += 24 * count
        self.levels = []
        for chunks, bits, ranks in sizes:
            self.levels.append((
                np.frombuffer(data, np.uint8, chunks, at),
                np.frombuffer(data, np.uint8, bits, at + chunks),
                np.frombuffer(data, "<u8", ranks // 8, at + chunks + bits)))
            at += chunks + bits + ranks

    def _rank(self, level: int, i: int) -> int:
        """Ids before the i-th of a level that continue."""
        _, bits, before = self.levels[level]
        block = i // SUPER
        part = np.unpackbits(bits[block * SUPER // 8 : (i + 7) // 8], bitorder="little", count=i - block * SUPER)
        return int(before[block]) + int(part.sum())

    def slice(self, start: int, stop: int) -> np.ndarray:
        out = np.zeros(stop - start, np.uint32)
        where = np.arange(stop - start)
        for level, (chunks, bits, _) in enumerate(self.levels):
            if start >= stop:
                break
            out[where] |= chunks[start:stop].astype(np.uint32) << np.uint32(BITS * level)
            more = np.unpackbits(
                bits[start // 8 : (stop + 7) // 8], bitorder="little")[start % 8 : start % 8 + stop - start]
            where = where[more.astype(bool)]
            if not len(where):
                break
            start = self._rank(level, start)
            stop = start + len(where)
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode every text, append ``end_id`` and write the segments in ascending doc_id order."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = encoder(tokenizer).ids, TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        names, pieces, ends, total = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                piece = encode(text) + end
                total += len(piece) // 4
                names.append(doc_id)
                pieces.append(piece)
                ends.append(total)
                if total >= SEGMENT_TOKENS:
                    yield segment(part, seq, names, pieces, ends)
                    names, pieces, ends, total, seq = [], [], [], 0, seq + 1
        if names:
            yield segment(part, seq, names, pieces, ends)

    ordered = (
        docs.select("doc_id", text_of().alias("_text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_last(), F.xxhash64("_text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), F.xxhash64("_text"))
    )
    ordered.mapInArrow(segments, SCHEMA).write.parquet(path)


def segment(part: int, seq: int, names: list, pieces: list[bytes], ends: list[int]) -> pa.RecordBatch:
    row = {
        "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
        "n_tokens": pa.array([ends[-1]], pa.int64()),
        "doc_ids": pa.array([np.array([0 if n is None else n for n in names], "<i8").tobytes()], pa.binary()),
        "nulls": pa.array([np.array([n is None for n in names], np.bool_).tobytes()], pa.binary()),
        "ends": pa.array([np.array(ends, "<i8").tobytes()], pa.binary()),
        "code": pa.array([pack(np.frombuffer(b"".join(pieces), "<u4"))], pa.binary()),
    }
    return pa.RecordBatch.from_pydict(row)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each segment: sums over parts first, then inside each part."""
    sizes = spark.read.parquet(path).select("part", "seq", "n_tokens")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select(  # one row for each written partition
        "part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(F.broadcast(base), "part").select(
        "part", "seq", (F.col("_base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("_start"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens and the checksum of its ids."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, ids, nulls, ends, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes, ends = Codes(code), np.frombuffer(ends, "<i8")
                begins = np.concatenate(([0], ends[:-1]))
                sums = [
                    zlib.crc32(codes.slice(a, b).astype("<u4").tobytes())
                    for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ends), pa.int32()), pa.array([seq] * len(ends), pa.int32()),
                     pa.array(np.frombuffer(ids, "<i8"), pa.int64(), mask=np.frombuffer(nulls, np.bool_)),
                     pa.array(begins, pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(sums, pa.int64())],
                    ["part", "seq", "doc_id", "_offset", "n_tokens", "ids_crc32"])

    found = spark.read.parquet(path).select("part", "seq", "doc_ids", "nulls", "ends", "code").mapInArrow(
        documents, "part int, seq int, doc_id long, _offset long, n_tokens long, ids_crc32 long")
    return found.join(starts(spark, path), ["part", "seq"]).select(
        "doc_id", (F.col("_start") + F.col("_offset")).alias("start"), "n_tokens", "ids_crc32")
