"""Quality rules, and an isolation forest over their statistics.

Each text becomes a row of counts. Two fixed rules fail a text outright. An isolation forest, fitted on a bounded
sample of rows labelled good, isolates each row of rule statistics by random splits; short paths mean an unusual text.
The threshold on the anomaly score is calibrated on all labelled rows: the lowest that rejects at most a given
share of those labelled good.

Cases: null texts have no words and fail the base rules; without rows labelled good no forest is fitted and the base
rules decide; null labels are ignored; repeated rows get the same result; an empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.shared import materialise
from quillmark.llm.common import text_of
from quillmark.llm.segments import covered, gram_hashes, spans

SYMBOLS, WHITE, WINDOW = "#*$%&|<>", "\x20\t\n\x0b\x0c\r", 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_distinct", "n_upper")
USED = ("n_words", "word_chars", "n_symbols", *MORE)
TREES, SAMPLE, BINS = 100, 256, 4096
MIN_WORDS, MAX_REPEAT = 20, 30


def counts(text: str) -> tuple[int, ...]:
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, WHITE))
    lines = text.split("\n")
    filled = [x for x in lines if x.strip(WHITE)]
    repeated = 0
    if len(words) >= WINDOW:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        _, inverse, times = np.unique(gram_hashes(hashes, WINDOW), return_inverse=True, return_counts=True)
        starts, stops = spans(times[inverse] > 1)
        repeated = int(np.count_nonzero(covered(starts, stops + WINDOW - 1, len(words))))
    upper = sum(map(str.isupper, text))
    return (
        len(words), chars, sum(map(text.count, SYMBOLS)), len(filled) - len(set(filled)), repeated,
        len(set(words)), upper)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([counts(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS + MORE))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in rows.T)], ["doc_id", *COUNTS, *MORE])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS + MORE)
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("_text")).mapInArrow(measure, schema)


def features(rows: np.ndarray) -> np.ndarray:
    """Rule statistics of counts in the order of USED: word length, symbols a word, distinct words, capitals."""
    words, chars, symbols, distinct, upper = rows.astype(float).T
    w = np.maximum(words, 1)
    return np.column_stack((chars / w, symbols / w, distinct / w ** 0.9, upper / np.maximum(chars, 1)))


class Forest:
    """Isolation trees as arrays: split feature (-1 at a leaf), split value, children, and path length at a leaf.

    Splits are drawn from a node's range widened by a part of the feature's whole spread, so that also values
    outside what the sample holds are cut off early, even where the sample is constant.
    """

    def __init__(self, rows: np.ndarray, seed: int = 7, trees: int = TREES, sample: int = SAMPLE, widen: float = 0.3):
        chance = np.random.default_rng(seed)
        low, high = np.percentile(rows, (0.5, 99.5), axis=0)
        self.sample, self.margin = min(sample, len(rows)), np.maximum(high - low, 1e-3) * widen
        self.trees = [
            self._grow(rows[chance.choice(len(rows), self.sample, replace=False)], chance) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, chance) -> tuple[np.ndarray, ...]:
        limit = int(np.ceil(np.log2(max(self.sample, 2))))
        nodes: list[list[float]] = []
        todo = [(rows, 0, -1, 0)]
        while todo:
            own, depth, parent, side = todo.pop()
            at = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = at
            if depth >= limit or len(own) < 2:
                nodes.append([-1, 0, at, at, depth + average_path(len(own))])
                continue
            f = int(chance.integers(own.shape[1]))
            value = float(chance.uniform(own[:, f].min() - self.margin[f], own[:, f].max() + self.margin[f]))
            nodes.append([f, value, 0, 0, 0])
            left = own[:, f] <= value
            todo += [(own[left], depth + 1, at, 0), (own[~left], depth + 1, at, 1)]
        table = np.array(nodes)
        return table[:, 0].astype(int), table[:, 1], table[:, 2:4].astype(int), table[:, 4]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1): two to the minus mean path over the expected path."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, value, child, length in self.trees:
            at = np.zeros(len(rows), int)
            while True:
                f = feature[at]
                if (f < 0).all():
                    break
                side = (rows[every, np.maximum(f, 0)] > value[at]).astype(int)
                at = np.where(f < 0, at, child[at, side])
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(average_path(self.sample), 1e-9))


def average_path(n: int) -> float:
    if n < 2:
        return 0.0
    return 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else 1.0


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """Add the column ``anomaly``."""
    names = stats.columns
    at = [names.index(c) for c in USED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy() for i in at])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(forest.score(features(rows)), pa.float64())], [*names, "anomaly"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema.fields)
    return stats.mapInArrow(run, f"{kinds}, anomaly double")


def calibrate(labelled: DataFrame, loss: float) -> float:
    """The lowest threshold whose rejects hold at most ``loss`` of the rows labelled good; from one histogram."""
    bins = labelled.filter("quality = 1").groupBy(F.floor(F.col("anomaly") * BINS).alias("b")).count().collect()
    good, at = {r["b"]: r["count"] for r in bins}, BINS
    total, gone = sum(good.values()), 0
    while at > 0 and gone + good.get(at - 1, 0) <= loss * total:
        at -= 1
        gone += good.get(at, 0)
    return at / BINS


def judge(docs: DataFrame, labels: DataFrame, loss: float = 0.002) -> DataFrame:
    """Counts, base_failed, anomaly and kept for every document."""
    stats = materialise(statistics(docs), "rule-statistics")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    marked = labels.select("doc_id", "quality").filter("quality in (0, 1)")
    own = stats.join(marked, "doc_id").filter("not base_failed")
    sample = own.filter("quality = 1").orderBy(F.xxhash64("doc_id"), *USED).limit(TREES * SAMPLE).select(*USED).toPandas()
    if not len(sample):
        return stats.withColumns({"anomaly": F.lit(0.0), "kept": ~F.col("base_failed")})
    forest = Forest(features(sample.to_numpy()))
    bound = calibrate(scored(own, forest), loss)
    return scored(stats, forest).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < bound))
