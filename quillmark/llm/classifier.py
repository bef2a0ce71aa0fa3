"""A text quality classifier of subword embeddings.

A word is the mean of hashed vectors of itself and its character n-grams, a document the mean over all of these,
and a softmax of a linear layer gives the class. Vectors and layer are trained together by stochastic gradient
descent in numpy, on a bounded sample of labelled documents with as many good as bad. A word that repeats the one
before it adds one more feature, a word bigram that all such pairs share. As the output is linear in the vectors,
scoring needs one number for each hash bucket.

Cases: null and empty texts score by the trained bias alone; null labels are ignored; without labelled rows of
both kinds every text scores 0.5; repeated rows score alike; other columns are passed through, and an input column
called ``score`` is replaced.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import plain, text_of

BUCKETS, WIDTH, GRAMS = 1 << 16, 8, (3, 4)
PER_CLASS = 2000
EPOCHS, RATE = 8, 0.5
CACHE = 300_000
SAME = xxhash.xxh3_64_intdigest(b"same word again") % BUCKETS


def word_buckets(word: bytes) -> list[int]:
    marked = b"<" + word + b">"
    grams = [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return [xxhash.xxh3_64_intdigest(g) % BUCKETS for g in (marked, *grams)]


def weights(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of a text and their shares of all its features."""
    words = text.split()
    tally: Counter[int] = Counter()
    for word, times in Counter(words).items():
        for bucket in word_buckets(word):
            tally[bucket] += times
    same = sum(map(bytes.__eq__, words, words[1:]))
    if same:
        tally[SAME] += same * 8
    ids = np.fromiter(tally.keys(), np.uint32, len(tally))
    share = np.fromiter(tally.values(), np.float32, len(tally))
    return ids, share / max(float(share.sum()), 1.0)


class Model:
    """One margin for each bucket and a bias."""

    def __init__(self, margins: np.ndarray, bias: float):
        self.margins, self.bias = margins.astype(np.float32), float(bias)

    def scorer(self):
        """A function from a text's bytes to its score; it remembers words, up to a bound."""
        known: dict[bytes, complex] = {}
        margins, same_margin = self.margins, float(self.margins[SAME]) * 8

        def value(word: bytes) -> complex:
            got = known.get(word)
            if got is None:
                if len(known) > CACHE:
                    known.clear()
                ids = word_buckets(word)
                got = known[word] = complex(float(margins[ids].sum()), len(ids))
            return got

        def score(text: bytes) -> float:
            words = text.split()
            total = sum(map(value, words), 0j)
            same = sum(map(bytes.__eq__, words, words[1:]))
            features = total.imag + 8 * same
            z = self.bias + ((total.real + same * same_margin) / features if features else 0.0)
            return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))

        return score


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 5) -> Model:
    """Stochastic gradient descent on vectors, softmax layer and bias, with a rate falling to zero."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS), 0.0)
    chance = np.random.default_rng(seed)
    vectors = chance.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    steps, step = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in chance.permutation(len(rows)):
            ids, share = rows[i]
            rate = RATE * (1 - step / steps)
            step += 1
            own = vectors[ids]
            mean = share @ own
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * p
            vectors[ids] = own - (rate * len(ids) ** 0.5) * np.outer(share, back)
    turn = layer[:, 1] - layer[:, 0]
    return Model(vectors @ turn, float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Train on up to ``per_class`` rows of either label, chosen by a hash of doc_id, none of them held out."""
    marked = labels.select("doc_id", "quality").filter(
        F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = marked.filter("quality = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).union(
        marked.filter("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class))
    # twice per_class rows at most; a doc_id that many rows carry cannot bring more of them
    picked = docs.select("doc_id", text_of().cast("binary").alias("_text")).join(F.broadcast(chosen), "doc_id").orderBy(
        F.xxhash64("doc_id"), "doc_id", F.xxhash64("_text"), "quality").limit(2 * per_class)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            ids, labels = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows += [(i, q, pickle.dumps(weights(t.as_py()))) for i, q, t in zip(ids, labels, batch.column(1))]
        rows.sort()
        model = train([pickle.loads(f) for *_, f in rows], np.array([q for _, q, _ in rows], np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.margins.tobytes()], pa.binary()), pa.array([model.bias])], ["margins", "bias"])

    # the limit leaves one partition; only the finished model comes to the driver
    made = picked.select("doc_id", "_text", F.col("quality").cast("int")).coalesce(1).mapInArrow(
        learn, "margins binary, bias double").collect()
    return Model(np.frombuffer(made[0]["margins"], np.float32), made[0]["bias"]) if made else train([], np.empty(0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score``, the probability of label 1, from the text alone."""

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = model.scorer()
        for batch in texts:
            yield pd.Series([run(bytes(t)) for t in batch], dtype=float)

    return plain(docs, "score").withColumn("score", of(text_of().cast("binary")))
