"""Near copies by an LSH forest of MinHash signatures, confirmed on full shingle sets.

Documents with equal shingle sets are one class. Each class has a signature for every tree of the forest: a label
of hash minima. Within a region of labels that share their first values, sorting by label puts every class next to
those with the longest common prefix, so dense regions are told apart at greater depth than sparse ones. Neighbours
are compared in two passes that join most copies cheaply: each class with the one before it in every tree; among
classes still apart, each with several on either side. Candidates pass a bound on set sizes and the share of equal
minima; links are confirmed on the whole sets and connected components follow. A last pass compares the whole sets of
all classes of a region that are still apart, in blocks, so no class is left out for want of a near place in the order.

Recall is that of the forest: two sets at the threshold share the first values in a tree with a chance of one half.

Cases: null and empty texts have no shingles and stay alone; fewer words than a shingle count as one; rows of one
doc_id are one node; rows with a null doc_id stay alone, kept, with a null component; repeated rows are one class;
an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.shared import materialise
from quillmark.llm.common import hinted, text_of
from quillmark.llm.components import components
from quillmark.llm.segments import gram_hashes, mixed

TREES, DEPTH, SHARED = 32, 10, 3
NEAR, SLACK = 4, 0.1
CHUNK = 150_000
BLOCK, VOLUME = 1000, 1_000_000  # classes and shingles that a block of the last pass is meant to have
SMALL = 1_000_000  # ids up to which they are sent to every task instead of moving the texts


def shingles(data: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles, A to Z in lower case."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < size:
        return mixed(gram_hashes(hashes, len(words)) + np.uint64(len(words)))
    return np.unique(gram_hashes(hashes, size))


class Sketcher:
    """Minima of all trees for many sets at once; a set is cut out of one long array of hashes."""

    def __init__(self, trees: int, depth: int):
        chance = np.random.default_rng(11)
        self.flips = chance.integers(0, 1 << 32, trees * depth, dtype=np.uint32)
        self.factors = chance.integers(0, 1 << 31, trees * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def __call__(self, sets: list[np.ndarray]) -> list[bytes]:
        line = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        first = np.cumsum([0, *map(len, sets[:-1])])
        out = np.empty((len(sets), len(self.flips)), ">u2")
        for k in range(len(self.flips)):
            low = np.minimum.reduceat((line ^ self.flips[k]) * self.factors[k], first)
            out[:, k] = (low * np.uint32(0x9E3779B1)) >> np.uint32(16)
        return [row.tobytes() for row in out]


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, key (of the set) and signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(TREES, DEPTH)

        def rows(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            full = [i for i, s in enumerate(sets) if len(s)]
            signs: list[bytes | None] = [None] * len(sets)
            for i, sign in zip(full, sketch([sets[i] for i in full]) if full else [], strict=True):
                signs[i] = sign
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array(signs, pa.binary())], ["doc_id", "n", "key", "sign"])

        for batch in batches:
            ids, sets, total = [], [], 0
            for doc_id, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(doc_id)
                sets.append(shingles(data, size))
                total += len(sets[-1])
                if total >= CHUNK:
                    yield rows(ids, sets)
                    ids, sets, total = [], [], 0
            if ids:
                yield rows(ids, sets)

    return docs.select(F.col("doc_id").cast("long"), text_of().cast("binary").alias("_t")).mapInArrow(
        run, "doc_id long, n long, key binary, sign binary")


def forest(classes: DataFrame) -> DataFrame:
    """Classes that share a region with another, in every tree, each with the class before it."""
    wide = 2 * DEPTH
    planted = classes.select(
        "cid", "n", F.posexplode(F.array(*[F.substring("sign", t * wide + 1, wide) for t in range(TREES)])).alias("tree", "label"))
    region = Window.partitionBy("tree", F.substring("label", 1, 2 * SHARED)).orderBy("label", "cid")
    return (
        planted.withColumns({
            "before": F.lag("cid").over(region), "n_before": F.lag("n").over(region), "after": F.lead("cid").over(region)})
        .filter("before is not null or after is not null").drop("after"))


def _fit(a: str, b: str, percent: int):
    """Sizes that allow the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct()


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets are similar enough; signatures rule most others out first."""
    least = percent / 100 - SLACK

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((left == right).mean(1) >= least))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    signs = classes.select("cid", "sign")
    left, right = signs.toDF("a", "x"), signs.toDF("b", "y")
    likely = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(hopeful, "a long, b long")
    likely = materialise(likely, "likely-pairs")
    left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
    return likely.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(
        similar, "a long, b long").distinct()


def _edges(parts: DataFrame) -> DataFrame:
    return parts.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _links(
    tree: int, left: np.ndarray, alone: bool, cid: np.ndarray, part: np.ndarray, trees: np.ndarray, starts: list[bytes],
    sets: list[bytes], percent: int,
) -> tuple[list[int], list[int]]:
    """A forest of the links between components, of pairs that have a row at ``left`` and first meet in this tree."""
    size = np.array([len(s) // 8 for s in sets])
    vocab, line = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
    first = np.cumsum(size) - size
    parts = np.frombuffer(b"".join(starts), np.uint16).reshape(len(sets), TREES, SHARED)[:, :tree].astype(np.uint64)
    codes = (parts[..., 0] << np.uint64(32)) | (parts[..., 1] << np.uint64(16)) | parts[..., 2]
    used = (trees[:, None] >> np.arange(tree)) & 1 == 1
    group, mark = np.unique(part, return_inverse=True)[1], np.zeros(len(vocab), bool)
    a, b = [], []
    for x in np.flatnonzero(left):
        fit = 100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x])
        fit &= group != group[x]
        if alone:
            fit[:x] = False
        else:
            fit &= ~left
        y = np.flatnonzero(fit)
        y = y[~((codes[y] == codes[x]) & used[x]).any(1)]
        if not len(y):
            continue
        own = line[first[x] : first[x] + size[x]]
        mark[own] = True
        ends = np.cumsum(size[y])
        places = np.repeat(first[y] - ends + size[y], size[y]) + np.arange(ends[-1])
        both = np.add.reduceat(mark[line[places]], ends - size[y], dtype=np.int64)
        mark[own] = False
        for z in y[100 * both >= percent * (size[x] + size[y] - both)]:
            if group[z] != group[x]:
                group[group == group[z]] = group[x]
                a.append(min(cid[x], cid[z]))
                b.append(max(cid[x], cid[z]))
    return a, b


def rest(own: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join what is still apart in a region: whole sets of all its classes are compared.

    The classes outside a region's largest component meet each other and that component, block by block; a pair that
    shares several regions is compared in the first tree of them. A block gives a forest of its links, so rows stay few."""
    own = own.select("tree", F.substring("label", 1, 2 * SHARED).alias("start"), "cid", "n", "part")
    sized = own.groupBy("tree", "start", "part").agg(F.count("*").alias("c"), F.sum("n").alias("v"))

    def blocks(c: Column, v: Column) -> Column:
        return F.greatest(F.ceil(c / BLOCK), F.ceil(v / VOLUME)).cast("long")

    dealt = sized.groupBy("tree", "start").agg(
        F.sum("c").alias("c"), F.sum("v").alias("v"), F.max(F.struct("c", "part", "v")).alias("most")
    ).filter((F.col("c") > NEAR + 1) & (F.col("c") > F.col("most.c"))).select(
        "tree", "start", F.col("most.part").alias("most"),
        blocks(F.col("c") - F.col("most.c"), F.col("v") - F.col("most.v")).alias("few"),
        blocks(F.col("most.c"), F.col("most.v")).alias("many"))
    salt, loose = F.xxhash64("cid"), F.col("part") != F.col("most")
    block = F.when(loose, F.pmod(salt, F.col("few"))).otherwise(F.col("few") + F.pmod(salt, F.col("many")))
    placed = materialise(
        own.join(dealt, ["tree", "start"]).select("tree", "start", "cid", "part", "few", "many", loose.alias("loose"), block.alias("block")),
        "open-regions")
    others = F.sequence(F.lit(0).cast("long"), F.col("few") - 1 + F.when(F.col("loose"), F.col("many")).otherwise(0))
    met = placed.select("tree", "start", "cid", "block", F.explode(others).alias("_o")).select(
        "tree", "start", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "block", "cid")
    starts = F.concat(*[F.substring("sign", 2 * DEPTH * t + 1, 2 * SHARED) for t in range(TREES)])
    known = placed.groupBy("cid", "part").agg(F.expr("bit_or(shiftleft(1L, tree)) as trees"))
    known = materialise(
        known.join(classes.select("cid", starts.alias("starts")), "cid").join(sets, "cid"), "open-sets")

    def linked(table: pa.Table) -> pa.Table:
        i, tree, block, cid, part, trees = (
            table[c].to_numpy() for c in ("i", "tree", "block", "cid", "part", "trees"))
        a, b = _links(
            tree[0], block == i[0], i[0] == table["j"][0].as_py(), cid, part, trees, table["starts"].to_pylist(), table["set"].to_pylist(), percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met.join(known, "cid").groupBy("tree", "start", "i", "j").applyInArrow(linked, "a long, b long")


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept, for every row."""
    drawn = materialise(sketches(docs, size), "sketches")
    linked = drawn.filter("n > 0 and doc_id is not null")
    classes = materialise(
        linked.groupBy("key").agg(F.min("doc_id").alias("cid"), F.max("n").alias("n"), F.max("sign").alias("sign")),
        "classes")
    dense = materialise(forest(classes), "forest")
    ids = dense.select(F.col("cid").alias("doc_id")).distinct()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(t, size).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["cid", "set"])

    sets = materialise(
        docs.select(F.col("doc_id").cast("long"), text_of().cast("binary").alias("_t")).join(hinted(ids, SMALL), "doc_id")
        .mapInArrow(whole, "cid long, set binary"), "shingle-sets")
    first = _ordered(dense.filter(_fit("n", "n_before", percent)).select(F.col("cid").alias("x"), F.col("before").alias("y")))
    found = materialise(confirmed(first, classes, sets, percent), "first-links")
    parts = components(found)

    own = dense.join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn(
        "part", F.coalesce("component", "cid"))
    region = Window.partitionBy("tree", F.substring("label", 1, 2 * SHARED)).orderBy("label", "cid")
    ahead = F.array(*[F.lead(F.struct("cid", "n", "part"), i).over(region) for i in range(1, NEAR + 1)])
    wider = own.select(F.col("cid").alias("x"), "n", "part", ahead.alias("_ahead")).select(
        "x", F.explode(F.filter("_ahead", lambda o: (o["part"] != F.col("part")) & (
            100 * F.least(o["n"], F.col("n")) >= percent * F.greatest(o["n"], F.col("n"))))).alias("o"))
    second = materialise(
        _ordered(wider.select("x", F.col("o.cid").alias("y"))).join(first, ["a", "b"], "left_anti"), "second-pairs")
    more = materialise(confirmed(second, classes, sets, percent), "second-links")
    joined = components(more.union(_edges(parts)))

    own = dense.join(joined.withColumnRenamed("node", "cid"), "cid", "left").withColumn(
        "part", F.coalesce("component", "cid"))
    last = materialise(rest(own, classes, sets, percent), "last-links")
    joined = components(last.union(_edges(joined)))

    reach = classes.select("key", "cid").join(joined.withColumnRenamed("node", "cid"), "cid", "left").select(
        "key", F.coalesce("component", "cid").alias("component_id"))
    alone = drawn.filter("n = 0 or doc_id is null").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.join(reach, "key").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        (F.col("doc_id") == F.col("component_id")).alias("kept")).union(alone)
