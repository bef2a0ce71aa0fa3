"""Find benchmark items in documents with SimHash windows, then exact shingle similarity.

Shingles are five words, lower-cased. A window is as many shingles of a document as an item has. Windows are laid
where a shingle of a benchmark item of that size occurs: a window without one has similarity 0, and moving a
window's start forward to its first such shingle loses none. Each window and item has a 64-bit SimHash of its
shingles. Fingerprints are cut into radius + 1 blocks, so that any two within the radius agree in a block; windows
and items of one size that do are candidates, those within the radius are verified by the weighted similarity
sum(min) / sum(max) of their shingle counts.

Cases: null texts have no shingles; items and documents under five words match nothing; a document shorter than an
item is one window; repeated rows give one result; null ids are kept as they are; empty tables give an empty
result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.shared import materialise
from quillmark.llm.common import hinted, text_of

SHINGLE, SIMILAR, RADIUS = 5, 0.8, 23
SMALL = 2_000_000  # rows of benchmark shingles up to which they are sent to every task
_LANES, _MASK = 16, 0x0001000100010001
WINDOW = ["doc_id", "_key", "start", "m"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def shingle(words: Column, at: Column) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(SHINGLE)])


def grams(words: Column) -> Column:
    """All shingle hashes of a short word list."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: shingle(words, i))


def fingerprints(hashes: DataFrame, *keys: str) -> DataFrame:
    """64-bit SimHash of ``h`` by key: four counters share a sum, so a key may have up to 65 535 hashes."""
    lanes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(_MASK))).alias(f"_s{j}") for j in range(_LANES)]
    counted = hashes.groupBy(*keys).agg(F.count("*").alias("_n"), *lanes)
    bits = F.lit(0).cast("long")
    for j in range(_LANES):
        for lane in range(4):
            count = F.shiftrightunsigned(f"_s{j}", 16 * lane).bitwiseAND(F.lit(0xFFFF))
            bit = F.shiftleft(F.lit(1).cast("long"), 16 * lane + j)
            bits = bits.bitwiseOR(F.when(2 * count > F.col("_n"), bit).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, bits.alias("print"))


def blocks(prints: DataFrame, radius: int) -> DataFrame:
    """One row for each of the radius + 1 blocks of a fingerprint."""
    edge = [64 * b // (radius + 1) for b in range(radius + 2)]
    parts = [
        F.struct(F.lit(b).alias("block"), F.shiftrightunsigned("print", edge[b]).bitwiseAND(
            F.lit((1 << (edge[b + 1] - edge[b])) - 1)).alias("bits"))
        for b in range(radius + 1)]
    return prints.select("*", F.explode(F.array(*parts)).alias("_b")).select("*", "_b.*").drop("_b")


def items_of(benchmark: DataFrame) -> DataFrame:
    listed = benchmark.select("item_id", words_of(text_of()).alias("_w")).filter(F.size("_w") >= SHINGLE)
    return listed.select("item_id", (F.size("_w") - SHINGLE + 1).alias("m"), F.explode(grams(F.col("_w"))).alias("h"))


def windows(docs: DataFrame, item_grams: DataFrame) -> DataFrame:
    """The item-sized windows of documents that start at a benchmark shingle, with their shingle hashes."""
    anchors = item_grams.groupBy("h").agg(F.collect_set("m").alias("_sizes"))  # at most the distinct item sizes
    listed = docs.select("doc_id", F.xxhash64(text_of()).alias("_key"), words_of(text_of()).alias("_w"))
    spots = (
        listed.filter(F.size("_w") >= SHINGLE)
        .select("doc_id", "_key", "_w", F.explode(F.sequence(F.lit(0), F.size("_w") - SHINGLE)).alias("_p"))
        .withColumn("h", shingle(F.col("_w"), F.col("_p")))
    )
    n = F.size("_w") - SHINGLE + 1
    laid = (
        spots.join(hinted(anchors, SMALL), "h")
        .select("doc_id", "_key", "_w", "_p", F.explode("_sizes").alias("m"))
        .withColumn("start", F.greatest(F.lit(0), F.least(F.col("_p"), n - F.col("m"))))
        .select("doc_id", "_key", "start", "m",
                F.slice("_w", F.col("start") + 1, F.col("m") + SHINGLE - 1).alias("_piece"))
    )
    return laid.dropDuplicates(WINDOW).select(*WINDOW, grams(F.col("_piece")).alias("_h"))


def leaks(
    docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, radius: int = RADIUS, by: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """One row for each document and item it holds: doc_id, item_id, similarity, start (word) and n_words.

    With ``_key``, a hash of the text, in ``by``, rows of one doc_id (or none) are told apart by their texts."""
    item_grams = materialise(items_of(benchmark), "benchmark-shingles")
    laid = materialise(windows(docs, item_grams), "item-windows")
    shown = laid.select(*WINDOW, F.explode("_h").alias("h"))
    prints = blocks(fingerprints(shown, *WINDOW), radius)
    item_prints = blocks(fingerprints(item_grams, "item_id", "m"), radius).withColumnRenamed("print", "_item")
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("_item"))) <= radius
    pairs = prints.join(hinted(item_prints, SMALL), ["m", "block", "bits"]).filter(near)
    pairs = pairs.select(*WINDOW, "item_id").distinct()
    counts = item_grams.groupBy("item_id", "h").agg(F.count("*").alias("_theirs"))
    sizes = laid.select(*WINDOW, F.size("_h").alias("_n"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in WINDOW]
    ours = (
        pairs.alias("a").join(laid.alias("b"), same)
        .select("a.*", F.explode("b._h").alias("h"))
        .groupBy(*WINDOW, "item_id", "h").agg(F.count("*").alias("_ours")))
    shared = ours.alias("a").join(
        hinted(counts, SMALL).alias("b"),
        F.col("a.item_id").eqNullSafe(F.col("b.item_id")) & (F.col("a.h") == F.col("b.h"))
    ).groupBy(*[F.col(f"a.{c}") for c in WINDOW], F.col("a.item_id")).agg(
        F.sum(F.least("_ours", "_theirs")).alias("_both"))
    scored = shared.alias("a").join(sizes.alias("b"), same).select(
        "a.*", (F.col("_both") / (F.col("_n") + F.col("a.m") - F.col("_both"))).alias("similarity"))
    best = scored.filter(F.col("similarity") >= similar).groupBy(*by, "item_id").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("s"), "m")).alias("b"))
    return best.select(
        *by, "item_id", "b.similarity", (-F.col("b.s")).alias("start"), (F.col("b.m") + SHINGLE - 1).alias("n_words"))


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold an item."""
    held = leaks(docs, benchmark, by=("doc_id", "_key")).select(F.col("doc_id").alias("_id"), "_key").distinct()
    return docs.join(
        materialise(held, "leaked"),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text_of()) == F.col("_key")), "left_anti")
