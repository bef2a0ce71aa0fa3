"""Scan every version of every file for secrets, each content once.

A version's content address is the SHA-256 of its text. The ledger holds one entry for each scanned blob: the
rules (name and version) that have been applied and where each of them matched. An update looks only at blobs and
rules that the ledger does not pair yet, scans each such blob once however many paths share it, and appends. A
report joins what its own rules found, in their own versions, back to all paths. Running an update again after a
failure only rescans what is missing.

Positions are code points, end exclusive. Splitting a text at a pattern and extracting the same pattern give the
lengths of gaps and matches in turn; their running sums are the positions.

Cases: null texts are empty, and empty texts have no findings; repeated rows of a path appear as often in the
report; an empty table gives an empty report; other input columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions.shared import materialise
from quillmark.llm.common import text_of


class Rule(NamedTuple):
    """``group`` must have at least ``least`` characters; shorter matches are dropped but still use up their text."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = rf"""(?:{NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", 1, ASSIGN, 1, 8),
    Rule("access", 1, "AKIA[A-Z0-9]{12,}", 0, 16),  # the run ends alike wherever it starts, so its length can be asked for here
    Rule("hex", 1, "[0-9a-f]{32,}", 0, 32),
)


LEDGER = (
    "blob string, rules array<string>, found array<struct<tag:string,kind:string,least:int,gaps:array<int>,"
    "sizes:array<int>,values:array<int>>>")


def address(history: DataFrame) -> DataFrame:
    """Add ``blob``, the content address of ``text``."""
    return history.withColumn("blob", F.sha2(text_of(), 256))


def entries(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger. Entries from before findings had tags have null there; where such an entry applied two versions of
    a kind, its findings cannot be told apart, and it counts as not scanned."""
    try:
        known = spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException:
        return None  # nothing scanned yet
    kinds = F.array_distinct(F.transform("rules", lambda t: F.substring_index(t, "@", 1)))
    return known.filter(~F.exists("found", lambda f: f["tag"].isNull()) | (F.size(kinds) == F.size("rules")))


def _lengths(array: Column) -> Column:
    return F.transform(array, lambda x: F.length(x))


def _matches(rule: Rule, text: Column, wanted: Column) -> Column:
    pattern = F.lit(rule.pattern)
    found = F.struct(
        F.lit(rule.tag).alias("tag"), F.lit(rule.kind).alias("kind"), F.lit(rule.least).alias("least"),
        _lengths(F.split(text, rule.pattern, -1)).alias("gaps"),
        _lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("sizes"),
        _lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("values"))
    return F.when(wanted & text.rlike(rule.pattern), found)


def update(history: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan what the ledger lacks and append one entry for each blob that had something left to scan."""
    known = entries(history.sparkSession, ledger)
    texts = address(history).select("blob", text_of().alias("_text"))
    tags = F.array(*[F.lit(r.tag) for r in rules])
    if known is None:
        todo = texts.withColumn("rules", tags)
    else:
        done = known.select("blob", F.explode("rules").alias("rule")).distinct()
        open_ = (
            texts.select("blob").distinct().select("blob", F.explode(tags).alias("rule"))
            .join(done, ["blob", "rule"], "left_anti")
            .groupBy("blob").agg(F.sort_array(F.collect_list("rule")).alias("rules")))  # at most all rules
        todo = texts.join(open_, "blob")
    once = todo.dropDuplicates(["blob"])
    found = F.array_compact(F.array(*[
        _matches(r, F.col("_text"), F.array_contains("rules", r.tag)) for r in rules]))
    once.select("blob", "rules", found.alias("found")).write.mode("append").parquet(ledger)


def findings(known: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each secret of each blob that one of ``rules`` in its own version found: blob, kind, start, stop."""
    applied = F.filter("rules", lambda t: F.substring_index(t, "@", 1) == F.col("f.kind"))
    per_rule = known.select("blob", "rules", F.explode("found").alias("f")).select(
        "blob", "f.*", F.coalesce("f.tag", F.get(applied, 0)).alias("_tag")
    ).filter(F.col("_tag").isin([r.tag for r in rules])).dropDuplicates(["blob", "_tag"])
    spots = per_rule.select(
        "blob", "_tag", "kind", "least", F.posexplode(F.arrays_zip("gaps", "sizes", "values")).alias("at", "m")
    ).filter("m.sizes is not null")
    so_far = Window.partitionBy("blob", "_tag").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return (
        spots.withColumn("stop", F.sum(F.col("m.gaps") + F.col("m.sizes")).over(so_far))
        .filter("m.values >= least")
        .select("blob", "kind", (F.col("stop") - F.col("m.sizes")).alias("start"), "stop"))


def report(history: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``history`` but its text, with blob, a count for each kind and all spans in order."""
    own = [c for c in history.columns if c not in ("text", "blob", "spans", *(f"n_{r.kind}" for r in rules))]
    known = entries(history.sparkSession, ledger)
    rank = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind"))
    spans = F.transform(
        F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "stop"))),
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    counts = [F.count_if(F.col("kind") == r.kind).alias(f"n_{r.kind}") for r in rules]
    paths = address(history).select(*own, "blob")
    if known is None:  # nothing was ever written
        known = history.sparkSession.createDataFrame([], LEDGER)
    by_blob = materialise(  # a text's findings are bounded by its length
        findings(known, rules).groupBy("blob").agg(*counts, F.array_join(spans, ",").alias("spans")), "blob-findings")
    joined = paths.join(by_blob, "blob", "left")
    return joined.select(
        *own, "blob", *[F.coalesce(f"n_{r.kind}", F.lit(0)).alias(f"n_{r.kind}") for r in rules],
        F.coalesce("spans", F.lit("")).alias("spans"))
