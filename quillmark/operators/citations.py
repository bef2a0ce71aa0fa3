"""Checking every citation marker against what the turn retrieved (section D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKER = r"\[(\d{1,2})\]"


def markers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MARKER), F.lit(1))


def extract(answers: DataFrame) -> DataFrame:
    return answers.select("turn_id", F.posexplode(markers(F.col("draft"))).alias("pos", "marker"))


def set_sizes(retrievals: DataFrame) -> DataFrame:
    return retrievals.groupBy("turn_id").agg(F.max("rank_no").cast("int").alias("n"))


def resolve(answers: DataFrame, retrievals: DataFrame) -> DataFrame:
    """Distinct markers of each answer with the passage they point at, or none."""
    said = answers.select("turn_id", F.explode(F.array_distinct(markers(F.col("draft"))))
                          .alias("marker"))
    at = retrievals.select("turn_id", F.col("rank_no").cast("int").alias("position"), "chunk_id")
    return said.withColumn("position", F.col("marker").cast("int")).join(
        at, ["turn_id", "position"], "left").select(
        "turn_id", F.concat(F.lit("["), "marker", F.lit("]")).alias("marker"), "chunk_id",
        F.col("chunk_id").isNull().alias("invented"))


def tidy(text: Column) -> Column:
    t = F.regexp_replace(text, r"[ \t]+([.,;:!?])", "$1")
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    t = F.regexp_replace(t, " +\n", "\n")
    return F.btrim(t, F.lit(" \n\t\r\x0b\x0c"))


def strip_invented(text: Column, invented: Column) -> Column:
    """Remove exactly the invented markers, in one pass over the text."""
    pattern = F.concat(F.lit(r"\[(?:"), F.array_join(invented, "|"), F.lit(r")\]"))
    return F.when(F.size(invented) == 0, text).otherwise(
        F.regexp_replace(text, pattern, F.lit("")))


def verify(answers: DataFrame, retrievals: DataFrame) -> DataFrame:
    """Verified text, kept and stripped markers, and grounding per answer.

    The only thing an answer needs from its retrieval set is the set's size, so
    this is one aggregate and one join; the rest happens within the row.
    """
    known = answers.join(set_sizes(retrievals), "turn_id", "left").withColumns({
        "n": F.coalesce("n", F.lit(0)),
        "blank": F.btrim(F.coalesce("draft", F.lit("")), F.lit(" \n\t\r\x0b\x0c")) == ""})
    said = known.withColumn("said", F.array_distinct(markers(F.col("draft"))))

    def outside(m: Column) -> Column:
        return (m.cast("int") < 1) | (m.cast("int") > F.col("n"))

    none = F.array().cast("array<string>")
    split = said.withColumns({
        "bad": F.when(F.col("blank"), none).otherwise(F.filter("said", outside)),
        "good": F.when(F.col("blank"), none).otherwise(F.filter("said", lambda m: ~outside(m)))})
    status = (
        F.when(F.col("blank") | (F.col("n") == 0), "no_evidence")
        .when(F.size("good") > 0, "grounded")
        .when(F.size("bad") > 0, "no_evidence")
        .otherwise("degraded")
    )
    bracket = lambda m: F.concat(F.lit("["), m, F.lit("]"))
    return split.select(
        "turn_id",
        F.when(F.col("blank"), "").otherwise(
            tidy(strip_invented(F.col("draft"), F.col("bad")))).alias("text"),
        F.array_sort(F.transform("good", bracket)).alias("cited_markers"),
        F.array_sort(F.transform("bad", bracket)).alias("stripped_markers"),
        status.alias("grounding_status"))


def flag_retrievals(retrievals: DataFrame, resolved: DataFrame) -> DataFrame:
    """Retrieval rows with their citation; the last marker string wins."""
    used = resolved.filter(~F.col("invented")).groupBy("turn_id", "chunk_id").agg(
        F.max("marker").alias("citation_marker"))
    return retrievals.join(used, ["turn_id", "chunk_id"], "left").withColumn(
        "was_cited", F.col("citation_marker").isNotNull())


def turn_citations(flagged: DataFrame, chunks: DataFrame, sections: DataFrame) -> DataFrame:
    where = sections.select("section_id", "section_path")
    passage = chunks.select("chunk_id", "paper_id", "section_id", "page_start", "page_end")
    return flagged.filter("was_cited").join(passage, "chunk_id").join(where, "section_id").select(
        "turn_id", "rank_no", "citation_marker", "chunk_id", "paper_id", "section_path",
        "page_start", "page_end")


def click_through(requests: DataFrame, flagged: DataFrame, turns: DataFrame, chunks: DataFrame,
                  sections: DataFrame, papers: DataFrame) -> DataFrame:
    """A passage opens only through a cited row of a turn the asker owns."""
    owned = requests.join(turns.select("turn_id", "user_id"), ["turn_id", "user_id"], "left_semi")
    cited = owned.join(flagged.filter("was_cited").select("turn_id", "chunk_id", "citation_marker"),
                       ["turn_id", "chunk_id"])
    return (
        cited.join(chunks.select("chunk_id", "paper_id", "section_id", "content", "page_start"),
                   "chunk_id")
        .join(sections.select("section_id", "section_path"), "section_id")
        .join(papers.select("paper_id", "title"), "paper_id")
    )


def cited_by(flagged: DataFrame) -> DataFrame:
    """Which turns cited a passage: one row per (passage, turn), never a gathered list."""
    return flagged.filter("was_cited").select("chunk_id", "turn_id").distinct()


def citation_counts(flagged: DataFrame) -> DataFrame:
    return flagged.filter("was_cited").groupBy("chunk_id").agg(
        F.count_distinct("turn_id").alias("turns"))
