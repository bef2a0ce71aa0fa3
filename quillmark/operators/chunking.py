"""Page text to sections, chunks, concept candidates and vectors (section B, second half)."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark import vocab as V
from quillmark.functions import expr as X

PAPER = ["paper_id"]
PHRASES = 50_000  # rows of counted phrases that leave a task at a time
_BLANKS = " \n\t\r\x0b\x0c"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def at_most_words(c: Column, most: int) -> Column:
    """Looks no further than the first word too many."""
    return ~strip(c).rlike(rf"^\S++(?:\s++\S++){{{most}}}")


def is_mathematics(title: Column) -> Column:
    """Equation numbering looks like heading numbering; symbols or few letters give it away."""
    letters = F.length(F.regexp_replace(title, r"[^\p{L}\s]", ""))
    return title.rlike(f"[{V.MATH_SYMBOLS}]") | (
        letters / F.greatest(F.length(title), F.lit(1)) < V.MATH_LETTER_SHARE)


def explode_lines(pages: DataFrame) -> DataFrame:
    """Lines of non-blank pages with a line index over the paper.

    A paper has at most a few hundred pages (the intake gate sees to it), so
    windows per paper are bounded by the document, not by the corpus.
    """
    shown = pages.filter(strip(F.col("text")) != "")
    out = shown.select("paper_id", "page_no", F.posexplode(F.split("text", "\n"))
                       .alias("pos", "line"))
    w = Window.partitionBy("paper_id").orderBy("page_no", "pos")
    return out.withColumn("line_idx", F.row_number().over(w) - 1).drop("pos")


def rejoin_numbers(lines: DataFrame) -> DataFrame:
    """Merge a line holding only a section number with the title on the next line.

    A number line can never be a title (titles start with a capital), so one
    look ahead and one look back are enough.
    """
    w = Window.partitionBy("paper_id").orderBy("line_idx")
    body = strip(F.col("line"))
    titled = (
        body.rlike(r"^\p{Lu}") & at_most_words(F.col("line"), V.HEADING_WORDS)
        & ~body.rlike(r"[.,;]$") & ~is_mathematics(body)
    )
    number = F.regexp_extract("line", V.HEADING_NUMBER_ONLY, 1)
    marked = lines.withColumns({"_number": number, "_titled": F.coalesce(titled, F.lit(False))})
    joins = (F.col("_number") != "") & F.coalesce(F.lead("_titled").over(w), F.lit(False))
    taken = F.col("_titled") & (F.coalesce(F.lag("_number").over(w), F.lit("")) != "")
    merged = F.concat_ws(" ", "_number", strip(F.lead("line").over(w)))
    return (
        marked.withColumns({"_taken": taken, "_text": F.when(joins, merged).otherwise(
            F.col("line"))})
        .filter(~F.col("_taken"))
        .select("paper_id", "page_no", "line_idx", F.col("_text").alias("line"))
    )


def _found(path: Column, title: Column) -> Column:
    return F.struct(path.alias("path"), title.alias("title"))


def match_heading(line: Column) -> Column:
    """(path, title) when the line reads like a heading, else null."""
    s = strip(line)
    plausible = (s != "") & at_most_words(line, V.HEADING_WORDS) & ~(
        s.rlike(r"[.,;:]$") & ~s.rlike(r"^\d"))

    def by(pattern: str) -> Column:
        path, title = F.regexp_extract(s, pattern, 1), strip(F.regexp_extract(s, pattern, 2))
        good = ((path != "") & title.rlike(r"^\p{Lu}") & ~F.endswith(title, F.lit("."))
                & ~is_mathematics(title))
        return F.when(good, _found(path, title))

    bare = F.when(s.rlike("^[A-Z]") & F.lower(s).isin(*V.BARE_HEADINGS), _found(F.lit(""), s))
    return F.when(plausible, F.coalesce(by(V.HEADING_NUMBERED), by(V.HEADING_ROMAN), bare))


def confirm_typography(line: Column, styled: Column) -> Column:
    """A line set like a heading counts only if it also reads like one."""
    s = strip(line)

    def by(pattern: str) -> Column:
        path = F.regexp_extract(s, pattern, 1)
        return F.when(path != "", _found(path, strip(F.regexp_extract(s, pattern, 2))))

    bare = F.when(F.lower(s).isin(*V.BARE_HEADINGS), _found(F.lit(""), s))
    return F.when(styled, F.coalesce(by(V.HEADING_NUMBERED), by(V.HEADING_ROMAN), bare))


def mark_headings(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    if pages is None:
        marked = lines.withColumn("_styled", F.lit(False))
    else:
        # one row a paper, joined by paper alone: lines stay where they have been dealt by paper
        styled = (
            pages.filter(strip(F.col("text")) != "")
            .select("paper_id", F.explode("headings").alias("_key"))
            .withColumn("_key", strip(F.col("_key"))).filter(F.col("_key") != "")
            .groupBy("paper_id").agg(F.collect_set("_key").alias("_keys"))
        )
        marked = lines.join(styled, "paper_id", "left").withColumn(
            "_styled", F.coalesce(F.array_contains("_keys", strip(F.col("line"))), F.lit(False)))
    line = F.col("line")
    return marked.withColumn(
        "heading", F.coalesce(match_heading(line), confirm_typography(line, F.col("_styled")))
    ).select("paper_id", "page_no", "line_idx", "line", "heading")


def role_of(heading: Column) -> Column:
    low = F.lower(heading)
    role = F.lit("unknown")
    for pattern, name in reversed(V.ROLE_PATTERNS):
        role = F.when(low.rlike(pattern), name).otherwise(role)
    return F.when(heading.isNull() | (heading == ""), "unknown").otherwise(role)


def assemble_sections(marked: DataFrame) -> DataFrame:
    """Gaps and islands: every heading line opens a section and stays in its text."""
    w = Window.partitionBy("paper_id").orderBy("line_idx")
    island = F.sum(F.col("heading").isNotNull().cast("int")).over(
        w.rowsBetween(Window.unboundedPreceding, 0))
    pieces = F.array_sort(F.collect_list(F.struct("line_idx", "line")))
    grouped = marked.withColumn("island", island).groupBy("paper_id", "island").agg(
        strip(F.array_join(F.transform(pieces, lambda p: p["line"]), "\n")).alias("text"),
        F.min_by("heading", "line_idx").alias("h"),
        F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"))
    kept = grouped.filter(F.col("text") != "")
    order = Window.partitionBy("paper_id").orderBy("island")
    title = F.when(F.col("h.title") != "", F.col("h.title"))
    return kept.withColumn("ordinal", F.row_number().over(order) - 1).select(
        "paper_id", "ordinal", title.alias("heading"),
        F.when(F.col("h.path") != "", F.col("h.path"))
        .otherwise(F.concat(F.lit("sec-"), F.col("ordinal").cast("string"))).alias("section_path"),
        role_of(F.col("h.title")).alias("section_role"), "page_start", "page_end", "text")


def sections(pages: DataFrame) -> DataFrame:
    lines = rejoin_numbers(explode_lines(pages))
    with_headings = pages if "headings" in pages.columns else None
    return assemble_sections(mark_headings(lines, with_headings))


# --- paragraphs, sentences, packing ---------------------------------------
def flow(text: Column) -> Column:
    """Single line breaks inside a paragraph are layout, not meaning."""
    return strip(F.regexp_replace(text, r"(?<!\n)\n(?!\n)", " "))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), flow), lambda p: p != "")


_GUARD = "\x00"
_ABBREVIATION = r"(?U)\b(" + "|".join(a.replace(".", r"\.") for a in V.ABBREVIATIONS) + r")\."


def sentences(text: Column) -> Column:
    """Cut after a stop, an exclamation or a question mark, but not after one that ends a listed abbreviation."""
    guarded = F.regexp_replace(text, _ABBREVIATION, "$1" + _GUARD)
    for a in V.ABBREVIATIONS:
        if "." in a:
            guarded = F.replace(guarded, F.lit(a + _GUARD), F.lit(a.replace(".", _GUARD) + _GUARD))
    parts = F.split(guarded, r"(?<=[.!?])\s+")
    restored = F.transform(parts, lambda p: strip(F.replace(p, F.lit(_GUARD), F.lit("."))))
    return F.filter(restored, lambda p: p != "")


def _cut_long(text: str, size: int) -> Iterator[str]:
    """Pieces of at most ``size`` between cut positions; white space at a cut belongs to no piece.

    A cut falls on the last space of the next ``size`` characters if that lies in their second half, else at
    their end.
    """
    begin, end = 0, len(text)
    while end - begin > size:
        cut = text.rfind(" ", begin + size // 2, begin + size)
        cut = begin + size if cut < 0 else cut
        if text[begin:cut].strip():
            yield text[begin:cut].strip()
        left = text[cut:end]
        begin, end = end - len(left.lstrip()), cut + len(left.rstrip())
    if begin < end:
        yield text[begin:end]


def _fill(units: list[str], size: int, overlap: int) -> Iterator[str]:
    held = ""
    for unit in units:
        if len(unit) > size:
            if held:
                yield held
            held = ""
            yield from _cut_long(unit, size)
        elif not held:
            held = unit
        elif len(held) + 2 + len(unit) <= size:
            held = held + "\n\n" + unit
        else:
            yield held
            tail = held[-overlap:] if len(held) > overlap else ""
            _, space, after = tail.partition(" ")
            tail = after if space else tail
            held = tail + "\n\n" + unit if tail else unit
    if held:
        yield held


def pack(units: list[str], split_units: list[list[str] | None]) -> list[str]:
    """Chunks of one section: fill, then fold what is too short into its neighbour.

    An oversize paragraph is a run of its own, made of its sentences.
    """
    runs: list[list[str]] = [[]]
    for unit, parts in zip(units, split_units):
        if len(unit) > V.CHUNK_TARGET:
            runs += [list(parts) if parts is not None and len(parts) > 1 else [unit], []]
        else:
            runs[-1].append(unit)
    out: list[str] = []
    for run in runs:
        for piece in _fill(run, V.CHUNK_TARGET, V.CHUNK_OVERLAP):
            short = len(piece) < V.CHUNK_MIN
            if out and short and len(out[-1]) + len(piece) <= V.CHUNK_MAX:
                out[-1] = out[-1] + "\n\n" + piece
            else:
                out.append(piece)
    return [c for c in (p.strip()[: V.CHUNK_MAX] for p in out) if c]


class SectionPieces:
    """Table function ``section_pieces(units, parts)``: a section's paragraphs, and the sentences of those that are
    too long, give rows (piece_no, content)."""

    def eval(self, units: list[str], parts: list[list[str] | None]) -> Iterator[tuple[int, str]]:
        yield from enumerate(pack(units or [], parts or []))


def register(spark: SparkSession) -> None:
    """Make the table function known to SQL. It takes Arrow batches of sections."""
    spark.udtf.register("section_pieces", F.udtf(
        SectionPieces, returnType="piece_no INT, content STRING", useArrow=True))


def pieces(section_rows: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Chunk texts, with the section columns in ``carry``. Splitting is JVM-side; only the sequential fill runs
    in Python, a batch of sections at a time, with no shuffle."""
    long_parts = F.transform(
        "units", lambda u: F.when(F.length(u) > V.CHUNK_TARGET, sentences(u)))
    ready = section_rows.select(
        "paper_id", F.col("ordinal").cast("int").alias("section_ordinal"), *carry, paragraphs(F.col("text"))
        .alias("units")).withColumn("parts", long_parts)
    kept = ["paper_id", "section_ordinal", *carry]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, number, content = [], [], []
            for row, (units, parts) in enumerate(zip(batch.column("units").to_pylist(), batch.column("parts").to_pylist())):
                found = pack(units or [], parts or [])
                of += [row] * len(found)
                number += range(len(found))
                content += found
            at = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in kept), pa.array(number, pa.int32()), pa.array(content, pa.string())],
                [*kept, "piece_no", "content"])

    schema = T.StructType([*(ready.schema[c] for c in kept), T.StructField("piece_no", T.IntegerType()),
                           T.StructField("content", T.StringType())])
    return ready.mapInArrow(fill, schema)


SECTION_META = ("section_role", "page_start", "page_end")


def chunk_rows(piece_rows: DataFrame, section_rows: DataFrame | None = None) -> DataFrame:
    """Stored chunks: contiguous ordinal per paper, hash, tokens, page span, visibility.

    Pieces that carry SECTION_META need no join with their sections.
    """
    rows = piece_rows.withColumn("content", F.substring(F.col("content"), 1, V.CHUNK_MAX))
    if section_rows is not None:
        rows = rows.join(section_rows.select(
            "paper_id", F.col("ordinal").alias("section_ordinal"), *SECTION_META), ["paper_id", "section_ordinal"])
    w = Window.partitionBy("paper_id").orderBy("section_ordinal", "piece_no")
    return rows.select(
        "paper_id", (F.row_number().over(w) - 1).alias("ordinal"), "section_ordinal", "content",
        F.sha2("content", 256).alias("content_hash"),
        X.token_estimate(F.col("content")).alias("token_count"), "page_start", "page_end",
        (F.col("section_role") != "references").alias("is_indexable"))


# --- candidates ------------------------------------------------------------
_WORD = r"(?U)\b([A-Za-z][A-Za-z0-9-]{2,})\b"


_HOLE = "."  # no word holds one


def _phrases(sections: list[dict], most: int | None, least: int) -> list[tuple[str, int]]:
    """Weighted counts of one paper's phrases; with ``most``, the best of them."""
    by_weight: dict[int, Counter] = {}
    for section in sections:
        counts = by_weight.setdefault(section["weight"], Counter())
        for run in section["words"].split(_HOLE):
            a = run.split()
            counts.update(map(" ".join, zip(a, a[1:])))
            counts.update(map(" ".join, zip(a, a[1:], a[2:])))
    total: dict[str, int] = {}
    for weight, counts in by_weight.items():
        for phrase, times in counts.items():
            total[phrase] = total.get(phrase, 0) + weight * times
    if most is None:
        return [(p, n) for p, n in total.items() if n >= least]
    return [(p, -n) for n, p in sorted((-n, p) for p, n in total.items() if n >= least)[:most]]


def candidate_counts(section_rows: DataFrame, most: int | None = None, least: int = 0) -> DataFrame:
    """Weighted counts of two- and three-word phrases per paper; with ``most``, the best of each paper.

    A paper's words come together as they lie, by paper; its phrases are counted paper by paper, so that they are
    neither shuffled nor held for a whole partition.
    """
    words = F.transform(F.regexp_extract_all("text", F.lit(_WORD), F.lit(1)), F.lower)
    papers = section_rows.filter(F.col("section_role") != "references").select(
        "paper_id", X.lookup(F.col("section_role"), V.ROLE_WEIGHT, 1).cast("int").alias("weight"),
        # a stop word leaves a hole, so no phrase runs across it
        F.array_join(F.transform(words, lambda x: F.when(~x.isin(*V.STOP_WORDS), x)), " ", _HOLE).alias("words")
    ).groupBy("paper_id").agg(F.collect_list(F.struct("weight", "words")).alias("sections"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, phrases, scores = [], [], []
            for row in range(batch.num_rows):
                for phrase, score in _phrases(batch.column(1)[row].as_py(), most, least):
                    of.append(row)
                    phrases.append(phrase)
                    scores.append(score)
                if len(of) >= PHRASES or row == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(of, pa.int32())), pa.array(phrases, pa.string()),
                         pa.array(scores, pa.int64())], ["paper_id", "phrase", "score"])
                    of, phrases, scores = [], [], []

    schema = T.StructType([papers.schema["paper_id"], T.StructField("phrase", T.StringType()),
                           T.StructField("score", T.LongType())])
    return papers.mapInArrow(count, schema)


def concept_candidates(section_rows: DataFrame, most: int = V.MAX_CANDIDATES) -> DataFrame:
    """Accepted phrases per paper. Only those that may be accepted leave the counting."""
    return accept_candidates(candidate_counts(section_rows, 3 * most, 2), most)


def accept_candidates(counts: DataFrame, most: int = V.MAX_CANDIDATES) -> DataFrame:
    """The best phrases per paper, leaving out any contained in one already taken."""
    w = Window.partitionBy("paper_id").orderBy(F.desc("score"), "phrase")
    top = counts.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 3 * most).filter(
        F.col("score") >= 2)
    ranked = top.groupBy("paper_id").agg(
        F.array_sort(F.collect_list(F.struct("rn", "phrase"))).alias("ps"))
    none = F.array().cast("array<string>")
    taken = F.aggregate(
        "ps", none,
        lambda acc, p: F.when(
            (F.size(acc) < most) & ~F.exists(acc, lambda a: F.contains(a, p["phrase"])),
            F.concat(acc, F.array(p["phrase"]))).otherwise(acc))
    return ranked.select("paper_id", F.posexplode(taken).alias("candidate_no", "name"))


def tidy_text(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def clean_candidates(raw: DataFrame) -> DataFrame:
    """Bounded, deduplicated candidates whose prerequisites exist in the same paper.

    Input rows: paper_id, position, name, aliases, prerequisites, year.
    """
    aliases = F.slice(F.filter(F.array_distinct(F.transform(
        "aliases", lambda a: F.substring(tidy_text(a), 1, 200))), lambda a: a != ""), 1, 10)
    named = raw.withColumn("name", tidy_text(F.col("name"))).filter(F.col("name") != "")
    w = Window.partitionBy("paper_id").orderBy("position")
    kept = named.withColumn("rn", F.row_number().over(w)).filter(
        F.col("rn") <= V.MAX_CANDIDATES)
    known = kept.groupBy("paper_id").agg(F.collect_set("name").alias("known"))
    prereqs = F.filter(
        F.slice("prerequisites", 1, 10),
        lambda p: F.array_contains("known", p) & (p != F.col("name")))
    return kept.join(known, "paper_id").select(
        "paper_id", "position", "name", aliases.alias("aliases"), prereqs.alias("prerequisites"),
        F.when(F.col("year").between(1900, 2100), F.col("year")).alias("year"))


def analysis_body(section_rows: DataFrame) -> DataFrame:
    """What an analyser reads per paper: role-titled section openings, bounded."""
    piece = F.concat(F.lit("## "), "section_role", F.lit("\n"), F.substring("text", 1, 4000))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", piece.alias("t"))))
    return section_rows.filter(F.col("section_role") != "references").groupBy("paper_id").agg(
        F.substring(F.array_join(F.transform(ordered, lambda s: s["t"]), "\n\n"), 1, 60000)
        .alias("body"))


# --- vectors ---------------------------------------------------------------
def hash_vectors(rows: DataFrame, ident: str, text: str, dim: int) -> DataFrame:
    """Hashing-trick vectors: tokens vote on one of ``dim`` slots with a sign.

    A vector depends on its own row alone, so the votes are cast inside an Arrow batch and nothing is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            table = np.zeros((batch.num_rows, dim))
            for i, data in enumerate(batch.column(1).to_pylist()):
                for token, times in Counter(re.findall(rb"[a-z0-9]+", data or b"")).items():
                    if token not in votes:
                        if len(votes) > 200_000:
                            votes.clear()
                        digest = hashlib.md5(token).hexdigest()
                        votes[token] = int(digest[:8], 16) % dim, 1 if int(digest[8], 16) % 2 else -1
                    slot, sign = votes[token]
                    table[i, slot] += sign * times
            norm = np.sqrt((table * table).sum(1, keepdims=True))
            first = np.eye(1, dim)
            vectors = np.where(norm > 0, table / np.where(norm > 0, norm, 1), first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(vectors), pa.list_(pa.float64()))], [ident, "vector"])

    schema = T.StructType([rows.schema[ident], T.StructField("vector", T.ArrayType(T.DoubleType()))])
    return rows.select(ident, F.lower(F.col(text)).cast("binary").alias("_t")).mapInArrow(run, schema)


def external_vectors(
    rows: DataFrame, ident: str, text: str, embed: Callable[[list[str]], list[list[float]]],
    batch: int = V.EMBED_BATCH,
) -> DataFrame:
    """Call an external embedder in ordered batches; a short answer fails the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start:start + batch]
                got = embed(part[text].tolist())
                if len(got) != len(part):
                    raise ValueError(f"embedder returned {len(got)} vectors for {len(part)} texts")
                yield pd.DataFrame({ident: part[ident].to_numpy(), "vector": list(got)})

    schema = T.StructType([rows.schema[ident],
                           T.StructField("vector", T.ArrayType(T.DoubleType()))])
    return rows.select(ident, text).mapInPandas(run, schema)
