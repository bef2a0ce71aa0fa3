"""Text runs to clean page text (section B, first half)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark import vocab as V

PAGE = ["paper_id", "page_no"]
INJECTION = "(?i)" + "|".join(V.INJECTION_PATTERNS)


def hidden_reason() -> Column:
    """Why a reader would not see this run, or null. First rule wins.

    The colour rule takes the smallest distance over the three channels, so a
    saturated bright channel (pure red, say) counts as white. Kept on purpose.
    """
    red = F.shiftright("color", 16).bitwiseAND(255)
    green = F.shiftright("color", 8).bitwiseAND(255)
    blue = F.col("color").bitwiseAND(255)
    nearest = F.least(255 - red, 255 - green, 255 - blue)
    empty = (F.col("sx1") <= F.col("sx0")) | (F.col("sy1") <= F.col("sy0"))
    outside = (
        (F.col("sx1") <= 0) | (F.col("sx0") >= F.col("page_width"))
        | (F.col("sy1") <= 0) | (F.col("sy0") >= F.col("page_height"))
    )
    return (
        F.when(F.col("size") < V.MIN_FONT, "tiny_font")
        .when(F.col("render_mode") == V.HIDDEN_RENDER_MODE, "render_mode_3")
        .when(nearest < V.WHITE_DISTANCE, "white_on_white")
        .when(empty | outside, "off_page")
    )


def classify(spans: DataFrame) -> DataFrame:
    return spans.withColumn("hidden_reason", hidden_reason())


def text_spans(spans: DataFrame) -> DataFrame:
    return spans.filter(F.col("block_type") == 0)


def findings(spans: DataFrame) -> DataFrame:
    """Hidden runs per paper by reason, and hidden texts that read as injections."""
    hidden = classify(text_spans(spans)).filter(F.col("hidden_reason").isNotNull())
    trimmed = F.trim("text")
    hit = F.when(trimmed.rlike(INJECTION), F.substring(trimmed, 1, 200))
    kinds = ("tiny_font", "render_mode_3", "white_on_white", "off_page")
    return hidden.groupBy("paper_id").agg(
        F.count("*").alias("invisible_spans"),
        *[F.count_if(F.col("hidden_reason") == k).alias(k) for k in kinds],
        F.array_sort(F.collect_list(hit)).alias("injection_hits"),
    )


def _blocks(spans: DataFrame) -> DataFrame:
    return text_spans(spans).groupBy(*PAGE, "block_id").agg(
        F.first("page_width").alias("page_width"), F.first("bx0").alias("bx0"),
        F.first("bx1").alias("bx1"), F.first("by0").alias("by0"))


def page_columns(spans: DataFrame) -> DataFrame:
    """One or two text columns per page, from where its blocks start."""
    mid = F.col("page_width") / 2
    wide = F.col("bx1") - F.col("bx0") > 20
    counted = _blocks(spans).groupBy(*PAGE).agg(
        F.count_if(wide).alias("n_wide"),
        F.count_if(wide & (F.col("bx0") < mid)).alias("n_left"),
        F.count_if(wide & (F.col("bx0") >= mid)).alias("n_right"),
        F.count_if((F.col("bx0") < mid - 20) & (F.col("bx1") > mid + 20)).alias("n_across"),
    )
    two = (
        (F.col("n_wide") >= 6) & (F.col("n_left") >= 3) & (F.col("n_right") >= 3)
        & (F.col("n_across") <= F.col("n_wide") / 3)
    )
    return counted.withColumn("columns", F.when(two, 2).otherwise(1))


def reading_order(spans: DataFrame) -> DataFrame:
    """Block position within its page; the left column (and straddlers) first."""
    blocks = _blocks(spans).join(page_columns(spans).select(*PAGE, "columns"), PAGE)
    mid = F.col("page_width") / 2
    side = F.when((F.col("columns") == 2) & (F.col("bx0") >= mid), 1).otherwise(0)
    w = Window.partitionBy(*PAGE).orderBy(side, F.bround("by0", 1), "bx0", "block_id")
    return blocks.withColumn("block_order", F.row_number().over(w)).select(
        *PAGE, "block_id", "columns", "block_order")


def lines(spans: DataFrame) -> DataFrame:
    """Visible text lines in reading order with size and heading flag.

    A page is bounded by what fits on paper, so ordering inside it is local.
    """
    seen = classify(text_spans(spans)).filter(
        F.col("hidden_reason").isNull() & (F.trim("text") != ""))
    pieces = F.array_sort(F.collect_list(F.struct("span_no", "text")))
    built = seen.groupBy(*PAGE, "block_id", "line_no").agg(
        F.trim(F.array_join(F.transform(pieces, lambda p: p["text"]), "")).alias("content"),
        F.max("size").alias("line_size"),
        F.max(F.col("flags").bitwiseAND(16) != 0).alias("bold"),
    )
    w = Window.partitionBy(*PAGE)
    sizes = F.array_sort(F.collect_list("line_size").over(w))
    body = F.element_at(sizes, (F.floor(F.size(sizes) / 2) + 1).cast("int"))
    placed = built.join(reading_order(spans), [*PAGE, "block_id"]).withColumn("body_size", body)
    large = (F.col("line_size") > F.col("body_size") + 0.6) | (
        F.col("bold") & (F.col("line_size") >= F.col("body_size")))
    order = Window.partitionBy(*PAGE).orderBy("block_order", "line_no")
    return placed.withColumn("line_order", F.row_number().over(order)).withColumn(
        "is_heading",
        large & ~F.endswith("content", F.lit("."))
        & (F.size(F.split(F.trim("content"), r"\s+")) <= 12))


def normalise(text: Column) -> Column:
    """Tidy page text, keeping line structure and blank lines."""
    t = F.regexp_replace(text, "\r\n", "\n")
    t = F.regexp_replace(t, "\r", "\n")
    t = F.regexp_replace(t, r"(?U)(\w)-\n(\w)", "$1$2")
    t = F.regexp_replace(t, "[ \t ]+", " ")
    t = F.regexp_replace(t, " *\n *", "\n")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return F.btrim(t, F.lit(" \n\t\r\x0b\x0c"))


def pages(spans: DataFrame) -> DataFrame:
    """Page text and its heading lines. Pages with no visible text are kept empty."""
    rows = lines(spans)
    ordered = F.array_sort(F.collect_list(F.struct("line_order", "content", "is_heading")))
    built = rows.groupBy(*PAGE).agg(ordered.alias("ls")).select(
        *PAGE,
        normalise(F.array_join(F.transform("ls", lambda x: x["content"]), "\n")).alias("text"),
        F.transform(F.filter("ls", lambda x: x["is_heading"]), lambda x: x["content"])
        .alias("headings"))
    every = spans.select(*PAGE).distinct()
    none = F.array().cast("array<string>")
    return every.join(built, PAGE, "left").select(
        *PAGE, F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("headings", none).alias("headings"))


def readable(text: Column) -> Column:
    return F.length(F.btrim(text, F.lit(" \n\t\r\x0b\x0c"))) >= V.READABLE_CHARS


def readability(page_rows: DataFrame) -> DataFrame:
    """Share of readable pages, the unreadable ones, and whether it is a scan."""
    ok = readable(F.col("text"))
    out = page_rows.groupBy("paper_id").agg(
        F.count("*").alias("page_count"),
        F.avg(ok.cast("double")).alias("ratio"),
        F.array_sort(F.collect_list(F.when(~ok, F.col("page_no")))).alias("unreadable_pages"))
    return out.select(
        "paper_id", "page_count", F.bround("ratio", 4).alias("extractable_text_ratio"),
        "unreadable_pages",
        F.when(F.col("ratio") < V.MIN_READABLE_RATIO, "pdf_not_extractable").alias("error_code"))


def title_guess(page_rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """A prose-like metadata title, else a page-one heading, else the first line."""
    first = page_rows.filter(F.col("page_no") == 1).select("paper_id", "text", "headings")
    fits = lambda c: F.length(c).between(10, 300)
    meta = F.trim("meta_title")
    line = F.trim(F.split_part("text", F.lit("\n"), F.lit(1)))
    heading = F.try_element_at(F.filter("headings", fits), F.lit(1))
    return metadata.join(first, "paper_id", "left").select(
        "paper_id",
        F.coalesce(
            F.when(fits(meta) & meta.contains(" "), meta), heading, F.when(fits(line), line)
        ).alias("title"))


def terminal_status(stages: DataFrame) -> DataFrame:
    """Status after the run: permanent errors fail, missing pages are partial.

    A stage that failed transiently leaves the paper in processing.
    """
    code = F.when(F.col("error_code").isin(*V.PERMANENT_ERRORS), F.col("error_code")).when(
        F.col("error_code").isNull() & (F.coalesce("n_sections", F.lit(0)) == 0), "no_sections"
    ).when(F.col("error_code").isNull() & (F.coalesce("n_chunks", F.lit(0)) == 0), "no_chunks")
    status = (
        F.when(code.isNotNull(), "failed")
        .when(F.col("error_code").isNotNull(), "processing")
        .when(F.size("unreadable_pages") > 0, "partially_ready")
        .otherwise("ready")
    )
    return stages.select(
        "paper_id", status.alias("processing_status"),
        F.when(status == "processing", F.col("phase")).alias("processing_phase"),
        code.alias("error_code"))
