"""Queries B1-B9."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark import vocab as V
from quillmark.operators import documents as D
from quillmark.plans.common import joined
from quillmark.plans.registry import query
from quillmark.plans.views import DUCK_SQL, ORACLE_VIEWS

_INJECTION = "|".join(V.INJECTION_PATTERNS).replace("'", "''")
_STRIP = r"regexp_replace({0}, '^[ \n\t\r\x0b\x0c]+|[ \n\t\r\x0b\x0c]+$', '', 'g')"
_HIDDEN = """CASE WHEN size < 4 THEN 'tiny_font' WHEN render_mode = 3 THEN 'render_mode_3'
  WHEN least(255 - ((color >> 16) & 255), 255 - ((color >> 8) & 255), 255 - (color & 255)) < 24
    THEN 'white_on_white'
  WHEN sx1 <= sx0 OR sy1 <= sy0 OR sx1 <= 0 OR sx0 >= page_width OR sy1 <= 0 OR sy0 >= page_height
    THEN 'off_page' END"""

DUCK_SQL["page_columns"] = """
SELECT paper_id, page_no, CASE WHEN n_wide >= 6 AND n_left >= 3 AND n_right >= 3
  AND n_across <= n_wide / 3 THEN 2 ELSE 1 END AS columns
FROM (SELECT paper_id, page_no,
    count(*) FILTER (WHERE bx1 - bx0 > 20) AS n_wide,
    count(*) FILTER (WHERE bx1 - bx0 > 20 AND bx0 < page_width / 2) AS n_left,
    count(*) FILTER (WHERE bx1 - bx0 > 20 AND bx0 >= page_width / 2) AS n_right,
    count(*) FILTER (WHERE bx0 < page_width / 2 - 20 AND bx1 > page_width / 2 + 20) AS n_across
  FROM (SELECT DISTINCT paper_id, page_no, block_id, page_width, bx0, bx1 FROM spans
        WHERE block_type = 0) b GROUP BY paper_id, page_no) c"""
DUCK_SQL["block_orders"] = """
SELECT paper_id, page_no, block_id, columns, CAST(row_number() OVER (PARTITION BY paper_id, page_no
  ORDER BY CASE WHEN columns = 2 AND bx0 >= page_width / 2 THEN 1 ELSE 0 END,
  round(by0, 1), bx0, block_id) AS INTEGER) AS block_order
FROM (SELECT DISTINCT paper_id, page_no, block_id, page_width, bx0, by0 FROM spans
      WHERE block_type = 0) b JOIN page_columns USING (paper_id, page_no)"""
DUCK_SQL["page_lines"] = f"""
SELECT *, CAST(row_number() OVER (PARTITION BY paper_id, page_no ORDER BY block_order, line_no)
    AS INTEGER) AS line_order,
  (line_size > body_size + 0.6 OR (bold AND line_size >= body_size)) AND NOT ends_with(content, '.')
  AND len(regexp_split_to_array(trim(content), '\\s+')) <= 12 AS is_heading
FROM (SELECT l.*, b.block_order, list_extract(list_sort(list(line_size) OVER
        (PARTITION BY paper_id, page_no)), CAST(count(*) OVER (PARTITION BY paper_id, page_no) // 2
        + 1 AS INTEGER)) AS body_size
  FROM (SELECT paper_id, page_no, block_id, line_no,
      trim(string_agg(text, '' ORDER BY span_no)) AS content, max(size) AS line_size,
      bool_or((flags & 16) <> 0) AS bold
    FROM spans WHERE block_type = 0 AND ({_HIDDEN}) IS NULL AND trim(text) <> ''
    GROUP BY ALL) l JOIN block_orders b USING (paper_id, page_no, block_id)) q"""
_NORMAL = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace({0}, "
           "chr(13) || chr(10), chr(10)), chr(13), chr(10)), "
           "'([\\p{{L}}\\p{{M}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{M}}\\p{{N}}_])', '\\1\\2', 'g'), "
           "'[ \\t\\x{{00a0}}]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{{3,}}', "
           "chr(10) || chr(10), 'g')")
DUCK_SQL["built_pages"] = f"""
SELECT p.paper_id, p.page_no, coalesce({_STRIP.format(_NORMAL.format('b.raw'))}, '') AS text,
  coalesce(headings, []) AS headings
FROM (SELECT DISTINCT paper_id, page_no FROM spans) p LEFT JOIN (
  SELECT paper_id, page_no, string_agg(content, chr(10) ORDER BY line_order) AS raw,
    list(content ORDER BY line_order) FILTER (WHERE is_heading) AS headings
  FROM page_lines GROUP BY paper_id, page_no) b USING (paper_id, page_no)"""
for _name in ("page_columns", "block_orders", "page_lines", "built_pages"):
    ORACLE_VIEWS[_name] = DUCK_SQL[_name]


def _id(c="page_id"):
    return [c, "block_id", "line_no", "span_no"]


@query("b1_hidden_spans", f"""
SELECT page_id, block_id, line_no, span_no, {_HIDDEN} AS hidden_reason FROM spans""")
def b1(v):
    return D.classify(v.spans).select(*_id(), "hidden_reason")


@query("b2_security_findings", f"""
SELECT paper_id, count(*) AS invisible_spans,
  count(*) FILTER (WHERE r = 'tiny_font') AS tiny_font,
  count(*) FILTER (WHERE r = 'render_mode_3') AS render_mode_3,
  count(*) FILTER (WHERE r = 'white_on_white') AS white_on_white,
  count(*) FILTER (WHERE r = 'off_page') AS off_page,
  coalesce(string_agg(left(trim(text), 200), ',' ORDER BY left(trim(text), 200))
    FILTER (WHERE regexp_matches(trim(text), '(?i){_INJECTION}')), '') AS injection_hits
FROM (SELECT *, {_HIDDEN} AS r FROM spans WHERE block_type = 0) q WHERE r IS NOT NULL
GROUP BY paper_id""")
def b2(v):
    return D.findings(v.spans).withColumn("injection_hits", F.array_join("injection_hits", ","))


@query("b3_page_columns", "SELECT * FROM page_columns")
def b3(v):
    return D.page_columns(v.spans).select("paper_id", "page_no", "columns")


@query("b4_reading_order", "SELECT paper_id, page_no, block_id, block_order FROM block_orders")
def b4(v):
    return D.reading_order(v.spans).drop("columns")


@query("b5_line_assembly", """
SELECT paper_id, page_no, line_order, content, line_size, body_size, is_heading FROM page_lines""")
def b5(v):
    return D.lines(v.spans).select("paper_id", "page_no", "line_order", "content", "line_size",
                                   "body_size", "is_heading")


_MESSY = ("concat(chr(9), ' ', replace(replace(replace(text, 'e ', concat('e-', chr(13), chr(10))), "
          "'. ', concat('.  ', chr(9), chr(10), ' ', chr(10), chr(10), chr(10))), 'n', "
          "concat('n', chr(13))), chr(10), ' ')")


@query("b6_normalise_text", f"""
SELECT doc_id, md5({_STRIP.format(_NORMAL.format(_MESSY))}) AS digest,
  CAST(length({_STRIP.format(_NORMAL.format(_MESSY))}) AS INTEGER) AS n FROM documents""")
def b6(v):
    """Whole document texts, made messy the same way on both sides."""
    messy = v.documents.select("doc_id", F.expr(_MESSY).alias("text"))
    clean = D.normalise(F.col("text"))
    return messy.select("doc_id", F.md5(clean).alias("digest"), F.length(clean).alias("n"))


@query("b6_page_text", """
SELECT paper_id, page_no, text, array_to_string(headings, ',') AS headings FROM built_pages""")
def b6p(v):
    return D.pages(v.spans).select("paper_id", "page_no", "text", joined("headings", "headings"))


_DOC_PAGES = """SELECT paper_id, page_no, CASE WHEN (paper_id + page_no) % 4 = 0
  THEN substr(text, 1, paper_id % 60) ELSE text END AS text FROM doc_pages"""


@query("b7_readability", f"""
SELECT paper_id, page_count, round_even(ratio, 4) AS extractable_text_ratio, unreadable_pages,
  CASE WHEN ratio < 0.1 THEN 'pdf_not_extractable' END AS error_code
FROM (SELECT paper_id, count(*) AS page_count, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS ratio,
    coalesce(string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY page_no) FILTER (WHERE NOT ok), '')
      AS unreadable_pages
  FROM (SELECT *, length({_STRIP.format('text')}) >= 40 AS ok FROM ({_DOC_PAGES}) z) y
  GROUP BY paper_id) q""")
def b7(v):
    return D.readability(v.sql(_DOC_PAGES)).withColumn(
        "unreadable_pages", F.array_join("unreadable_pages", ","))


_META = """SELECT doc_id AS paper_id, CASE doc_id % 4 WHEN 0 THEN '  main.tex ' WHEN 1
  THEN ' A study of ' || source || ' ' WHEN 2 THEN 'untitled-document' END AS meta_title
  FROM documents"""
_TITLED = """SELECT paper_id, page_no, text, CASE WHEN paper_id % 3 = 0 THEN
  <<arr 'Short', 'A heading of fair size', 'Another heading line'>> ELSE <<arr 'tiny'>> END
  AS headings FROM doc_pages"""


@query("b8_title_guess", f"""
WITH meta AS ({_META}),
t AS (SELECT m.paper_id, trim(m.meta_title) AS meta, p.text, trim(split_part(p.text, chr(10), 1)) AS l
  FROM meta m LEFT JOIN doc_pages p ON p.paper_id = m.paper_id AND p.page_no = 1)
SELECT paper_id, CASE WHEN length(meta) BETWEEN 10 AND 300 AND contains(meta, ' ') THEN meta
  WHEN paper_id % 3 = 0 THEN 'A heading of fair size'
  WHEN length(l) BETWEEN 10 AND 300 THEN l END AS title FROM t""")
def b8(v):
    from quillmark.plans.views import _SPARK, dialect

    return D.title_guess(v.sql(dialect(_TITLED, _SPARK)), v.sql(_META))


_STAGES = """SELECT doc_id AS paper_id, CASE doc_id % 9 WHEN 0 THEN 'pdf_encrypted' WHEN 1
    THEN 'embed_timeout' END AS error_code, CASE WHEN doc_id % 9 = 2 THEN 0 ELSE 4 END AS n_sections,
  CASE WHEN doc_id % 9 = 3 THEN 0 WHEN doc_id % 9 <> 4 THEN 7 END AS n_chunks,
  doc_id % 9 = 5 AS partial, 'embed' AS phase FROM documents"""


@query("b9_terminal_status", f"""
SELECT paper_id, CASE WHEN doc_code IS NOT NULL THEN 'failed' WHEN error_code IS NOT NULL
    THEN 'processing' WHEN partial THEN 'partially_ready' ELSE 'ready' END AS processing_status,
  CASE WHEN doc_code IS NULL AND error_code IS NOT NULL THEN phase END AS processing_phase,
  doc_code AS error_code
FROM (SELECT *, CASE WHEN error_code = 'pdf_encrypted' THEN error_code WHEN error_code IS NULL
    AND n_sections = 0 THEN 'no_sections' WHEN error_code IS NULL AND coalesce(n_chunks, 0) = 0
    THEN 'no_chunks' END AS doc_code FROM ({_STAGES}) s) q""")
def b9(v):
    stages = v.sql(_STAGES).withColumn(
        "unreadable_pages", F.when(F.col("partial"), F.array(F.lit(2))).otherwise(
            F.array().cast("array<int>")))
    return D.terminal_status(stages)
