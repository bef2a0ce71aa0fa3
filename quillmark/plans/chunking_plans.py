"""Queries B10-B27."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from quillmark import vocab as V
from quillmark.functions import expr as X
from quillmark.operators import chunking as C
from quillmark.operators import documents as D
from quillmark.plans.common import r6
from quillmark.plans.registry import query
from quillmark.plans.views import DIM, ORACLE_VIEWS, words

_BLANK = r"[ \n\t\r\x0b\x0c]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def count_words(x: str) -> str:
    return f"len(regexp_split_to_array({strip(x)}, '\\s+'))"


def maths(x: str) -> str:
    return (f"(regexp_matches({x}, '[{V.MATH_SYMBOLS}]') OR "
            f"length(regexp_replace({x}, '[^\\p{{L}}\\s]', '', 'g')) / "
            f"greatest(length({x}), 1) < 0.75)")


ORACLE_VIEWS["doc_lines"] = f"""
SELECT paper_id, page_no, line, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY page_no, pos)
  - 1 AS INTEGER) AS line_idx
FROM (SELECT paper_id, page_no, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT paper_id, page_no, string_split(text, chr(10)) AS ls FROM doc_pages
        WHERE {strip('text')} <> '') a) b"""
_TITLED = (f"(regexp_matches(s, '^\\p{{Lu}}') AND {count_words('line')} <= 14 AND "
           f"NOT regexp_matches(s, '[.,;]$') AND NOT {maths('s')})")
ORACLE_VIEWS["joined_lines"] = f"""
SELECT paper_id, page_no, line_idx,
  CASE WHEN num <> '' AND next_titled THEN num || ' ' || next_s ELSE line END AS line
FROM (SELECT *, coalesce(lead(titled) OVER w, false) AS next_titled, lead(s) OVER w AS next_s,
    titled AND coalesce(lag(num) OVER w, '') <> '' AS taken
  FROM (SELECT *, {_TITLED} AS titled, regexp_extract(line, '{V.HEADING_NUMBER_ONLY}', 1) AS num
        FROM (SELECT *, {strip('line')} AS s FROM doc_lines) a) b
  WINDOW w AS (PARTITION BY paper_id ORDER BY line_idx)) c WHERE NOT taken"""


def _by(pattern: str) -> tuple[str, str, str]:
    path, title = f"regexp_extract(s, '{pattern}', 1)", strip(f"regexp_extract(s, '{pattern}', 2)")
    good = (f"({path} <> '' AND regexp_matches({title}, '^\\p{{Lu}}') AND NOT ends_with({title}, "
            f"'.') AND NOT {maths(title)})")
    return path, title, good


_NP, _NT, _NG = _by(V.HEADING_NUMBERED)
_RP, _RT, _RG = _by(V.HEADING_ROMAN)
_BARE = words(V.BARE_HEADINGS)
_STYLED = "paper_id % 2 = 0 AND lower(s) IN ('abstract', '3 x = y + 2', 'references')"
ORACLE_VIEWS["headed_lines"] = f"""
SELECT paper_id, page_no, line_idx, line, CASE kind WHEN 1 THEN np WHEN 2 THEN rp WHEN 3 THEN ''
  END AS path, CASE kind WHEN 1 THEN nt WHEN 2 THEN rt WHEN 3 THEN s END AS title
FROM (SELECT *, {_NP} AS np, {_NT} AS nt, {_RP} AS rp, {_RT} AS rt,
    CASE WHEN plausible AND {_NG} THEN 1 WHEN plausible AND {_RG} THEN 2
      WHEN plausible AND regexp_matches(s, '^[A-Z]') AND lower(s) IN ({_BARE}) THEN 3
      WHEN {_STYLED} THEN CASE WHEN {_NP} <> '' THEN 1 WHEN {_RP} <> '' THEN 2
        WHEN lower(s) IN ({_BARE}) THEN 3 END END AS kind
  FROM (SELECT *, s <> '' AND {count_words('line')} <= 14 AND NOT (regexp_matches(s, '[.,;:]$')
        AND NOT regexp_matches(s, '^\\d')) AS plausible
        FROM (SELECT *, {strip('line')} AS s FROM joined_lines) a) b) c"""
_ROLE = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(title), '{p}') THEN '{r}'" for p, r in V.ROLE_PATTERNS
) + " ELSE 'unknown' END"
ORACLE_VIEWS["doc_sections"] = f"""
SELECT paper_id, ordinal, title AS heading, CASE WHEN path <> '' THEN path ELSE
  'sec-' || CAST(ordinal AS VARCHAR) END AS section_path,
  CASE WHEN title IS NULL THEN 'unknown' ELSE {_ROLE} END AS section_role,
  page_start, page_end, text
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY island) - 1 AS INTEGER)
    AS ordinal
  FROM (SELECT paper_id, island, {strip("string_agg(line, chr(10) ORDER BY line_idx)")} AS text,
      arg_min(title, line_idx) FILTER (WHERE path IS NOT NULL) AS title,
      arg_min(path, line_idx) FILTER (WHERE path IS NOT NULL) AS path,
      min(page_no) AS page_start, max(page_no) AS page_end
    FROM (SELECT *, sum(CASE WHEN path IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY paper_id
        ORDER BY line_idx ROWS UNBOUNDED PRECEDING) AS island FROM headed_lines) a
    GROUP BY paper_id, island) b WHERE text <> '') c"""


def styled_pages(v):
    """Document pages; every second paper also has heading lines found by typography."""
    heads = F.when(F.col("paper_id") % 2 == 0, F.array(
        F.lit("Abstract"), F.lit("3 x = y + 2"), F.lit("References"))).otherwise(
        F.array().cast("array<string>"))
    return v.doc_pages.withColumn("headings", heads)


def doc_sections(v):
    return C.sections(styled_pages(v))


@query("b10_page_lines", "SELECT paper_id, page_no, line_idx, line FROM doc_lines")
def b10(v):
    return C.explode_lines(v.doc_pages)


@query("b11_rejoin_numbers", "SELECT paper_id, page_no, line_idx, line FROM joined_lines")
def b11(v):
    return C.rejoin_numbers(C.explode_lines(v.doc_pages))


@query("b12_heading_matcher", f"""
SELECT paper_id, line_idx, CASE WHEN g1 THEN np WHEN g2 THEN rp ELSE '' END AS path,
  CASE WHEN g1 THEN nt WHEN g2 THEN rt ELSE s END AS title
FROM (SELECT *, {_NP} AS np, {_NT} AS nt, {_RP} AS rp, {_RT} AS rt, {_NG} AS g1, {_RG} AS g2
  FROM (SELECT *, {strip('line')} AS s FROM joined_lines) a
  WHERE s <> '' AND {count_words('line')} <= 14
    AND NOT (regexp_matches(s, '[.,;:]$') AND NOT regexp_matches(s, '^\\d'))) b
WHERE g1 OR g2 OR (regexp_matches(s, '^[A-Z]') AND lower(s) IN ({_BARE}))""")
def b12(v):
    lines = C.rejoin_numbers(C.explode_lines(v.doc_pages))
    return lines.withColumn("h", C.match_heading(F.col("line"))).filter(
        F.col("h").isNotNull()).select("paper_id", "line_idx", "h.path", "h.title")


@query("b13_mathematics_guard", f"""
SELECT paper_id, line_idx, {maths('line')} AS is_mathematics FROM doc_lines""")
def b13(v):
    return C.explode_lines(v.doc_pages).select(
        "paper_id", "line_idx", C.is_mathematics(F.col("line")).alias("is_mathematics"))


@query("b14_typography_confirms", """
SELECT paper_id, line_idx, path, title FROM headed_lines WHERE path IS NOT NULL""")
def b14(v):
    pages = styled_pages(v)
    lines = C.rejoin_numbers(C.explode_lines(pages))
    return C.mark_headings(lines, pages).filter(F.col("heading").isNotNull()).select(
        "paper_id", "line_idx", "heading.path", "heading.title")


@query("b15_sections", """
SELECT paper_id, ordinal, heading, section_path, page_start, page_end, md5(text) AS digest
FROM doc_sections""")
def b15(v):
    return doc_sections(v).select("paper_id", "ordinal", "heading", "section_path", "page_start",
                                  "page_end", F.md5("text").alias("digest"))


@query("b16_section_roles", f"""
SELECT paper_id, line_idx, CASE WHEN title = '' THEN 'unknown' ELSE {_ROLE} END AS role
FROM (SELECT paper_id, line_idx, line AS title FROM doc_lines) q""")
def b16(v):
    return C.explode_lines(v.doc_pages).select(
        "paper_id", "line_idx", C.role_of(F.col("line")).alias("role"))


@query("b17_paragraphs", f"""
SELECT paper_id, ordinal, CAST(pos - 1 AS INTEGER) AS pos, p AS paragraph FROM (
  SELECT paper_id, ordinal, generate_subscripts(ps, 1) AS pos, unnest(ps) AS p FROM (
    SELECT paper_id, ordinal, list_filter([{strip("replace(x, chr(10), ' ')")} FOR x IN
      regexp_split_to_array(text, '\\n\\s*\\n')], lambda x: x <> '') AS ps FROM doc_sections) a) b""")
def b17(v):
    return doc_sections(v).select(
        "paper_id", "ordinal", F.posexplode(C.paragraphs(F.col("text"))).alias("pos", "paragraph"))


_ABBR = "|".join(a.replace(".", "\\.") for a in V.ABBREVIATIONS)


@query("b18_sentences", f"""
SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, s AS sentence FROM (
  SELECT doc_id, generate_subscripts(ss, 1) AS pos, unnest(ss) AS s FROM (
    SELECT doc_id, list_filter([{strip("replace(x, chr(1), '.')")} FOR x IN string_split(
      regexp_replace(regexp_replace(flat, '(^|[^\\p{{L}}\\p{{N}}_])({_ABBR})\\.', '\\1\\2' || chr(1), 'g'),
        '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2))], lambda x: x <> '') AS ss
    FROM (SELECT doc_id, {strip("replace(text, chr(10), ' ')")} AS flat FROM documents) z) a) b""")
def b18(v):
    return v.documents.select(
        "doc_id", F.posexplode(C.sentences(C.flow(F.col("text")))).alias("pos", "sentence"))


@query("b19_b21_chunk_pieces")
def b20(v):
    """Hard split, greedy packing with overlap, and runt merge over whole sections."""
    return C.pieces(doc_sections(v))


_BARE = "regexp_replace({0}, '[ \\t\\n\\r\\x0b\\x0c]+', '', 'g')"


def bare(text):
    """Text without white space: what no splitting, packing or merging may change."""
    return F.regexp_replace(text, "[ \\t\\n\\r\\x0b\\x0c]+", "")


@query("b20_pieces_cover_sections", f"""
SELECT paper_id, ordinal AS section_ordinal, left({_BARE.format('text')}, 2) AS head,
  right({_BARE.format('text')}, 12) AS tail, true AS covered, true AS sized, true AS ordered
FROM doc_sections""")
def b20_cover(v):
    """Each section's pieces: they begin and end with it, hold all of it, overlap by no more than they may, have
    allowed sizes and gapless numbers."""
    sections = doc_sections(v).withColumn("whole", F.length(bare(F.col("text"))))
    text, size = bare(F.col("content")), F.length("content")
    # only the ends and the length of a text travel; a section's own length comes with its pieces
    ends = C.pieces(sections, ("whole",)).select(
        "paper_id", "section_ordinal", "whole", "piece_no", F.left(text, F.lit(2)).alias("begin"),
        F.right(text, F.lit(12)).alias("end"), F.length(text).alias("long"), size.alias("size"))
    got = ends.groupBy("paper_id", "section_ordinal", "whole").agg(
        F.min_by("begin", "piece_no").alias("head"), F.max_by("end", "piece_no").alias("tail"),
        F.sum("long").alias("held"), F.count("*").alias("n"), F.max("piece_no").alias("last"),
        F.min("size").alias("least"), F.max("size").alias("most"))
    return got.select(
        "paper_id", "section_ordinal", "head", "tail",
        F.col("held").between(F.col("whole"), F.col("whole") + (F.col("n") - 1) * V.CHUNK_OVERLAP).alias("covered"),
        ((F.col("least") > 0) & (F.col("most") <= V.CHUNK_MAX)).alias("sized"),
        (F.col("last") == F.col("n") - 1).alias("ordered"))


@query("b22_chunks_follow_sections", f"""
SELECT paper_id, count(*) AS sections, left({_BARE.format('arg_min(text, ordinal)')}, 8) AS head,
  right({_BARE.format('arg_max(text, ordinal)')}, 12) AS tail,
  count(*) FILTER (section_role = 'references') AS hidden, min(page_start) AS page_start, max(page_end) AS page_end,
  true AS ordered
FROM doc_sections GROUP BY paper_id""")
def b22_follow(v):
    """Each paper's chunks from end to end: their sections in order, what is hidden, pages, gapless ordinals."""
    rows = C.chunk_rows(C.pieces(doc_sections(v), C.SECTION_META))
    text = bare(F.col("content"))
    rows = rows.withColumns({"begin": F.left(text, F.lit(8)), "end": F.right(text, F.lit(12))})
    return rows.groupBy("paper_id").agg(
        F.count_distinct("section_ordinal").alias("sections"), F.min_by("begin", "ordinal").alias("head"),
        F.max_by("end", "ordinal").alias("tail"),
        F.count_distinct(F.when(~F.col("is_indexable"), F.col("section_ordinal"))).alias("hidden"),
        F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"),
        (F.max("ordinal") == F.count("*") - 1).alias("ordered"))


@query("b22_chunks_end_to_end")
def b22(v):
    return C.chunk_rows(C.pieces(doc_sections(v), C.SECTION_META))



@query("b22_chunk_rows", """
SELECT paper_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY section_ordinal, piece_no) - 1
    AS INTEGER) AS ordinal, CAST(section_ordinal AS INTEGER) AS section_ordinal,
  sha256(content) AS content_hash, CAST(least(32767, greatest(1, round_even(length(content) / 4.0, 0)))
    AS INTEGER) AS token_count, CAST(section_ordinal + 1 AS INTEGER) AS page_start,
  CAST(section_ordinal + 2 AS INTEGER) AS page_end, section_ordinal <> 2 AS is_indexable
FROM (SELECT doc_id AS paper_id, (p - 1) % 3 AS section_ordinal, p - 1 AS piece_no,
    left(content, 8000) AS content
  FROM (SELECT doc_id, generate_subscripts(ls, 1) AS p, unnest(ls) AS content FROM
    (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) a) b) c""")
def b22r(v):
    """Chunk rows for given chunk texts: the lines of each document in three sections."""
    rows = v.documents.select(
        F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n"))
        .alias("piece_no", "content")).withColumn("section_ordinal", F.col("piece_no") % 3)
    secs = v.documents.select(
        F.col("doc_id").alias("paper_id"),
        F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ordinal")
    ).withColumns({
        "section_role": F.when(F.col("ordinal") == 2, "references").otherwise("method"),
        "page_start": F.col("ordinal") + 1, "page_end": F.col("ordinal") + 2})
    return C.chunk_rows(rows, secs).drop("content")


@query("b23_token_estimate", """
SELECT doc_id, CAST(least(32767, greatest(1, round_even(length(text) / 4.0, 0))) AS INTEGER) AS tokens
FROM documents""")
def b23(v):
    return v.documents.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


_WORDS = ("list_filter(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_-]+'), "
          "lambda w: regexp_matches(w, '^[A-Za-z][A-Za-z0-9-]{2,}$'))")
_STOP = words(V.STOP_WORDS)
ORACLE_VIEWS["phrase_counts"] = f"""
SELECT paper_id, phrase, CAST(sum(weight) AS BIGINT) AS score FROM (
  SELECT paper_id, weight, unnest(list_concat(
    [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w)) IF ok[i] AND ok[i + 1]],
    [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)
      IF ok[i] AND ok[i + 1] AND ok[i + 2]])) AS phrase
  FROM (SELECT *, [x NOT IN ({_STOP}) FOR x IN w] AS ok FROM (
    SELECT paper_id, CASE section_role WHEN 'abstract' THEN 3 WHEN 'introduction' THEN 2
      WHEN 'method' THEN 3 ELSE 1 END AS weight, [lower(x) FOR x IN {_WORDS}] AS w
    FROM doc_sections WHERE section_role <> 'references') a) b) c GROUP BY paper_id, phrase"""


@query("b24_candidate_counts", "SELECT paper_id, phrase, score FROM phrase_counts")
def b24(v):
    counts = C.candidate_counts(doc_sections(v))
    return counts.select("paper_id", "phrase", F.col("score").cast("bigint").alias("score"))


@query("b24_concept_candidates", """
WITH ranked AS (SELECT paper_id, list(phrase ORDER BY score DESC, phrase) AS ps FROM (
    SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, phrase) AS rn
    FROM phrase_counts) q WHERE rn <= 60 AND score >= 2 GROUP BY paper_id),
taken AS (SELECT paper_id, list_reduce(list_transform(ps, lambda p: [p]), lambda acc, p:
    CASE WHEN len(acc) < 20 AND len(list_filter(acc, lambda a: contains(a, p[1]))) = 0
      THEN list_concat(acc, p) ELSE acc END) AS names FROM ranked)
SELECT paper_id, CAST(generate_subscripts(names, 1) - 1 AS INTEGER) AS candidate_no,
  unnest(names) AS name FROM taken""")
def b24a(v):
    return C.concept_candidates(doc_sections(v))



@query("b25_candidate_hygiene", f"""
WITH raw AS (SELECT doc_id AS paper_id, p - 1 AS position, line, CAST(doc_id % 400 + 1800 AS INTEGER)
    AS year FROM (SELECT doc_id, generate_subscripts(ls, 1) AS p, unnest(ls) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) a) b),
named AS (SELECT *, {strip("regexp_replace(' ' || split_part(line, ' ', 1) || '  ' || split_part(line, ' ', 2) || ' ', '\\s+', ' ', 'g')")} AS name FROM raw),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY position) AS rn
  FROM named WHERE name <> '') q WHERE rn <= 20),
known AS (SELECT paper_id, list(DISTINCT name) AS known FROM kept GROUP BY paper_id),
ali AS (SELECT paper_id, position, string_agg(a, '|' ORDER BY i) AS aliases FROM (
  SELECT *, row_number() OVER (PARTITION BY paper_id, position ORDER BY i) AS keep_no FROM (
    SELECT paper_id, position, left({strip("regexp_replace(x, '\\s+', ' ', 'g')")}, 200) AS a, min(i) AS i
    FROM (SELECT paper_id, position, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM
      (SELECT paper_id, position, string_split(line, ',') AS l FROM kept) z) y
    GROUP BY ALL) w WHERE a <> '') u WHERE keep_no <= 10 GROUP BY paper_id, position)
SELECT k.paper_id, CAST(k.position AS INTEGER) AS position, name, coalesce(aliases, '') AS aliases,
  CASE WHEN year BETWEEN 1900 AND 2100 THEN year END AS year,
  CASE WHEN list_contains(known, 'The model') AND name <> 'The model' THEN 'The model' ELSE '' END
    || CASE WHEN list_contains(known, trim(split_part(line, '.', 1)))
        AND trim(split_part(line, '.', 1)) <> name THEN 'self' ELSE '' END AS prerequisites
FROM kept k JOIN known USING (paper_id) LEFT JOIN ali USING (paper_id, position)""")
def b25(v):
    raw = v.documents.select(
        F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n"))
        .alias("position", "line"), (F.col("doc_id") % 400 + 1800).cast("int").alias("year"))
    first = F.trim(F.split_part("line", F.lit("."), F.lit(1)))
    raw = raw.withColumns({
        "name": F.concat(F.lit(" "), F.split_part("line", F.lit(" "), F.lit(1)), F.lit("  "),
                         F.split_part("line", F.lit(" "), F.lit(2)), F.lit(" ")),
        "aliases": F.split("line", ","),
        "prerequisites": F.array(F.lit("The model"), first)})
    out = C.clean_candidates(raw)
    shown = F.array_join(F.transform(
        "prerequisites", lambda p: F.when(p == "The model", p).otherwise("self")), "")
    return out.select("paper_id", "position", "name", joined_bar("aliases"), "year",
                      shown.alias("prerequisites"))


def joined_bar(c):
    return F.array_join(c, "|").alias(c)


@query("b26_analysis_body", """
SELECT paper_id, md5(body) AS digest, CAST(length(body) AS INTEGER) AS n FROM (
  SELECT paper_id, left(string_agg('## ' || section_role || chr(10) || left(text, 4000),
    chr(10) || chr(10) ORDER BY ordinal), 60000) AS body
  FROM doc_sections WHERE section_role <> 'references' GROUP BY paper_id) q""")
def b26(v):
    return C.analysis_body(doc_sections(v)).select(
        "paper_id", F.md5("body").alias("digest"), F.length("body").alias("n"))


def hashed(ident: str, text: str, source: str) -> str:
    """DuckDB twin of the hashing-trick vectors, as (ident, vector)."""
    return f"""
SELECT {ident}, CASE WHEN norm IS NULL OR norm = 0 THEN
    [CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0 END FOR i IN range({DIM})]
  ELSE [coalesce(list_extract(map_extract(m, i), 1), 0)::DOUBLE / norm FOR i IN range({DIM})] END
  AS vector
FROM (SELECT DISTINCT {ident} FROM {source}) ids LEFT JOIN (
  SELECT {ident}, map(list(slot), list(vote)) AS m, sqrt(sum(vote * vote)) AS norm FROM (
    SELECT {ident}, slot, CAST(sum(vote) AS BIGINT) AS vote FROM (
      SELECT {ident}, CAST(('0x' || left(md5(t), 8)) AS BIGINT) % {DIM} AS slot,
        CASE WHEN strpos('13579bdf', substr(md5(t), 9, 1)) > 0 THEN 1 ELSE -1 END AS vote
      FROM (SELECT {ident}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS t
            FROM {source}) a) b GROUP BY {ident}, slot) c WHERE vote <> 0 GROUP BY {ident}) d
USING ({ident})"""


@query("b27_hash_vectors", f"""
SELECT doc_id, CAST(pos - 1 AS INTEGER) AS slot, round(value, 6) AS value FROM (
  SELECT doc_id, generate_subscripts(vector, 1) AS pos, unnest(vector) AS value
  FROM ({hashed('doc_id', 'text', 'documents')}) q) z WHERE value <> 0""")
def b27(v):
    out = C.hash_vectors(v.documents, "doc_id", "text", DIM)
    return out.select("doc_id", F.posexplode("vector").alias("slot", "value")).filter(
        F.col("value") != 0).select("doc_id", "slot", r6("value"))


def _digest_embedder(texts: list[str]) -> list[list[float]]:
    """Stands in for a remote model: eight numbers from each text's digest."""
    return [[b / 255.0 for b in hashlib.md5(t.encode()).digest()[:8]] for t in texts]


@query("b27_external_vectors", """
SELECT doc_id, CAST(i AS INTEGER) AS slot,
  round(CAST(('0x' || substr(md5(text), CAST(2 * i + 1 AS INTEGER), 2)) AS BIGINT) / 255.0::DOUBLE, 6) AS value
FROM documents, range(8) r(i)""")
def b27b(v):
    out = C.external_vectors(v.documents, "doc_id", "text", _digest_embedder)
    return out.select("doc_id", F.posexplode("vector").alias("slot", "value")).select(
        "doc_id", "slot", r6("value"))


@query("b_document_to_chunks")
def document_to_chunks(v):
    """Text runs to stored chunks in one plan."""
    pages = D.pages(v.spans)
    return C.chunk_rows(C.pieces(C.sections(pages), C.SECTION_META))
