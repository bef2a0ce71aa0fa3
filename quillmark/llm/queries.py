"""The registered opN queries: each operator over its whole table with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.shared import materialise, new_path
from quillmark.llm import (
    classifier, conversation_repair, decontaminate, exact_copies, mixing, near_copies, quality_rules, secret_scan, sharding, suffix, superkmer, tokens,
    whitening)
from quillmark.llm.common import documents, text_of, word_count


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.text_shards(documents(spark, sf_dir).select("doc_id", "text"), 16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialise(
        documents(spark, sf_dir).select("doc_id", "source", word_count(text_of()).alias("size")), "mix-sizes")
    plan = materialise(mixing.rates(sized, mixing.targets(sized)), "mix-plan")
    return mixing.copies(sized, plan).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         sha256(coalesce(doc_id::VARCHAR, 'null') || ':mix') AS h
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rn, source_size * 2.0::DOUBLE AS cap FROM sums),
weighed AS (SELECT *, [3, 1, 2][((rn - 1) % 3 + 1)::INT] AS w FROM ranked),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER (
      ORDER BY cap / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / (sum(w) OVER (ORDER BY cap / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
opened AS (SELECT arg_min(level, cap / w) AS open FROM levels WHERE cap > level * w),
goals AS (
  SELECT source, source_size, CASE WHEN open IS NULL THEN cap ELSE least(cap, open * w) END AS target
  FROM levels, opened),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM goals),
split AS (
  SELECT source, source_size, target, floor(rate)::BIGINT AS base, (rate - floor(rate)) * 4294967296.0 AS part
  FROM parts),
draws AS (
  SELECT s.doc_id, s.size, p.*, k, ('0x' || substr(h, (k * 8 + 1)::BIGINT, 8))::BIGINT AS draw
  FROM sized s JOIN split p ON s.source IS NOT DISTINCT FROM p.source, range(8) t(k)),
tried AS (
  SELECT source, k, abs(any_value(base * source_size)
      + sum(CASE WHEN draw < part THEN size ELSE 0 END) - any_value(target)) AS off
  FROM draws GROUP BY source, k),
chosen AS (SELECT source, k FROM tried QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, k) = 1)
SELECT d.doc_id, d.size, d.source_size, d.target,
       (d.size * (d.base + CASE WHEN d.draw < d.part THEN 1 ELSE 0 END))::BIGINT AS taken
FROM draws d JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source AND d.k = c.k
"""


def op3_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.groups(documents(spark, sf_dir), 4, 80)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = documents(spark, sf_dir).select("doc_id", F.lit(1).alias("version"), "text")
    ledger = new_path(spark, "blob-ledger")
    secret_scan.update(history, ledger)
    return secret_scan.report(history, ledger).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


_OP4_RULE = """
  SELECT doc_id, '{kind}' AS kind, {rank} AS rank, {least} AS least, gaps, sizes, vals FROM (
    SELECT doc_id, list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) AS gaps,
      list_transform(regexp_extract_all(t, '{pattern}', 0), lambda x: length(x)) AS sizes,
      list_transform(regexp_extract_all(t, '{pattern}', {group}), lambda x: length(x)) AS vals
    FROM texts WHERE regexp_matches(t, '{pattern}'))"""
OP4_SQL = (
    "WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), per_rule AS ("
    + " UNION ALL ".join(
        _OP4_RULE.format(kind=r.kind, rank=i, least=r.least, group=r.group, pattern=r.pattern.replace("'", "''"))
        for i, r in enumerate(secret_scan.RULES))
    + """),
spots AS (
  SELECT doc_id, kind, rank, least, i, gaps[i] AS gap, sizes[i] AS size, vals[i] AS val
  FROM (SELECT *, unnest(range(1, len(sizes) + 1)) AS i FROM per_rule)),
placed AS (
  SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, kind ORDER BY i)::BIGINT AS stop FROM spots),
good AS (SELECT * FROM placed WHERE val >= least),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c,
    count(*) FILTER (kind = 'hex') AS h,
    string_agg(kind || ':' || (stop - size) || ':' || stop, ',' ORDER BY stop - size, rank) AS spans
  FROM good GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN listed USING (doc_id)
""")


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "anomaly")


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-codes")
    tokens.write(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.read(spark, path)


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = superkmer.deduplicate(documents(spark, sf_dir).select("doc_id", "text"), 13)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH texts AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ 	-
]+'), lambda x: x <> '') AS w
  FROM documents),
items AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ 	-
]+'), lambda x: x <> '') AS w
  FROM benchmark),
igrams AS (
  SELECT item_id, len(w) - 4 AS m, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM items WHERE len(w) >= 5)),
dgrams AS (
  SELECT doc_id, len(w) - 4 AS n, i - 1 AS p, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM texts WHERE len(w) >= 5)),
hits AS (SELECT DISTINCT d.doc_id, d.n, d.p, d.g, i.item_id, i.m FROM dgrams d JOIN igrams i ON d.g = i.g),
windows AS (SELECT DISTINCT doc_id, item_id, m, least(m, n) AS size, greatest(0, least(p, n - m)) AS start FROM hits),
counts AS (
  SELECT w.doc_id, w.item_id, w.m, w.size, w.start, h.g, count(*) AS ours
  FROM windows w JOIN hits h ON h.doc_id = w.doc_id AND h.item_id = w.item_id
    AND h.p BETWEEN w.start AND w.start + w.size - 1
  GROUP BY ALL),
theirs AS (SELECT item_id, g, count(*) AS theirs FROM igrams GROUP BY ALL),
scored AS (
  SELECT doc_id, item_id, m, start, sum(least(ours, theirs)) AS common, any_value(size) AS size
  FROM counts JOIN theirs USING (item_id, g) GROUP BY doc_id, item_id, m, start),
rated AS (SELECT *, common::DOUBLE / (size + m - common)::DOUBLE AS similarity FROM scored)
SELECT doc_id, item_id, similarity, start::INT AS start, (m + 4)::INT AS n_words
FROM rated WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = classifier.fit(docs, documents(spark, sf_dir, "labels"))
    return classifier.score(docs, model).select(
        "doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.deduplicate(documents(spark, sf_dir).select("doc_id", "text"), 400, keep_first=False)
    return done.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        F.when(F.col("n_bytes") > 0, F.col("n_removed") / F.col("n_bytes")).alias("removed_share"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(documents(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = documents(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damage(talks), talks)


def op13_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return exact_copies.report(docs, exact_copies.insert(docs))


OP13_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
groups AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM texts JOIN groups USING (t)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shards": op1_shards,
    "op2_mix": op2_mix,
    "op3_near_copies": op3_near_copies,
    "op4_secrets": op4_secrets,
    "op5_rules": op5_rules,
    "op6_tokens": op6_tokens,
    "op7_passages": op7_passages,
    "op8_leaks": op8_leaks,
    "op9_quality": op9_quality,
    "op10_factors": op10_factors,
    "op11_whitening": op11_whitening,
    "op12_conversations": op12_conversations,
    "op13_exact_copies": op13_exact_copies,
}
ORACLES: dict[str, str] = {"op2_mix": OP2_SQL, "op4_secrets": OP4_SQL, "op8_leaks": OP8_SQL,
    "op13_exact_copies": OP13_SQL}
