"""Intake, table upkeep, audits and removals (section A)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark import vocab as V
from quillmark.schemas import CASCADE, REFERENCES, TABLES


def intake(files: DataFrame, max_bytes: int = V.MAX_UPLOAD_BYTES, max_pages: int = V.MAX_PAGES,
           store: str = "store://papers") -> DataFrame:
    """Accept or reject raw files; the first failing rule names the reason."""
    size = F.octet_length("content")
    reason = (
        F.when(size > max_bytes, "too_large")
        .when(size == 0, "empty")
        .when(F.substring("content", 1, 5) != F.lit("%PDF-").cast("binary"), "not_pdf")
        .when(F.col("page_count") > max_pages, "too_many_pages")
    )
    digest = F.sha2("content", 256)
    ok = reason.isNull()
    return files.select(
        "path",
        size.alias("size_bytes"),
        "page_count",
        F.when(ok, digest).alias("content_hash"),
        F.when(ok, F.concat(F.lit(f"{store}/"), digest, F.lit(".pdf"))).alias("storage_uri"),
        reason.alias("reject_reason"),
    )


def route(accepted: DataFrame, papers: DataFrame) -> DataFrame:
    """Decide per upload: ingest, re-ingest a failed paper, or only link concepts.

    Copies inside the batch follow the first path: it ingests, they link. The
    first path is found by aggregation, so a hash with very many copies is
    reduced on the map side before it meets the papers.
    """
    first = accepted.groupBy("content_hash").agg(F.min("path").alias("first_path"))
    known = first.join(
        papers.select("content_hash", "paper_id", "processing_status"), "content_hash", "left"
    )
    must_ingest = F.col("paper_id").isNull() | (F.col("processing_status") == "failed")
    return accepted.join(known, "content_hash").select(
        "path",
        "content_hash",
        "paper_id",
        F.when((F.col("path") == F.col("first_path")) & must_ingest, "ingest")
        .otherwise("canonicalize").alias("action"),
        F.when(
            (F.col("path") == F.col("first_path")) & (F.col("processing_status") == "failed"),
            "queued",
        ).alias("reset_status"),
    )


def apply_grants(grants: DataFrame, events: DataFrame) -> DataFrame:
    """Fold grant and revoke events into the grant table.

    Only the last event decides whether access is revoked; a revoke alone never
    creates a row. One aggregation per key, then one full join.
    """
    order = F.struct("happened_at", "event_id")
    folded = events.groupBy("user_id", "paper_id").agg(
        F.min(F.when(F.col("kind") == "grant", F.col("happened_at"))).alias("first_grant"),
        F.max_by(F.struct("kind", "happened_at"), order).alias("last"),
    )
    both = grants.join(folded, ["user_id", "paper_id"], "full_outer")
    return both.filter(F.col("added_at").isNotNull() | F.col("first_grant").isNotNull()).select(
        "user_id",
        "paper_id",
        F.coalesce("added_at", "first_grant").alias("added_at"),
        "last_opened_at",
        F.when(F.col("last.kind") == "revoke", F.col("last.happened_at"))
        .when(F.col("last.kind").isNull(), F.col("revoked_at")).alias("revoked_at"),
    )


def insert_absent(target: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``new`` whose key the target lacks, one per key (lowest order)."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("r")
    ).select(*keys, "r.*")
    return one.join(target.select(*keys).distinct(), keys, "left_anti").select(*new.columns)


def insert_or_get(target: DataFrame, new: DataFrame, keys: list[str], id_col: str,
                  order: list[str]) -> DataFrame:
    """Each asked key with the id that won: the stored row's, or that of the first new row; and whether it is new.

    Both sides are reduced to one row a key before they meet, so repeated asks cost one join row.
    """
    first = new.groupBy(*keys).agg(F.min_by(id_col, F.struct(*order)).alias("_fresh"))
    there = target.groupBy(*keys).agg(F.min(id_col).alias("_there"))
    return first.join(there, keys, "left").select(
        *keys, F.coalesce("_there", "_fresh").alias(id_col), F.col("_there").isNull().alias("inserted"))


def expired(created_at: Column, as_of: Column, days: int = V.RETENTION_DAYS) -> Column:
    return created_at < as_of - F.expr(f"INTERVAL '{days}' DAY")


def sweep(messages: DataFrame, as_of: Column) -> DataFrame:
    """Messages that stay; the filter reaches the scan (and its date partitions)."""
    return messages.filter(~expired(F.col("created_at"), as_of))


def sweep_report(messages: DataFrame, as_of: Column) -> DataFrame:
    return messages.agg(
        F.count("*").alias("total"),
        F.count_if(expired(F.col("created_at"), as_of)).alias("expired"),
        F.max(as_of - F.expr(f"INTERVAL '{V.RETENTION_DAYS}' DAY")).alias("cutoff"),
    )


def mutation_audit(before: DataFrame, after: DataFrame, table: str, key: list[str],
                   erased_users: DataFrame | None = None) -> DataFrame:
    """Rows a snapshot pair shows as updated or deleted against the table's rule.

    Appended rows are fine. ``messages`` may lose rows but not change them.
    Rows of erased users are exempt.
    """
    body = [c for c in before.columns if c not in key]
    digest = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in body])
    old = before.select(*key, "user_id", digest.alias("was"))
    if erased_users is not None:
        old = old.join(erased_users.select("user_id").distinct(), "user_id", "left_anti")
    cur = after.select(*key, digest.alias("now"))
    joined = old.drop("user_id").join(cur, key, "left")
    kind = F.when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("was"), "updated")
    out = joined.select(F.lit(table).alias("table_name"), *key, kind.alias("change"))
    allowed = ["updated"] if table in V.IMMUTABLE else ["updated", "deleted"]
    return out.filter(F.col("change").isin(allowed))


def audit_rows(df: DataFrame, table: str, rules: dict[str, str]) -> DataFrame:
    """Every row rule of a table in one pass: (table, rule, violations)."""
    counted = df.agg(
        *[F.count_if(~F.expr(rule)).alias(name) for name, rule in rules.items()]
    )
    pairs = ", ".join(f"'{name}', `{name}`" for name in rules)
    return counted.selectExpr(
        f"'{table}' AS table_name", f"stack({len(rules)}, {pairs}) AS (rule, violations)"
    )


def audit_unique(df: DataFrame, table: str, key: list[str], where: str | None = None) -> DataFrame:
    """Rows beyond the first of a key; a key with a null repeats nothing.

    Nulls are left out after counting, so a filter on them cannot keep Spark from sharing the shuffle of ``df``.
    """
    src = df if where is None else df.filter(where)
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in key])
    return (
        src.groupBy(*key).agg(F.count("*").alias("_n"))
        .agg(F.coalesce(F.sum(F.when(whole, F.col("_n") - 1)), F.lit(0)).alias("violations"))
        .select(F.lit(table).alias("table_name"),
                F.lit("unique(" + ",".join(key) + ")").alias("rule"), "violations")
    )


def audit_reference(df: DataFrame, table: str, column: str, parent: DataFrame,
                    parent_key: str) -> DataFrame:
    """Dangling references. Values are counted first, so a hot value, or null, joins as one row; null is left out
    last, as in ``audit_unique``."""
    used = df.groupBy(column).agg(F.count("*").alias("n"))
    keys = parent.select(F.col(parent_key).alias(column))
    return (
        used.join(keys, column, "left_anti")
        .agg(F.coalesce(F.sum(F.when(F.col(column).isNotNull(), F.col("n"))), F.lit(0)).alias("violations"))
        .select(F.lit(table).alias("table_name"), F.lit(f"fk({column})").alias("rule"),
                "violations")
    )


def _remove(tables: dict[str, DataFrame], root: str, gone: DataFrame) -> dict[str, DataFrame]:
    """Follow the reference rules from removed ``root`` rows to a fixed end.

    The reference graph is the schema's, not the data's: each table is handled
    once, in an order where its cascading parents are already known. Joins are
    on keys; nothing is collected.
    """
    keys = {name: TABLES[name].key for name in tables}
    removed: dict[str, DataFrame] = {root: gone}
    result = dict(tables)
    pending = [t for t in tables if t != root]
    result[root] = tables[root].join(gone, list(keys[root]), "left_anti")
    while pending:
        for table in pending:
            parents = [r for r in REFERENCES if r[0] == table and r[3] == CASCADE and r[2] in tables]
            if any(p[2] in pending and p[2] != table for p in parents):
                continue
            doomed = None
            for _, column, parent, _ in parents:
                if parent not in removed:
                    continue
                pk = keys[parent][0]
                hit = tables[table].join(
                    removed[parent].select(F.col(pk).alias(column)), column, "left_semi"
                ).select(*keys[table])
                doomed = hit if doomed is None else doomed.unionByName(hit)
            if doomed is not None:
                removed[table] = doomed.distinct()
                result[table] = tables[table].join(removed[table], list(keys[table]), "left_anti")
            pending.remove(table)
            break
    for table, column, parent, action in REFERENCES:
        if action == CASCADE or table not in tables or column not in tables[table].columns:
            continue
        if parent not in removed:
            continue
        pk = keys[parent][0]
        lost = removed[parent].select(F.col(pk).alias(column)).distinct().withColumn(
            "_lost", F.lit(True))
        cols = result[table].columns
        result[table] = result[table].join(lost, column, "left").select(
            *[F.when(F.col("_lost").isNull(), F.col(c)).alias(c) if c == column else F.col(c)
              for c in cols]
        )
    return result


def erase_users(tables: dict[str, DataFrame], user_ids: DataFrame) -> dict[str, DataFrame]:
    """Remove users and everything that cascades; papers and chunks survive."""
    return _remove(tables, "users", user_ids.select("user_id").distinct())


def drop_papers(tables: dict[str, DataFrame], paper_ids: DataFrame) -> dict[str, DataFrame]:
    return _remove(tables, "papers", paper_ids.select("paper_id").distinct())


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
