from datetime import datetime

from pyspark.sql import functions as F

from quillmark.functions.shared import new_path
from quillmark.operators import maintenance as M
from quillmark.schemas import TABLES
from quillmark.sources import catalog


def test_intake_reads_raw_files_and_first_rule_wins(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF-1.7 x", "c.txt": b"hello",
                       "d.pdf": b"%PDF-" + b"x" * 100, "b.pdf": b""}.items():
        (tmp_path / name).write_bytes(data)
    out = M.intake(catalog.read_files(spark, str(tmp_path)), max_bytes=50)
    got = {r.path.rsplit("/", 1)[1]: r for r in out.collect()}
    assert got["a.pdf"].reject_reason is None and got["a.pdf"].storage_uri.endswith(".pdf")
    assert [got[n].reject_reason for n in ("b.pdf", "c.txt", "d.pdf")] == [
        "empty", "not_pdf", "too_large"]


def test_empty_uploads_with_odd_names_are_listed(spark, tmp_path):
    (tmp_path / "x y").mkdir()
    names = ["x y/é b.pdf", "x y/c%20d+e.pdf", "plain.pdf"]
    for name in names:
        (tmp_path / name).write_bytes(b"")
    (tmp_path / "x y/full + one.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "_hidden").write_bytes(b"")
    got = {r.path.split(str(tmp_path) + "/")[1]: r.reject_reason for r in M.intake(catalog.read_files(spark, str(tmp_path))).collect()}
    assert got == {**dict.fromkeys(names, "empty"), "x y/full + one.pdf": None}


def test_every_table_round_trips(spark):
    for name, table in TABLES.items():
        root = new_path(spark, name)
        empty = spark.createDataFrame([], table.schema)
        catalog.write_table(empty, root, name)
        assert set(catalog.read_table(spark, root, name).columns) == set(table.schema.names)


def test_replace_twice_is_replace_once(spark):
    path = new_path(spark, "sections")
    base = spark.createDataFrame([(p, o, "old") for p in range(30) for o in range(3)],
                                 "paper_id INT, ordinal INT, role STRING")
    catalog.with_bucket(base, 4).write.partitionBy("paper_bucket").parquet(path)
    ids = spark.createDataFrame([(3,), (7,)], "paper_id INT")
    rows = spark.createDataFrame([(3, 0, "new")], "paper_id INT, ordinal INT, role STRING")
    for _ in range(2):
        catalog.replace_papers(spark, path, rows, ids, 4)
    after = spark.read.parquet(path)
    assert after.count() == 30 * 3 - 5 and after.filter("role = 'new'").count() == 1
    assert after.filter("paper_id = 7").count() == 0


def test_erasure_leaves_shared_papers_and_empties_dangling_references(spark):
    tables = {
        "users": spark.createDataFrame([(1,), (2,)], "user_id INT"),
        "papers": spark.createDataFrame([(5,)], "paper_id INT"),
        "user_paper_access": spark.createDataFrame([(1, 5), (2, 5)], "user_id INT, paper_id INT"),
        "concepts": spark.createDataFrame(
            [(10, 1, None), (20, 2, 10)], "concept_id INT, user_id INT, merged_into_id INT"),
        "sessions": spark.createDataFrame([(30, 1, 5), (31, 2, 5)],
                                          "session_id INT, user_id INT, active_paper_id INT"),
        "turns": spark.createDataFrame([(40, 30, 2), (41, 31, 2)],
                                       "turn_id INT, session_id INT, user_id INT"),
    }
    out = M.erase_users(tables, spark.createDataFrame([(1,)], "user_id INT"))
    rows = {t: [tuple(r) for r in df.collect()] for t, df in out.items()}
    assert rows == {"users": [(2,)], "papers": [(5,)], "user_paper_access": [(2, 5)],
                    "concepts": [(20, 2, None)], "sessions": [(31, 2, 5)], "turns": [(41, 31, 2)]}


def test_revoke_alone_creates_nothing_and_grant_restores(spark):
    t = datetime(2024, 1, 1)
    grants = spark.createDataFrame([(1, 1, t, None, t), (1, 2, t, None, None)],
                                   "user_id INT, paper_id INT, added_at TIMESTAMP, "
                                   "last_opened_at TIMESTAMP, revoked_at TIMESTAMP")
    events = spark.createDataFrame([(1, 1, "grant", t, 1), (1, 2, "revoke", t, 2),
                                    (1, 3, "revoke", t, 3), (1, 4, "grant", t, 4)],
                                   "user_id INT, paper_id INT, kind STRING, "
                                   "happened_at TIMESTAMP, event_id INT")
    got = {r.paper_id: r.revoked_at for r in M.apply_grants(grants, events).collect()}
    assert got == {1: None, 2: t, 4: None}


def test_retention_filter_reaches_the_scan(views):
    plan = M.sweep(views.messages.select("message_id", "created_at"), views.as_of())
    assert plan.count() < views.messages.count()
    turns = views.turns.filter(F.col("created_at") < views.as_of()).select("turn_id")
    text = turns._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(created_at), LessThan(created_at" in text
    assert "ReadSchema: struct<turn_id:bigint,created_at:timestamp_ntz>" in text


def test_nulls_repeat_nothing_and_refer_to_nothing(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (1, None), (1, None), (None, 9), (None, 9), (2, 9)], "a LONG, b LONG")
    assert M.audit_unique(rows, "t", ["a", "b"]).first()["violations"] == 1
    parents = spark.createDataFrame([(1,), (None,)], "a LONG")
    assert M.audit_reference(rows, "t", "a", parents, "a").first()["violations"] == 1
    empty = rows.filter("false")
    assert [M.audit_unique(empty, "t", ["a"]).first()["violations"],
            M.audit_reference(empty, "t", "a", parents, "a").first()["violations"]] == [0, 0]
