import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions.shared import materialise
from quillmark.functions.similarity import blocked_top_k
from quillmark.operators import ann as A
from quillmark.operators import retrieval as R


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    q = [(i, i % 2, rng.standard_normal(8).tolist(), "a" if i % 3 == 0 else None) for i in range(30)]
    # a third of all items in group 0, with exact copies to force ties
    c = [(i, 0 if i % 3 == 0 else 1, rng.standard_normal(8).tolist(), "ab"[i % 2]) for i in range(90)]
    c += [(100 + i, g, v, t) for i, g, v, t in c[:20]]
    qs = spark.createDataFrame(q, "qid INT, g INT, qv ARRAY<FLOAT>, qt STRING")
    cs = spark.createDataFrame(c, "cid INT, g INT, cv ARRAY<FLOAT>, ct STRING")
    return q, c, qs, cs


def brute(q, c, k):
    out = set()
    for qid, qg, qv, qt in q:
        a = np.float32(qv).astype(float)
        scored = []
        for cid, cg, cv, ct in c:
            if cg == qg and (qt is None or qt == ct):
                b = np.float32(cv).astype(float)
                scored.append((-round(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b), 9), cid))
        out |= {(qid, cid) for _, cid in sorted(scored)[:k]}
    return out


@pytest.mark.parametrize("item_block,query_block", [(4096, 1024), (7, 5)])
def test_blocks_equal_brute_force(data, item_block, query_block):
    q, c, qs, cs = data
    near = blocked_top_k(qs, cs, ["g"], "qid", "cid", "qv", "cv", 4, F.col("qt"), F.col("ct"),
                         item_block, query_block)
    got = R.best(near.selectExpr("qid AS query_id", "cid AS chunk_id", "similarity"), 4)
    assert {(r.query_id, r.chunk_id) for r in got.collect()} == brute(q, c, 4)


def index_of(spark, rows, monkeypatch, shelf=64, **options):
    monkeypatch.setattr(A, "SHELF", shelf)
    monkeypatch.setattr(A, "QUERIES", 16)
    return A.build(spark.createDataFrame(rows, "chunk_id LONG, embedding ARRAY<FLOAT>, role STRING"), 5,
                   F.col("role"), **options)


def clustered(n, seed=1):
    heart, rng = np.random.default_rng(0).standard_normal((12, 16)) * 4, np.random.default_rng(seed)
    return [(i, (heart[i % 12] + rng.standard_normal(16)).tolist(), "rare" if i % 97 == 0 else "common") for i in range(n)]


def exact(queries, rows, k):
    x = np.float32([r[1] for r in rows]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for qid, v, want in queries:
        q = np.float32(v).astype(float)
        sims = np.round(x @ q / np.linalg.norm(q), 9)
        ok = [(-s, r[0]) for s, r in zip(sims, rows) if want is None or r[2] == want]
        out[qid] = {c for _, c in sorted(ok)[:k]}
    return out


def test_index_looks_into_few_cells_and_finds_nearly_all(spark, monkeypatch):
    """Probes follow the structure of the vectors, not their number."""
    probes = []
    for n in (600, 2400):
        rows = clustered(n)
        index = index_of(spark, rows, monkeypatch, cells=24)
        probes.append(index.probes)
        queries = [(i, v, None) for i, v, _ in clustered(60, seed=2)]
        asked = spark.createDataFrame(queries, "query_id LONG, query_vector ARRAY<FLOAT>, role STRING")
        got = {}
        for r in A.search(asked, index, 5).collect():
            got.setdefault(r.query_id, set()).add(r.chunk_id)
        want = exact(queries, rows, 5)
        assert sum(len(got[q] & want[q]) for q in want) >= 0.9 * 5 * len(want)
        shelves = spark.read.parquet(index.items).groupBy("shelf").count()
        assert shelves.agg(F.max("count")).first()[0] < 4 * 64
    assert max(probes) <= 8


def test_search_widens_until_the_filter_leaves_enough(spark, monkeypatch):
    rows = clustered(700)
    index = index_of(spark, rows, monkeypatch, cells=20)._replace(probes=1)
    queries = [(i, v, ("rare", "common", "absent")[i % 3]) for i, v, _ in clustered(45, seed=3)]
    asked = spark.createDataFrame(queries, "query_id LONG, query_vector ARRAY<FLOAT>, role STRING")
    got = {}
    for r in A.search(asked, index, 8, F.col("role")).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
    want = exact(queries, rows, 8)
    for qid, _, role in queries:
        assert len(got.get(qid, ())) == len(want[qid])  # 8 rare chunks, no absent one
        if role == "rare":
            assert got[qid] == want[qid]


def test_one_crowded_cell_and_equal_vectors(spark, monkeypatch):
    rows = [(i, [1.0, 0.0, 0.0, 0.5], "a") for i in range(500)] + [(500 + i, [0.0, 1.0, float(i), 0.0], "a") for i in range(30)]
    rows += [(900, None, "a"), (901, [0.0] * 4, "a")]
    index = index_of(spark, rows, monkeypatch, cells=4)
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.5]), (2, None)], "query_id LONG, query_vector ARRAY<FLOAT>")
    out = A.search(asked, index, 6).orderBy("rank_no").collect()
    assert [r.chunk_id for r in out] == list(range(6))  # ties by id, whatever shelf they lie on
    assert A.search(asked, A.build(spark.createDataFrame([], "chunk_id LONG, embedding ARRAY<FLOAT>"), 6), 6).count() == 0


def test_recall_reports_misses(data):
    _, _, qs, cs = data
    q = qs.selectExpr("qid AS query_id", "qv AS query_vector")
    c = cs.selectExpr("cid AS chunk_id", "cv AS embedding")
    whole = R.exact_top_k(q, c, 6)
    report = R.recall(whole.filter("rank_no <= 4"), whole).collect()
    assert len(report) == 30 and all((r.wanted, r.found, r.missed) == (6, 4, 2) for r in report)
    assert R.recall(whole, whole).filter("missed > 0").count() == 0


def test_small_shelves_give_the_same_rows(views):
    """Papers cut over many shelves, and queries over many blocks."""
    scoped = R.scope(views.user_paper_access)
    rows = []
    for shelf in (R.SHELF, 3):
        stored = R.shelve(views.chunks, views.papers, "embed-active", shelf)
        rows.append({tuple(r) for r in R.retrieve(views.queries, scoped, stored, "embed-active", 0.25).collect()})
    assert rows[0] == rows[1] and rows[0]


def test_stored_vectors_are_read_once_and_stay_in_their_buckets(spark, views):
    stored = R.shelve(views.chunks, views.papers, "embed-active")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = R.retrieve(views.queries, R.scope(views.user_paper_access), stored, "embed-active", 0.25)
        out.collect()
        plan = out._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    text = plan.toString()
    text = text[: text.index("== Initial Plan ==")] if "== Initial Plan ==" in text else text
    reads = [line for line in text.splitlines() if "FileScan" in line and "unit" in line.split("ReadSchema")[-1]]
    assert len(reads) == 1 and "Bucketed: true" in reads[0]
    moved = [line for line in text.splitlines() if " Exchange " in line and "unit" in line]
    assert not moved


def test_out_of_scope_row_fails_the_job(spark):
    results = spark.createDataFrame([(1, 5), (1, 6)], "user_id INT, paper_id INT")
    scoped = spark.createDataFrame([(1, 5)], "user_id INT, paper_id INT")
    assert R.assert_scoped(results.filter("paper_id = 5"), scoped).count() == 1
    with pytest.raises(Exception, match="authorised scope"):
        R.assert_scoped(results, scoped).collect()


def test_empty_request_list_reads_nothing(views):
    none = views.user_paper_access.limit(0)
    assert R.scope(views.user_paper_access, requested=none).count() == 0


def _sent_to_all(df):
    """What the plan would send through the driver to every task: the first line below each broadcast."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [below for line, below in zip(lines, lines[1:]) if "BroadcastExchange" in line]


def test_vectors_in_small_files_are_not_broadcast(spark):
    """Vectors that are alike take a hundredth of their size in files, which is what Spark goes by."""
    rows = materialise(spark.range(3000).select(
        (F.col("id") % 100).alias("user_id"), "id", F.array_repeat(F.lit(0.5), 64).alias("vector")), "alike")
    found = blocked_top_k(rows, rows.withColumnRenamed("id", "item"), ["user_id"], "id", "item", "vector", "vector", 1)
    assert not [x for x in _sent_to_all(found) if "vec" in x]


def test_tables_count_as_large_as_their_rows(spark, views):
    ids = materialise(spark.range(700_000).select("id", (F.col("id") * 7).alias("other")), "ids")
    twice = materialise(spark.range(3_000_000).select("id", (F.col("id") * 3).alias("third")), "more")
    assert not _sent_to_all(twice.join(ids, "id"))


def test_rows_travel_to_few_blocks_where_all_meet(spark, monkeypatch):
    from quillmark.functions import similarity as S

    monkeypatch.setattr(S, "LARGE_BLOCK", 200)
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(900)], "id LONG, vector ARRAY<FLOAT>")
    found = blocked_top_k(rows, rows.withColumnRenamed("id", "item"), [], "id", "item", "vector", "vector", 1,
                          item_block=10, query_block=10)
    # 900 rows are 90 blocks of 10; a row goes to no more than SPREAD blocks, and gives as many rows of its own
    assert found.count() == 900 * S.SPREAD
    assert found.filter("id = item").count() == 900


def test_tiles_lose_no_neighbour(monkeypatch):
    from quillmark.functions import similarity as S

    monkeypatch.setattr(S, "TILE_ITEMS", 7)
    monkeypatch.setattr(S, "TILE_PAIRS", 30)
    sims = np.round(np.random.default_rng(5).normal(size=(23, 40)), 1)  # many ties
    sims[3], sims[4, :38] = -np.inf, -np.inf
    best = S.Best(23, 5)
    for rows, cols in S.tiles(np.arange(23), np.arange(40)):
        best.add(rows, cols, sims[np.ix_(rows, cols)])
    row, col, sim = best.settle()
    want = [(r, c) for r in range(23) for c in np.lexsort((np.arange(40), -sims[r]))[:5] if np.isfinite(sims[r, c])]
    assert list(zip(row, col)) == want and (sim == sims[row, col]).all()
