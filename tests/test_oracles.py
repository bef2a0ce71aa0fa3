"""Every registered query against its DuckDB twin on the smallest tables."""

import re

import check
import pytest

import __spark_entry__ as entry
from suite_paths import SMALL

# the corpus queries have tests of their own
QUERIES = {n: q for n, q in entry.queries().items() if not re.match(r"op\d+_|pipeline$", n)}
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return check.connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name in ORACLES:
        problem, _ = check.compare(spark, duck, QUERIES[name], ORACLES[name], SMALL)
        assert problem is None
    else:
        assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["query_id", "chunk_id"]
