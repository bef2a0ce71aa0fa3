import sys

import pytest

from suite_paths import ROOT, SMALL

sys.path[:0] = [str(ROOT), str(ROOT / "tools")]


@pytest.fixture(scope="session")
def spark():
    from quillmark import session

    s = session.local(8)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def views(spark):
    from quillmark.plans.views import Views

    return Views.of(spark, SMALL)
