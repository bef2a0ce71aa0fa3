import pytest

from quillmark.functions.shared import new_path
from quillmark.llm import secret_scan

OLD = secret_scan.Rule("run", 1, "[0-9a-f]{8,}", 0, 8)


@pytest.mark.parametrize("new,want", [
    (OLD._replace(version=2, pattern="[0-9a-f-]{8,}"), "run:0:20,run:21:31"),  # wider: other gaps and sizes
    (OLD._replace(version=2, least=12), "run:0:16"),  # the same places, other bound
])
def test_a_report_takes_only_the_versions_asked_for(spark, new, want):
    ledger = new_path(spark, "ledger")
    history = spark.createDataFrame([(1, "0123456789abcdef-123 abcdefabcd")], "path long, text string")
    for rules in ((OLD,), (new,)):
        secret_scan.update(history, ledger, rules)
    assert secret_scan.report(history, ledger, (new,)).first()["spans"] == want
    assert secret_scan.report(history, ledger, (OLD,)).first()["spans"] == "run:0:16,run:21:31"


def test_ledgers_from_before_tags_are_read(spark):
    ledger = new_path(spark, "ledger")
    history = spark.createDataFrame([(1, "0123456789abcdef 1")], "path long, text string")
    secret_scan.update(history, ledger, (OLD,))
    old = new_path(spark, "ledger")
    spark.read.parquet(ledger).selectExpr(
        "blob", "rules", "transform(found, f -> struct(f.kind, f.least, f.gaps, f.sizes, f.values)) as found").write.parquet(old)
    new = OLD._replace(version=2, least=20)
    secret_scan.update(history, old, (OLD, new))
    assert secret_scan.report(history, old, (OLD,)).first()["spans"] == "run:0:16"
    assert secret_scan.report(history, old, (new,)).first()["spans"] == ""
