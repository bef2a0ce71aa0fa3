"""Physical plans and source text: what must never appear."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from quillmark.plans import views
from suite_paths import ROOT, SMALL

CHECKED = ("c1_authorised_scope", "c4_filtered_top_k", "d5_verify_answers", "e13_score_timeline",
           "f4_prefetch", "f12_concept_detail", "g2_exact_match", "h5_callback_decision",
           "i1_check_gate", "j11_context_assembly", "k4_applied_to_turn")


@pytest.mark.parametrize("name", CHECKED)
def test_no_cartesian_products(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_top_k_is_limited_before_the_shuffle(spark):
    plan = entry.queries()["c4_filtered_top_k"](spark, SMALL)._jdf.queryExecution()
    assert "WindowGroupLimit" in plan.executedPlan().toString()


def test_library_text():
    core = [p for p in Path(ROOT / "quillmark").rglob("*.py") if "llm" not in p.parts]
    text = "\n".join(p.read_text() for p in core)
    assert "localCheckpoint" not in text and "crossJoin" not in text
    assert not re.search(r"\.rdd\b|toPandas\(|\.collect\(\)|current_timestamp", text)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ("a5_insert_concepts", "a11_paper_removal", "h4_prior_paper", "h5_callback_decision"))
def test_names_and_links_of_concepts_need_no_folded_evidence(spark, monkeypatch, name):
    made, store = [], views.store
    monkeypatch.setattr(views, "_stored_paths", {})
    monkeypatch.setattr(views, "store", lambda df, label: made.append(label) or store(df, label))
    entry.queries()[name](spark, SMALL)
    assert not {"states", "concepts"} & set(made) and (made == [] or name != "a5_insert_concepts")


def test_names_and_links_are_those_of_the_concepts(spark):
    v = views.Views.of(spark, SMALL)
    for part in (v.concept_names, v.concept_links):
        whole = v.concepts.select(*part.columns)
        assert part.count() == whole.count() and part.exceptAll(whole).isEmpty()


@pytest.mark.parametrize("name", ("g2_exact_match", "g4_band_split", "g5_apply_verdicts", "g6_verdict_completeness"))
def test_names_are_resolved_without_folded_evidence(spark, monkeypatch, name):
    made, store = [], views.store
    monkeypatch.setattr(views, "_stored_paths", {})
    monkeypatch.setattr(views, "store", lambda df, label: made.append(label) or store(df, label))
    entry.queries()[name](spark, SMALL)
    assert not {"observations", "states", "concepts"} & set(made)


def test_the_audit_derives_no_column_that_it_does_not_check(spark, monkeypatch):
    made, store = [], views.store
    monkeypatch.setattr(views, "_stored_paths", {})
    monkeypatch.setattr(views, "store", lambda df, label: made.append(label) or store(df, label))
    entry.queries()["a9_constraint_audit"](spark, SMALL)
    assert not {"turns", "user_paper_access", "concepts"} & set(made)


def test_tables_that_are_written_once_are_not_stored_before(spark, monkeypatch):
    made, store = [], views.store
    monkeypatch.setattr(views, "_stored_paths", {})
    monkeypatch.setattr(views, "store", lambda df, label: made.append(label) or store(df, label))
    entry.queries()["a1_all_tables"](spark, SMALL)
    assert made == ["observations"]
