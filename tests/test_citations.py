import pytest

from quillmark.operators import citations as D

SETS = [("t", 1, 11), ("t", 2, 12), ("t", 3, 13)] + [("big", i, 100 + i) for i in range(1, 13)] + [
    ("decoy", 1, 99)]


@pytest.mark.parametrize("turn,draft,text,kept,stripped,status", [
    ("t", "A [1] and [2].", "A [1] and [2].", ["[1]", "[2]"], [], "grounded"),
    ("t", "A [9] .", "A.", [], ["[9]"], "no_evidence"),
    ("t", "A [1] [7] b", "A [1] b", ["[1]"], ["[7]"], "grounded"),
    ("t", "No markers.", "No markers.", [], [], "degraded"),
    ("t", "   ", "", [], [], "no_evidence"),
    ("none", "A [1].", "A.", [], ["[1]"], "no_evidence"),
    ("t", "x [0] [01]", "x [01]", ["[01]"], ["[0]"], "grounded"),
    ("t", "[[7]9] stays", "[9] stays", [], ["[7]"], "no_evidence"),
    ("big", "[10] [2]", "[10] [2]", ["[10]", "[2]"], [], "grounded"),
    ("t", "a  b [1]   \nc", "a b [1]\nc", ["[1]"], [], "grounded"),
])
def test_drafts(spark, turn, draft, text, kept, stripped, status):
    answers = spark.createDataFrame([(turn, draft), ("other", "x")], "turn_id STRING, draft STRING")
    sets = spark.createDataFrame(SETS, "turn_id STRING, rank_no INT, chunk_id INT")
    r = D.verify(answers, sets).filter(f"turn_id = '{turn}'").first()
    assert (r.text, r.cited_markers, r.stripped_markers, r.grounding_status) == (
        text, kept, stripped, status)


def test_last_marker_string_wins_on_the_row(spark):
    answers = spark.createDataFrame([("t", "[1] [01] [3]")], "turn_id STRING, draft STRING")
    sets = spark.createDataFrame(SETS, "turn_id STRING, rank_no INT, chunk_id INT")
    flagged = D.flag_retrievals(sets, D.resolve(answers, sets))
    got = {(r.rank_no, r.citation_marker) for r in flagged.filter("was_cited").collect()}
    assert got == {(1, "[1]"), (3, "[3]")}
    assert flagged.filter("was_cited <> (citation_marker IS NOT NULL)").count() == 0
