"""The registered corpus queries over the smallest tables, against their DuckDB twins where they have one."""

import check
import pytest

from quillmark.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twins(spark, name):
    problem, rows = check.compare(spark, check.connect(SMALL), queries.QUERIES[name], queries.ORACLES[name], SMALL)
    assert problem is None and rows


def test_contract_columns(spark):
    want = {
        "op1_shards": "doc_id size text_crc32 law shard slot grown_shard",
        "op2_mix": "doc_id size source_size target taken",
        "op3_near_copies": "doc_id n_shingles component_id kept",
        "op4_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op5_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op6_tokens": "doc_id start n_tokens ids_crc32",
        "op7_passages": "doc_id n_words n_removed kept_sha256",
        "op9_quality": "doc_id held_out score predicted",
        "op10_factors": "doc_id n_bytes n_removed n_spans kept_sha256",
        "op11_whitening": "vec_id component n deviation whitened explained identity_error",
        "op12_conversations": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
        "op13_exact_copies": "doc_id keep_id group_size kept text_sha256",
    }
    assert sorted(queries.QUERIES) == sorted([*want, "op8_leaks"])
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, SMALL).columns[: len(columns.split())] == columns.split(), name
