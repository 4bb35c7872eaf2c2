"""Document operators against their SQL, or the test that stands in for it."""

import pathlib

import pytest

import __spark_entry__ as entry
from starling.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA, same_rows

# Queries without SQL, and the brute-force or library test of each.
TESTED = {
    "op1_packing": "test_tokens.py::test_packing_on_edges", "op2_token_counts": "test_tokens.py::test_counts_on_edges",
    "op3_quality_mil": "test_rules_and_models.py::test_classifier_on_held_out", "op4_pieces": "test_tokens.py::test_pieces_as_the_library",
    "op5_sharding": "test_rules_and_models.py::test_shards_are_minimax", "op6_hmm": "test_rules_and_models.py::test_lm_base_and_gain",
    "op7_quality_rules": "test_pipeline_brute.py::test_stages_match_plain_python", "op9_chat_format": "test_rules_and_models.py::test_chat_rows",
    "op10_order_minhash": "test_dedup.py::test_near_matches_all_pairs", "op13_kmeans_tree": "test_vectors_and_tries.py::test_neighbours_recall_and_scores",
    "pipeline": "test_pipeline_brute.py::test_stages_match_plain_python",
}


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) | {"pipeline"} == set(ORACLES) | set(TESTED) and not set(ORACLES) & set(TESTED)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    for place in TESTED.values():
        file, _, name = place.partition("::")
        assert f"def {name}(" in (pathlib.Path(__file__).parent / file).read_text()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, oracle, name):
    mine, theirs = same_rows(QUERIES[name](spark, f"{DATA}/sf0.01"), oracle, ORACLES[name])
    assert mine and mine == theirs
