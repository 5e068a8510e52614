"""Registered queries against DuckDB on the smallest tables.

The default run takes a cross-section; CODELOOM_ALL=1 takes every query.
"""

import os

import pytest

from codeloom.plans import catalog
from tests import oracle

SF = "/root/testdata/sf0.001"
CROSS_SECTION = """
mesh_statistics find_callers node_at_location trace_queue_flow containing_class impact_analysis api_docs class_hierarchy call_graph
module_dependencies keyword_search belief_entities belief_pairs belief_graph_stats shortest_path feedback_states flag_reviews adjust_beliefs
trust_scores patterns_needing_evolution evolve_patterns classify_files prioritize_files parse_diff diff_hunks parse_review_responses
match_principles pair_events usage_summary extraction_chain match_references create_links link_stats detect_language match_schemas
extract_nodes scope_end_indent extract_imports extract_calls parse_manifests related_files flatten_config changed_set upsert_edges
export_mesh feedback_stream paired_stream
""".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES) if os.environ.get("CODELOOM_ALL") else CROSS_SECTION)
def test_query_equals_sql(spark, duck, name):
    problem = oracle.compare(spark, duck, name, SF)
    assert problem in (None, "no rows")


def test_oracles_have_queries():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert set(CROSS_SECTION) <= set(catalog.QUERIES)
