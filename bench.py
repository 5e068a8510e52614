"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from codeloom.plans import catalog  # noqa: E402
from codeloom.session import local_session  # noqa: E402

HEADLINE = """
mesh_statistics find_callers trace_queue_flow resolve_edges neighbourhood impact_analysis suggest_reviewers node_at_location containing_class
class_hierarchy function_docs module_dependencies keyword_search vector_search belief_graph_stats feedback_fold feedback_states trust_scores
classify_files prioritize_files parse_diff chunk_hunks parse_review_responses pair_events usage_summary match_references create_links
detect_language match_schemas extract_nodes extract_calls extract_imports merge_incremental upsert_edges export_mesh
""".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(catalog.QUERIES)
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["project_stats"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    timings = {}
    for name in names:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - began, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
