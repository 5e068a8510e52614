"""Keyword routing of questions about the mesh, and SQL over its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.operators import graph, mesh

METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH")


def ask(nodes: DataFrame, edges: DataFrame, question: str, project_id: str | None = None, limit: int = 50) -> DataFrame:
    """Answer a short question with the matching mesh query.

    "calls" asks for callers, any other "call" for callees; a question without
    a known word is a name search.
    """
    low, words = question.lower(), question.split()
    last = words[-1] if words else ""
    if "api" in low and "endpoint" in low:
        method = next((m for m in METHODS if m.lower() in low), None)
        return mesh.find_api_endpoints(nodes, project_id, method, limit=limit)
    if "call" in low:
        find = mesh.find_callers if "calls" in low else mesh.find_callees
        return find(nodes, edges, last, project_id, limit)
    if "queue" in low or "topic" in low:
        return mesh.trace_queue_flow(nodes, edges, last).orderBy("queue_id", "role", "node_id").limit(limit)
    if "cross" in low and "project" in low:
        kind = "queue" if "queue" in low else "api" if "api" in low else "database" if "database" in low or "db" in low else None
        return mesh.cross_project_links(nodes, edges, project_id, kind, limit)
    if "class" in low and ("inherit" in low or "hierarchy" in low):
        return graph.class_hierarchy(nodes, edges, last)
    if "function" in low or "method" in low:
        place = next((i for i, w in enumerate(words) if w in ("named", "called")), None)
        pattern = words[place + 1] if place is not None and place + 1 < len(words) else None
        return mesh.find_functions(nodes, project_id, pattern, limit)
    if "file" in low:
        return mesh.find_file_contents(nodes, last, project_id)
    return mesh.search_by_name(nodes, question, project_id=project_id, limit=limit)


def mesh_sql(spark: SparkSession, nodes: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """Any SQL over ``mesh_nodes`` and ``mesh_edges``."""
    nodes.createOrReplaceTempView("mesh_nodes")
    edges.createOrReplaceTempView("mesh_edges")
    return spark.sql(text)
