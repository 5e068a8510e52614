"""Steps that must stay in bounds on large tables, against plain versions."""

import itertools
import random

from pyspark.sql import functions as F

from codeloom.functions.scaling import overlap_join
from codeloom.operators import docs, extraction, languages, mesh
from codeloom.plans import fixtures
from codeloom.streaming import streams

NODE = "id string, type string, name string, project_id string, branch string, file string, line_start int, line_end int"
EDGE = "from_id string, to_id string, type string, cross_project boolean"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stream_of_a_folder_of_part_files(spark, tmp_path):
    spark.range(9).repartition(2).write.parquet(str(tmp_path / "data/events.parquet"))
    stream = streams.read_table_stream(spark, str(tmp_path / "data"), "events.parquet")
    streams.append_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(9))


def test_module_dependencies_equal_the_pair_loop(spark):
    rng = random.Random(5)
    files = ["src/a/m1.py", "src/a/m12.py", "lib/é🙂x.py", "top", None, "src/b/m123/deep.py"]
    modules = ["m1", "m12", "m123", "src/a/m12.py", "é🙂", "🙂x", "zz", "", None, "p", "src/b/m123/deep.py and more"]
    rows = [(rng.choice(files), rng.choice(modules)) for _ in range(80)]
    known = sorted({f for f, m in rows if f and m})
    first = {m: min((f for f in known if m in f), default=None) for _, m in rows if m}
    want = {(f, first[m], f.rsplit("/", 1)[0] if "/" in f else ".") for f, m in rows if f and m and first[m] not in (None, f)}
    found = docs.module_dependencies(spark.createDataFrame(rows, "file string, module string"))
    assert "SortMergeJoin" in plan_of(found)
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


def test_cells_are_not_broadcast(spark):
    spans = spark.createDataFrame([("f", 1, 9), ("f", 4, 5), ("g", 1, 900)], "file string, lo int, hi int")
    probes = spark.createDataFrame([("f", 5, 6), ("g", 3, 3), ("h", 1, 1)], "file string, a int, b int")
    met = overlap_join(spans, probes, ["file"], ("lo", "hi"), ("a", "b"))
    assert "SortMergeJoin" in plan_of(met)
    assert sorted((r.lo, r.a) for r in met.collect()) == [(1, 3), (1, 5), (4, 5)]


def _nodes(rng, n, kinds):
    rows = []
    for i in range(n):
        start = rng.randrange(1, 12)
        rows.append((rng.choice([None, f"n{i}", f"n{i // 2}"]) if i % 9 == 0 else f"n{i}", rng.choice(kinds), f"x{i % 3}", rng.choice(["p", "q"]), "main",
                     rng.choice(["a", "b", None]), start, start + rng.randrange(0, 6)))
    return rows


def test_containing_class_equals_the_pair_loop(spark):
    rows = [r for r in _nodes(random.Random(1), 120, ["Class", "Method", "File"]) if r[0]]
    rows += [(f"k{i}", "Class", "k", "p", "main", "hot", 1, 10) for i in range(60)] + [(f"m{i}", "Method", "m", "p", "main", "hot", 2, 5) for i in range(60)]
    known = [("k0", "m7", "CONTAINS", False)]
    want = {}
    for c, m in itertools.product([r for r in rows if r[1] == "Class"], [r for r in rows if r[1] == "Method"]):
        if c[5] and c[5] == m[5] and c[3] == m[3] and c[6] < m[6] and (c[7] > m[7] or c[7] == m[6]):
            want[m[0]] = min(want.get(m[0], (99, "")), (c[6], c[0]))
    found = mesh.containing_class(spark.createDataFrame(rows, NODE), spark.createDataFrame(known, EDGE))
    assert sorted((r.method_id, r.class_id) for r in found.collect()) == sorted((m, c) for m, (_, c) in want.items() if (c, m) != ("k0", "m7"))


def test_node_at_location_equals_the_pair_loop(spark):
    rows = [r for r in _nodes(random.Random(2), 150, ["Class", "Method", "File"]) if r[0]]
    rng = random.Random(3)
    places = [(f"l{i // 2}", rng.choice(["a", "b", None]), s := rng.randrange(1, 14), s + rng.randrange(0, 9)) for i in range(40)]
    want = {}
    for n, (at, file, lo, hi) in itertools.product([r for r in rows if r[1] != "File"], places):
        if file and n[5] == file and n[6] <= hi and n[7] >= lo:
            want[at] = min(want.get(at, (99, "")), (n[7] - n[6], n[0]))
    found = mesh.node_at_location(spark.createDataFrame(rows, NODE), spark.createDataFrame(places, "location_id string, file string, line_from int, line_to int"))
    assert sorted((r.location_id, r.line_end - r.line_start, r.id) for r in found.collect()) == sorted((k, *v) for k, v in want.items())


def test_generated_text_is_dealt_by_its_rows(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "SPREAD_ROWS", 10)
    rows = spark.range(500).withColumn("path", F.col("id").cast("string"))
    assert fixtures.spread(rows, "path").rdd.getNumPartitions() == 50


def test_mesh_is_read_from_compressed_columns(spark):
    text = "import os\nclass A(B):\n    def run(self):\n        return go(1)\n"
    rows = spark.createDataFrame([("p", "a.py", text), ("p", "b.py", text), ("p", None, None)], "project_id string, path string, content string")
    files = languages.with_base_fallback(languages.match_schemas(languages.detect_language(rows)))
    nodes, edges = extraction.extract_mesh(files)
    assert "ExistingRDD" not in plan_of(nodes) and "ExistingRDD" not in plan_of(edges)
    plain = extraction.with_nodes(extraction.find_matches(files))
    assert sorted(map(str, nodes.collect())) == sorted(map(str, extraction.extract_nodes(plain).collect()))
    calls = extraction.extract_calls(plain).select("from_id", "to_id")
    assert sorted(map(tuple, edges.filter("type='CALLS'").select("from_id", "to_id").collect())) == sorted(map(tuple, calls.collect()))
