"""Rows against brute force on small inputs, and the shape of plans that large inputs depend on."""

from __future__ import annotations

import time
from collections import defaultdict
from itertools import product

from pyspark.sql import functions as F

from codeloom import session
from codeloom.operators import context, extraction, linking, mesh, review
from codeloom.plans import catalog, fixtures
from codeloom.sources import store


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_merges_let_go_of_what_they_shuffled(spark, tmp_path):
    held = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    schema = "id string, name string, file string, line_start int, project_id string, branch string"
    drawn = "from_id string, to_id string, type string, target_name string, in_file boolean, project_id string, branch string, file string"
    nodes = spark.createDataFrame([(f"n{i}", f"f{i % 7}", f"a{i % 5}.py", i, f"p{i % 3}", "main") for i in range(60)], schema)
    edges = spark.createDataFrame([(f"n{i}", "x", "CALLS", f"f{(i + 1) % 7}", False, f"p{i % 3}", "main", f"a{i % 5}.py") for i in range(60)], drawn)
    paths = [str(tmp_path / name) for name in ("nodes", "edges")]
    store.write_branches(nodes, paths[0])
    store.write_branches(store.bind_targets(edges, nodes), paths[1])
    gone = nodes.select("project_id", "branch", "file").distinct().filter("file = 'a1.py'")
    sizes = []
    for _ in range(4):
        store.merge_mesh_stored(spark, nodes.filter("file = 'a2.py'"), edges.filter("file = 'a2.py'"), gone, *paths)
        time.sleep(2)
        sizes.append(held())
    assert sizes[-1] <= sizes[0] + 4, sizes
    assert spark.read.parquet(paths[0]).count() == 48 == spark.read.parquet(paths[1]).count()


def test_an_import_meets_its_files_once(spark):
    tree = ["src/a.ts", "src/a.tsx", "src/b/index.js", "src/b.js", "src/c.d.ts", "src/c.d", "src/e", "src/f/index.ts", "src/.ts", "src/g."]
    files = spark.createDataFrame([("p", path) for path in [*tree, "src/a.ts"]] + [("q", "src/h.ts"), (None, "src/a.ts"), ("p", None)], "project_id string, path string")
    modules = ["./a", "./b", "./c", "./c.d", "./e", "./f", "./h", "./a.ts", "./a.tsx", "../src/b", "./", "./g", "./g.", "lib", None]
    rows = [("p", "src/m.ts", module, line) for line, module in enumerate(modules)] + [("p", "src/m.ts", "../src/a", None), ("p", "src/m.ts", "./a", 0), (None, "src/m.ts", "./a", 1)]
    found = context.related_files(spark.createDataFrame(rows, "project_id string, path string, module string, line int"), files)
    got = {(r.resolved, r.line, r.module) for r in found.collect()}

    def resolved(module):
        parts = []
        for part in ("src/" + module).split("/"):
            parts = parts[:-1] if part == ".." else parts + [part] * (part not in ("", "."))
        target = "/".join(parts)
        name, dot, _ = target.split("/")[-1].rpartition(".")
        tries = [target + middle + end for end in context.RESOLVED_ENDINGS for middle in ("", "/index")] if not (name and dot) else []
        return next((path for path in [*tries, target] if path in tree), None)

    best = {}
    for project, _, module, line in rows:
        if project and module and module[0] == "." and resolved(module):
            key = (line is not None, line or 0, module)
            best[resolved(module)] = min(best.get(resolved(module), key), key)
    assert got == {(path, key[1] if key[0] else None, key[2]) for path, key in best.items()} and len(got) > 6
    lines = plan_of(found)
    first = lambda word: next(i for i, line in enumerate(lines) if word in line)
    assert first("LogicalRDD") < first("Generate")  # imports are not multiplied; names of files are


def test_aliased_imports_lead_to_files(spark):
    files = spark.createDataFrame([("p", path) for path in ("src/p1/a.ts", "src/b/index.js", "lib/c.py", "lib/x/d.ts", "src/x/d.ts", "src/index.ts", "@/p1/a.ts", "app/@b.ts")], "project_id string, path string")
    modules = ["@/p1/a.ts", "@/p1/a", "@/b", "@", "@lib/c", "@/x/d", "~/c", "/abs/c", "@b", "react", "./@b", "@/nowhere", None]
    imports = spark.createDataFrame([("p", f"app/m{line}.ts", module, line) for line, module in enumerate(modules)], "project_id string, path string, module string, line int")
    aliases = {"@/x": "lib/x", "@": "src", "@lib": "/lib", "~": "./lib", "/abs": "lib"}
    got = {(r.module, r.resolved) for r in context.related_files(imports, files, aliases).collect()}
    assert got == {("@/p1/a.ts", "src/p1/a.ts"), ("@/p1/a", "src/p1/a.ts"), ("@/b", "src/b/index.js"), ("@", "src/index.ts"), ("@lib/c", "lib/c.py"),
                   ("@/x/d", "lib/x/d.ts"), ("~/c", "lib/c.py"), ("/abs/c", "lib/c.py"), ("./@b", "app/@b.ts")}
    assert {r.module for r in context.related_files(imports, files).collect()} == {"./@b"}


def matched(rows):
    """Pairs by the six rules in turn, for references without variables."""
    ends = defaultdict(int)
    for kind, identifier, direction, _, project in rows:
        ends[kind, project, identifier, direction] += 1
    short = lambda kind, i: i.split(".")[-1] if kind == "queue" else i
    bare = lambda i: i.removeprefix("GET ").removeprefix("POST ")
    out = {}
    for ((kind, pp, pi, pd), n), ((ck, cp, ci, cd), m) in product(ends.items(), repeat=2):
        if kind is None or None in (pi, ci, pp, cp) or kind != ck or pp == cp or pd == "consume" or cd == "produce":
            continue
        rules = [pi == ci, pi.lower() == ci.lower(), False, False, short(kind, pi) == short(kind, ci), kind == "api" and bare(pi) == bare(ci)]
        if any(rules):
            key = (kind, pp, pi, pd, cp, ci)
            out[key] = (rules.index(True) + 1, n, out.get(key, (0, 0, 0))[2] + m)
    return out


REFS = [(kind, name, direction, f"n{i}", project) for i, (kind, name, direction, project) in enumerate(product(
    ["queue", "api", None], ["a.Q", "b.Q", "Q", "q", "GET x", "POST x", "x", None], ["produce", "consume", "both"], ["p", "r", "s", None]))]


def test_a_pair_is_matched_under_its_best_rank_alone(spark):
    rows = REFS + REFS[::5]
    refs = spark.createDataFrame(rows, "type string, identifier string, direction string, node_id string, project_id string")
    config = spark.createDataFrame([], "project_id string, name string, value string, method string")
    found = linking.match_references(refs, config)
    pairs = {tuple(r[:6]): (r["rank"], r.n_from, r.n_to) for r in found.select(
        "type", "from_project", "from_identifier", "from_direction", "to_project", "to_identifier", "rank", "n_from", "n_to").collect()}
    assert pairs == matched(rows) and found.count() == len(pairs)
    some = linking.match_references(refs, config, project_id="r")
    assert some.count() == sum("r" in (k[1], k[4]) for k in pairs)
    lines = plan_of(found)
    joined = next(i for i, line in enumerate(lines) if "Join Inner" in line)
    assert not any("Aggregate" in line for line in lines[:joined])  # pairs are not shuffled again


def test_members_read_the_matches_once(spark):
    refs = spark.createDataFrame(REFS, "type string, identifier string, direction string, node_id string, project_id string")
    rows = [(*key[:3], *key[4:]) for key in matched(REFS)]
    matches = spark.createDataFrame(rows, "type string, from_project string, from_identifier string, to_project string, to_identifier string")
    found = linking.link_members(matches, refs)
    made, taken = {r[:3] for r in rows}, {(r[0], *r[3:]) for r in rows}
    want = sorted((kind, project, name, role, node) for kind, name, direction, node, project in REFS for role, ends, other in (
        ("producer", made, "consume"), ("consumer", taken, "produce")) if direction != other and (kind, project, name) in ends)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert sum("LogicalRDD" in line for line in plan_of(found)) == 2


def test_files_are_classified_once(spark):
    rows = [("r1", f"src/core/f{i}.py", i, 0, False) for i in range(30)] + [("r1", "src/auth/a.py", 1, 1, False), ("r1", "dist/x.js", 9, 9, False), (None, "src/auth/a.py", 1, 1, False), ("r2", None, 1, 1, False)]
    found = review.prioritize_files(spark.createDataFrame(rows, "review_id string, path string, lines_added long, lines_deleted long, is_binary boolean"), 5)
    got = {(r.review_id, r.path): r.to_review for r in found.collect()}
    assert len(got) == len(rows)
    assert {k for k, chosen in got.items() if chosen} == {("r1", "src/auth/a.py"), *(("r1", f"src/core/f{i}.py") for i in (29, 28, 27, 26))}
    assert not any("RLIKE" in line for line in plan_of(found))


def test_links_between_projects_are_read_once(spark):
    nodes = spark.createDataFrame([("a", "Function", "f", "x.py"), ("b", "Function", "g", "y.py"), ("c", "Function", "h", "x.py"), ("d", "ApiEndpoint", "e", "z.py")], "id string, type string, name string, file string")
    rows = [("a", "b", "CALLS", False), ("a", "b", "USES", True), ("a", "c", "USES", True), ("a", "a", "USES", True), ("a", "b", "USES", True), ("b", None, "USES", True), ("d", "nowhere", "USES", True)]
    impact = mesh.impact_analysis(nodes, spark.createDataFrame(rows, "from_id string, to_id string, type string, cross_project boolean"), nodes.select("file"))
    got = {r.file: (r.affected_files, r.callers, r.callees, r.endpoints, r.links) for r in impact.collect()}
    assert got == {"x.py": (0, 0, 1, 0, 3), "y.py": (1, 1, 0, 0, 2), "z.py": (0, 0, 0, 1, 1)}
    assert sum("cross_project" in line and "LogicalRDD" in line for line in plan_of(impact)) == 1


def test_parts_of_a_file_are_sized_without_sorting_its_rows(spark):
    nodes = spark.createDataFrame([(f"n{i}", "Function", f"f{i}", i, i, "p", f"{i % 3}.py") for i in range(30)] + [("n0", "Class", "twice", 1, 1, "p", "0.py"), ("bare", "Class", "c", 1, 1, "p", None)],
                                  "id string, type string, name string, line_start int, line_end int, project_id string, file string")
    edges = spark.createDataFrame([(f"n{i % 30}", f"n{i}", "CALLS") for i in range(100)] + [(None, "x", "CALLS"), ("nowhere", "x", "CALLS")], "from_id string, to_id string, type string")
    found = store.export_mesh(nodes, edges, part_size=10)
    got = defaultdict(lambda: [0, 0, 0])
    for r in found.collect():
        sums = got[r.file]
        got[r.file] = [sums[0] + len(r.nodes), sums[1] + len(r.edges), max(sums[2], r.part)]
    drawn = lambda k: sum(2 if i % 30 == 0 else 1 for i in range(100) if i % 30 % 3 == k)
    assert {file: sums[:2] for file, sums in got.items()} == {"0.py": [11, drawn(0)], "1.py": [10, drawn(1)], "2.py": [10, drawn(2)]}
    assert all(sums[2] < -(-(sums[0] + sums[1]) // 10) for sums in got.values())
    assert "ShuffledHashJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_levels_of_a_configuration_are_read_once(spark):
    found = context.flatten_config(spark.createDataFrame([("p", '{"a":{"x":1,"l":[1]},"x":"top","y":{"x":"last"},"n":null,"e":{}}'), ("p", "broken"), ("p", None), ("q", "{}")], "project_id string, content string"))
    assert {(r.project_id, r.name, r.value) for r in found.collect()} == {("p", "a.x", "1"), ("p", "x", "last"), ("p", "y.x", "last")}
    assert sum("LogicalRDD" in line for line in plan_of(found)) == 2


def test_configurations_are_spread_over_tasks(spark, tmp_path, monkeypatch):
    spark.range(300).selectExpr("id AS p_partkey", "cast(id AS int) AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    given, flatten = [], context.flatten_config
    monkeypatch.setattr(context, "flatten_config", lambda configs: given.append(configs) or flatten(configs))
    assert catalog.QUERIES["flatten_config"](spark, str(tmp_path)).count() == 9 * 300
    assert given[0].withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1


def test_the_mesh_before_a_sync_is_joined_once(spark, tmp_path, monkeypatch):
    tables = {"nation": "id AS n_nationkey, 'n' || id AS n_name", "customer": "id AS c_custkey, 'c' || id AS c_name, id % 2 AS c_nationkey, 'm' AS c_mktsegment",
              "supplier": "id AS s_suppkey, 's' || id AS s_name, id % 2 AS s_nationkey", "part": "id AS p_partkey, 'b' || id % 3 AS p_brand, cast(id AS int) AS p_size",
              "orders": "id AS o_orderkey, id % 7 AS o_custkey", "lineitem": "id % 9 AS l_orderkey, id % 5 AS l_partkey, id % 4 AS l_suppkey, 'A' AS l_returnflag"}
    for name, columns in tables.items():
        spark.range(12).selectExpr(*columns.split(", ")).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    texts, sql = [], fixtures.sql
    monkeypatch.setattr(fixtures, "sql", lambda session, folder, text: texts.append(text) or sql(session, folder, text))
    rows = catalog.QUERIES["incremental_sync"](spark, str(tmp_path)).collect()
    assert sum("v_edges" in text for text in texts) == 1
    moved = {r.file for r in rows if r.kind == "node" and r.file.endswith(("/c1.py", "/c3.py", "/c11.py"))}
    assert moved == {"src/moved/c3.py"}  # 1 and 11 are deleted
    assert {r.source for r in rows if r.kind == "edge" and r.file == "src/moved/c3.py"} == {"c3-m", "o3-m"}


def test_tables_are_joined_and_merged_a_slice_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "SLICE_ROWS", 25)
    left = [(f"k{i % 9}" if i % 7 else None, i) for i in range(60)]
    right = [(f"k{i % 12}" if i % 5 else None, i) for i in range(30)]
    tables = spark.createDataFrame(left, "a string, x int"), spark.createDataFrame(right, "b string, y int")
    for how in ("inner", "left"):
        want = [(a, x, y) for a, x in left for b, y in right if a is not None and a == b]
        want += [(a, x, None) for a, x in left if how == "left" and a not in {b for b, _ in right if b}]
        with store.joined(*tables, ("a", "b"), how, ["a", "x", "y"]) as table:
            assert sorted(map(str, map(tuple, table.collect()))) == sorted(map(str, want))
            assert len({r.f for r in table.select(F.input_file_name().alias("f")).collect()}) > 1

    schema = "id string, name string, file string, line_start int, project_id string, branch string"
    drawn = "from_id string, to_id string, type string, target_name string, in_file boolean, project_id string, branch string, file string"
    nodes = [(f"n{i}", f"f{i % 7}", f"a{i % 5}.py", i, f"p{i % 3}", ("main", "dev/x")[i % 2]) for i in range(60)] + [("gone", "f1", "b.py", 1, "q", "main"), ("stays", "f1", "c.py", 1, "r", "main")]
    edges = [(n[0], "x", "CALLS", f"f{i % 8}", False, n[4], n[5], n[2]) for i, n in enumerate(nodes)]
    paths = [str(tmp_path / name) for name in ("nodes", "edges")]
    old = spark.createDataFrame(nodes, schema), spark.createDataFrame(edges, drawn)
    store.write_branches(old[0], paths[0])
    store.write_branches(store.bind_targets(old[1], old[0]), paths[1])
    files = [(n[4], n[5], "a2.py") for n in nodes[:6]] + [("q", "main", "b.py"), ("r", "main", "b.py"), (None, "main", "b.py"), ("none", "main", "b.py")]
    new = [df.filter("file = 'a2.py'").withColumn(c, F.concat(c, F.lit("-2"))) for df, c in zip(old, ("id", "from_id"))]
    want = [a.filter("file NOT IN ('a2.py', 'b.py')").unionByName(b) for a, b in zip(old, new)]
    writes, write = [], store.write_branches
    monkeypatch.setattr(store, "write_branches", lambda rows, path: writes.append((path, {tuple(r) for r in rows.select(*store.KEYS).distinct().collect()})) or write(rows, path))
    store.merge_mesh_stored(spark, *new, spark.createDataFrame(files, "project_id string, branch string, file string"), *paths)
    for path, rows in zip(paths, (want[0], store.bind_targets(want[1], want[0]))):
        got = spark.read.parquet(path)
        columns = sorted(got.columns)
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, rows.select(columns).collect()))
        parts = [keys for where, keys in writes if where == path]
        assert len(parts) > 2 and sum(map(len, parts)) == len(set.union(*parts)) == 7


def test_nodes_are_opened_once_and_met_a_slice_at_a_time(spark, monkeypatch):
    sources = [("p", f"m{i}.py", "python", f"import os\nclass A{i}(B):\n    def f(self):\n        return g()\nclass A{i}(C): pass\n") for i in range(20)]
    sources += [("p", "r.py", "python", "from fastapi import APIRouter\nrouter = APIRouter()\n@router.get('/x')\nasync def x(q):\n    return 1\n")]
    files = spark.createDataFrame(sources, "project_id string, path string, language string, content string")
    schemas = F.transform(F.array(F.lit("base-python"), F.lit("fastapi")), lambda s: F.struct(s.alias("schema")))
    nodes, edges = extraction.extract_mesh(files.withColumn("schemas", schemas))
    prepared = extraction.with_nodes(extraction.find_matches(files.withColumn("schemas", schemas)))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(nodes) == rows(extraction.extract_nodes(prepared))
    kinds = {r.type: r["count"] for r in edges.groupBy("type").count().collect()}
    assert set(kinds) == {"IMPORTS", "INHERITS", "CALLS", "HANDLED_BY", "CONTAINS"} and kinds["CONTAINS"] == nodes.filter("type <> 'File'").count()
    asked = edges.filter("type = 'CONTAINS'")
    assert not any("Generate" in line for line in plan_of(asked)) and sum("parquet" in line for line in plan_of(asked)) == 1
    assert not any("Generate" in line for line in plan_of(nodes))

    odd = spark.createDataFrame([("bare", "Class", "p", "m1.py"), (None, "Class", "p", "m1.py"), ("bare", "Class", "p", "m2.py"), ("lost", "Class", None, "m2.py")], "id string, type string, project_id string, file string")
    some = nodes.select(odd.columns).unionByName(odd)
    drawn = edges.filter("type <> 'CONTAINS' OR to_id < '8'").select("to_id", "type").unionByName(spark.createDataFrame([(None, "CONTAINS")], "to_id string, type string"))
    whole = rows(extraction.contains_default(some, drawn))
    taken = {r.to_id for r in drawn.filter("type = 'CONTAINS'").collect()}
    home = {r.file: r.id for r in some.filter("type = 'File'").collect()}
    want = sorted((home[r.file], r.id) for r in some.filter("type <> 'File'").collect() if r.project_id and r.id is not None and r.id not in taken)
    monkeypatch.setattr(session, "SLICE_ROWS", 30)
    found = extraction.contains_default(some, drawn)
    assert rows(found) == whole
    assert sorted((r.from_id, r.to_id) for r in found.collect() if r.to_id is not None) == want and sum(r.to_id is None for r in found.collect()) == 1
    assert not any("LeftAnti" in line for line in plan_of(found))  # written down slice by slice
