import itertools
import random

from pyspark.sql import functions as F

from codeloom.operators import graph, linking, memory, mesh


def rank_of(p, c, config):
    def resolve(ref):
        text = ref[1]
        if "$" in text:
            for (project, name), value in config.items():
                if project == ref[4]:
                    text = text.replace("${" + name + "}", value)
        return text

    def queue(text):
        return text.split(":")[-1] if text.startswith("arn:aws:sqs:") else text.split(".")[-1] if "." in text else text

    a, b = p[1], c[1]
    ra, rb = resolve(p), resolve(c)
    tests = [a == b, a.lower() == b.lower(), ra == rb, ra.lower() == rb.lower(), queue(a) == queue(b)]
    return next((i + 1 for i, t in enumerate(tests) if t), None)


def test_matches_equal_the_pair_loop_with_hot_identifier(spark):
    rng = random.Random(3)
    names = ["q", "Q", "arn:aws:sqs:x:q", "${NAME}", "t.q", "other", "OTHER"]
    refs = [("queue", "q" if rng.random() < 0.4 else rng.choice(names), rng.choice(["produce", "consume", "both"]), f"n{i}", f"p{rng.randrange(3)}") for i in range(60)]
    config = {("p0", "NAME"): "q", ("p1", "NAME"): "OTHER"}
    rows = spark.createDataFrame(refs, "type string, identifier string, direction string, node_id string, project_id string")
    settings = spark.createDataFrame([(p, n, v, "env") for (p, n), v in config.items()], "project_id string, name string, value string, method string")
    want = {}
    for p, c in itertools.product(refs, refs):
        if p[2] in ("produce", "both") and c[2] in ("consume", "both") and p[4] != c[4]:
            rank = rank_of(p, c, config)
            if rank:
                key = (p[4], p[1], p[2], c[4], c[1], rank)
                want[key] = want.get(key, 0) + 1
    got = {(r.from_project, r.from_identifier, r.from_direction, r.to_project, r.to_identifier, r["rank"]): r.n_pairs
           for r in linking.match_references(rows, settings).collect()}
    assert got == want


def test_closure_survives_cycles(spark):
    steps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {(r.id, r.distance) for r in graph.closure(steps, spark.createDataFrame([("a",)], "id string"), 5).collect()}
    assert got == {("b", 1), ("c", 2), ("d", 3)}


def test_shortest_path_through_hubs(spark):
    beliefs = spark.createDataFrame([("b1", "alpha words here", "d1", None), ("b2", "betas words", "d1", "c"), ("b3", "gamma stuff", "d2", "c"), ("b4", "delta thing", "d3", None)],
                                    "id string, content string, domain string, category string")
    links = memory.belief_links(beliefs)
    path = lambda a, b, n: [r.node for r in graph.shortest_path(links, a, b, n).orderBy("position").collect()]
    assert path("b1", "b3", 4) == ["b1", "b2", "b3"]
    assert path("b1", "entity-gamma", 4) == ["b1", "b2", "b3", "entity-gamma"]
    assert path("b1", "entity-gamma", 3) == [] and path("b1", "b4", 4) == [] and path("b1", "b1", 4) == ["b1"]


def test_call_graph_budget(spark):
    calls = spark.createDataFrame([("r", f"x{i}") for i in range(9)] + [("x0", "y")], "caller string, callee string")
    rows = graph.call_graph(calls, "r", 6).collect()
    assert {r.name for r in rows} == {"r", "x0", "x1", "x2", "x3", "x4"}


def test_pair_counts_equal_pairs(spark):
    rng = random.Random(5)
    rows = [(f"b{i}", rng.choice(["d1", "d1", "d2", None, ""]), rng.choice(["c1", "c2", None])) for i in range(40)]
    beliefs = spark.createDataFrame(rows, "id string, domain string, category string")
    want = {}
    for a, b in itertools.permutations(rows, 2):
        same = bool(a[1]) and a[1] == b[1]
        other = not same and bool(a[2]) and a[2] == b[2]
        d, c = want.get(a[0], (0, 0))
        want[a[0]] = (d + same, c + other)
    assert {r.id: (r.same_domain, r.same_category) for r in memory.belief_pairs(beliefs).collect()} == want


def test_overlap_join_equals_loop(spark):
    from codeloom.functions.scaling import overlap_join

    rng = random.Random(7)
    spans = [(i, "f", a := rng.randrange(1, 3000), a + rng.choice([0, 1, 7, 500, 2999])) for i in range(150)]
    probes = [(i, "f", a := rng.randrange(1, 3500), a + rng.choice([0, 3, 40])) for i in range(150)]
    left = spark.createDataFrame(spans, "s int, file string, a int, b int")
    right = spark.createDataFrame(probes, "p int, file string, c int, d int")
    got = [(r.s, r.p) for r in overlap_join(left, right, ["file"], ("a", "b"), ("c", "d")).collect()]
    want = [(s[0], p[0]) for s in spans for p in probes if s[2] <= p[3] and s[3] >= p[2]]
    assert sorted(got) == sorted(want)


def test_diff_is_empty_for_equal_branches(spark):
    nodes = spark.createDataFrame([("T", "n", "f", 1), ("T", "n", "f", 2), ("T", "m", "f", 1)], "type string, name string, file string, line_start int")
    assert mesh.mesh_diff(nodes, nodes, ["line_start"]).count() == 0
    moved = nodes.withColumn("line_start", F.col("line_start") + 1)
    assert {r.change for r in mesh.mesh_diff(nodes, moved, ["line_start"]).collect()} == {"changed"}


def test_files_reached_by_bitmaps_and_rows_equal_sets(spark):
    """Hot names as bitmaps, rare ones as rows, a name held by nobody, null files, one file wanting both kinds."""
    rng = random.Random(5)
    held = {(name, f"f{i}") for i in range(400) for name in ("get", "set") if rng.random() < 0.8}
    held |= {(f"n{rng.randrange(60)}", f"f{rng.randrange(500)}") for _ in range(300)} | {("n1", None)}
    wanted = {(f"f{rng.randrange(40)}", rng.choice(["get", "set", "nobody", *[f"n{k}" for k in range(60)]])) for _ in range(150)}
    wanted |= {("only-rare", "n1"), ("only-none", "nobody"), ("only-hot", "get")}
    want = {}
    for file in {f for f, _ in wanted}:
        names = {n for f, n in wanted if f == file}
        reached = {f for n, f in held if n in names and f is not None}
        if reached:
            want[file] = len(reached)
    asked = spark.createDataFrame(sorted(wanted), "file string, name string")
    holds = spark.createDataFrame(sorted(held, key=str), "name string, file string")
    for few in (0, 5, 1000):
        assert {r.file: r.reached for r in mesh.files_reached(asked, holds, few).collect()} == want


def test_files_reached_numbers_go_on_in_further_bitmaps(spark, monkeypatch):
    monkeypatch.setattr(mesh, "BITS", 8)
    asked = spark.createDataFrame([("a", "get"), ("b", "x")], "file string, name string")
    holds = spark.range(300).select(F.lit("get").alias("name"), F.format_string("f%d", "id").alias("file")).union(
        spark.createDataFrame([("x", "f7")], "name string, file string"))
    assert {(r.file, r.reached) for r in mesh.files_reached(asked, holds, 10).collect()} == {("a", 300), ("b", 1)}
    assert mesh.files_reached(asked, holds.limit(0)).count() == 0


def test_class_hierarchy_both_ways_from_one_closure(spark):
    nodes = spark.createDataFrame([(c, "Interface" if c == "i" else "Class", c.upper()) for c in "abcdi"], "id string, type string, name string")
    edges = spark.createDataFrame([("a", "b", "INHERITS"), ("b", "c", "INHERITS"), ("c", "a", "INHERITS"), ("d", "i", "IMPLEMENTS"), ("i", "b", "INHERITS")], "from_id string, to_id string, type string")
    steps = {}
    for x, y, _ in edges.collect():
        steps.setdefault(x, set()).add(y)
    want = set()
    for depth in (1, 5):
        want = set()
        for start in "abcdi":
            seen, frontier = {start}, {start}
            for distance in range(1, depth + 1):
                frontier = {y for x in frontier for y in steps.get(x, ())} - seen
                seen |= frontier
                want |= {(start, y, "up", distance) for y in frontier if start != "i"} | {(y, start, "down", distance) for y in frontier if y != "i"}
        rows = graph.class_hierarchy(nodes, edges, depth=depth).collect()
        assert {(r.class_id, r.related_id, r.direction, r.distance) for r in rows} == want and len(rows) == len(want)
    for way in ("up", "down"):
        for name in (None, "B"):
            rows = graph.class_hierarchy(nodes, edges, name, way).collect()
            assert {(r.class_id, r.related_id, r.direction, r.distance) for r in rows} == {w for w in want if w[2] == way and (name is None or w[0] == "b")}
