import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from codeloom.operators import folds, telemetry, trust
from codeloom.plans.ask import ask
from codeloom.sources import files, store
from codeloom.streaming import streams

NODE = "id string, type string, name string, project_id string, branch string, file string, line_start int"


def test_scan_filters_by_size_folder_and_ending(spark, tmp_path):
    for name, text in {"src/a.py": "x = 1\n", "src/big.py": "#" * 200, "node_modules/m/b.js": "1", "c.txt": "no", "d/e.ts": "let a = 1"}.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    rows = {r.path: r.content for r in files.scan_source_files(spark, str(tmp_path), "p", max_bytes=100).collect()}
    assert rows == {"src/a.py": "x = 1\n", "d/e.ts": "let a = 1"}


def test_nested_documents(spark, tmp_path):
    document = {"project_id": "p", "results": [{"file": "a.py", "nodes": [{"id": "1", "type": "Class", "name": "A", "properties": {"bases": "B"},
                "source": {"file": "a.py", "line_start": 1, "line_end": 3}, "extraction": {"tier": 1, "confidence": 0.8}}],
                "edges": [{"id": "e", "type": "CALLS", "from_id": "1", "to_id": "2"}]}],
                "cross_project_links": [{"type": "queue", "from_node_id": "1", "to_node_id": "9", "confidence": 0.9, "resolution_method": "literal"}]}
    (tmp_path / "x.json").write_text(json.dumps(document, indent=1))
    read = files.read_extractions(spark, str(tmp_path / "x.json"))
    (node,) = files.extraction_nodes(read).collect()
    assert (node.id, node.file, node.line_end, node.properties) == ("1", "a.py", 3, {"bases": "B"})
    assert [(e.from_id, e.to_id) for e in files.extraction_edges(read).collect()] == [("1", "2")]
    (link,) = files.extraction_links(read).collect()
    assert (link.type, link.cross_project) == ("CONNECTS_VIA_QUEUE", True)


def test_replace_and_merge_touch_only_their_partitions(spark, tmp_path):
    path = str(tmp_path / "nodes")
    rows = [("1", "F", "a", "p", "main", "x", 1), ("2", "F", "b", "p", "main", "y", 1), ("3", "F", "c", "q", "main", "z", 1), ("4", "F", "d", "p", "dev", "x", 1)]
    store.write_branches(spark.createDataFrame(rows, NODE), path)
    new = spark.createDataFrame([("5", "F", "a2", "p", "main", "x", 2)], NODE)
    gone = spark.createDataFrame([("p", "main", "y"), ("q", "main", "z")], "project_id string, branch string, file string")
    for _ in range(2):  # a second run changes nothing
        store.merge_stored(spark, new, gone, path)
        assert {r.id for r in spark.read.parquet(path).collect()} == {"5", "4"}
    (report,) = store.replace_project_branch(spark, spark.createDataFrame([("7", "F", "n", "p", "dev", "w", 1)], NODE), path).collect()
    assert (report.removed, report.inserted) == (1, 1)
    assert {r.id for r in spark.read.parquet(path).collect()} == {"5", "7"}
    assert store.clear_stored_project(spark, "p", path) == 2


FILE = "project_id string, branch string, file string, line_start int, name string, calls array<string>"


def mesh_of(sources):
    """Nodes and edges of files given as functions and the names they call."""
    nodes = sources.select(F.concat_ws(":", "branch", "file", "name", "line_start").alias("id"), F.lit("Function").alias("type"), "name", "project_id", "branch", "file", "line_start")
    here = sources.groupBy("project_id", "branch", "file").agg(F.map_from_entries(F.collect_set(F.struct("name", F.concat_ws(":", "branch", "file", "name", "line_start")))).alias("own"))
    calls = sources.select("project_id", "branch", "file", F.concat_ws(":", "branch", "file", "name", "line_start").alias("from_id"), F.explode("calls").alias("target_name"))
    known = F.try_element_at("own", F.col("target_name"))
    edges = calls.join(here, ["project_id", "branch", "file"]).select(
        "from_id", F.coalesce(known, "target_name").alias("to_id"), F.lit("CALLS").alias("type"), "target_name", known.isNotNull().alias("in_file"), "project_id", "branch", "file")
    return nodes, edges


def test_incremental_sync_equals_a_full_extraction(spark, tmp_path):
    nodes_path, edges_path, feed = (str(tmp_path / n) for n in ("nodes", "edges", "feed"))
    old = [("p", "main", "a.py", 1, "one", ["two", "three"]), ("p", "main", "b.py", 1, "two", ["two", "one", "nowhere"]), ("p", "main", "c.py", 1, "three", ["one"]),
           ("p", "main", "c.py", 9, "four", ["three"]), ("p", "main", "d.py", 1, "five", ["four", "later"]), ("p", "dev", "a.py", 1, "one", ["three"]), ("q", "main", "x.py", 1, "one", ["two"])]
    # b.py goes, c.py moves its functions down, d.py is renamed, e.py is new, x.py empties its project.
    new = [("p", "main", "a.py", 1, "one", ["two", "three"]), ("p", "main", "c.py", 5, "three", ["one", "two"]), ("p", "main", "c.py", 15, "four", ["three"]),
           ("p", "main", "moved.py", 1, "five", ["four", "later"]), ("p", "main", "e.py", 3, "later", ["one"]), ("p", "dev", "a.py", 1, "one", ["three"])]
    sources = spark.createDataFrame(old, FILE)
    nodes, edges = mesh_of(sources)
    store.write_branches(nodes, nodes_path)
    store.write_branches(store.bind_targets(edges, nodes), edges_path)
    want_nodes, want_edges = mesh_of(spark.createDataFrame(new, FILE))
    want = [{tuple(r) for r in df.select(sorted(df.columns)).collect()} for df in (want_nodes, store.bind_targets(want_edges, want_nodes))]

    def extract(wanted):
        kept = spark.createDataFrame(new, FILE).join(wanted.withColumnRenamed("path", "file"), ["project_id", "branch", "file"], "left_semi")
        return mesh_of(kept)

    lines = [[("p", "main", "D\tb.py"), ("p", "main", "M\tc.py")], [("p", "main", "R090\td.py\tmoved.py"), ("p", "main", "A\te.py"), ("q", "main", "D\tx.py")]]
    for k, batch in enumerate([*lines, lines[0]]):  # a batch that comes twice changes nothing
        spark.createDataFrame(batch, "project_id string, branch string, line string").coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema("project_id string, branch string, line string").parquet(feed)
        streams.incremental_sync(stream, extract, nodes_path, edges_path, str(tmp_path / "ck")).awaitTermination()
        if k:
            got = [spark.read.parquet(path) for path in (nodes_path, edges_path)]
            assert [{tuple(r) for r in df.select(sorted(df.columns)).collect()} for df in got] == want


def in_batches(spark, tmp_path, name, rows, schema, start):
    feed = str(tmp_path / f"{name}-feed")
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(feed)
        start(spark.readStream.schema(schema).parquet(feed), str(tmp_path / name), str(tmp_path / f"{name}-ck")).awaitTermination()
    return spark.read.schema(schema).parquet(feed)


def test_requests_are_paired_however_late_their_end(spark, tmp_path):
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    call, end, error = "mcp.tool.called", "mcp.tool.result", "mcp.tool.error"
    rows = [[("slow", call, at(0), "{}"), ("fast", call, at(1), "{}"), ("fast", end, at(2), "{}"), ("early", end, at(5), '{"n":"1"}'), ("never", call, at(0), "{}"), ("x", "other", at(0), "{}")],
            [("slow", error, at(900), '{"e":"1"}'), ("early", call, at(4), "{}"), ("again", call, at(10), "{}"), ("again", end, at(20), "{}"), ("again", end, at(3), "{}")],
            [("again", call, at(1), "{}"), ("lost", end, at(1), "{}"), ("fast", end, at(9), "{}")]]
    events = in_batches(spark, tmp_path, "pairs", rows, "request_id string, event_type string, ts timestamp, data string", streams.paired_stream)
    got = {tuple(map(str, r)) for r in streams.paired_totals(spark, str(tmp_path / "pairs")).collect()}
    assert got == {tuple(map(str, r)) for r in telemetry.pair_events(events).collect()} and len(got) == 4
    assert len(list((tmp_path / "pairs" / "open").iterdir())) == 2


def test_feedback_in_any_order_of_arrival(spark, tmp_path):
    rng = random.Random(8)
    kinds = ["helpful", "not_helpful", "misleading", "outdated"]
    rows = [(f"b{k % 3}" if k % 5 else "b|4", k, datetime(2024, 1, 1) + timedelta(hours=5 * k), rng.choice(kinds)) for k in range(120)]
    rng.shuffle(rows)
    batches = [rows[:50], rows[50:90], rows[90:]]
    outcomes = in_batches(spark, tmp_path, "log", batches, "belief_id string, event_id long, ts timestamp, outcome string", streams.feedback_stream)
    beliefs = spark.createDataFrame([(f"b{k}", 20 + 30 * k, k) for k in range(3)] + [("b|4", 90, 0), ("none", 50, 2)], "id string, conv_pct int, usage_count int")
    got = streams.current_convictions(beliefs, spark.read.parquet(str(tmp_path / "log" / "maps"))).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in folds.feedback_fold(beliefs, outcomes).collect()}


def test_counter_log_is_exact_over_batches(spark, tmp_path):
    feed, log, ck = (str(tmp_path / n) for n in ("feed", "log", "ck"))
    schema = "schema_id string, pattern_name string, result string"
    for results in (["verified"] * 3, ["corrected", "verified"]):
        spark.createDataFrame([("s", "p", r) for r in results], schema).coalesce(1).write.mode("append").parquet(feed)
        streams.verification_stream(spark.readStream.schema(schema).parquet(feed), log, ck).awaitTermination()
    (row,) = streams.trust_totals(spark.read.parquet(log)).collect()
    assert (row.total, row.verified, row.corrected, row.trust_level) == (5, 4, 1, "low")


def test_hash_samples_are_stable(spark):
    rows = spark.range(20000).select(F.col("id"), F.lit("s").alias("schema_id"), F.lit("p").alias("pattern_name"))
    scores = spark.createDataFrame([("s", "p", 0.2)], "schema_id string, pattern_name string, sample_rate double")
    first = trust.verification_sample(rows, scores)
    assert 3600 < first.count() < 4400
    assert first.exceptAll(trust.verification_sample(rows.repartition(7), scores)).count() == 0
    assert trust.verification_sample(rows, scores.filter("false")).count() == 20000


def test_questions_are_routed(spark):
    nodes = spark.createDataFrame([("1", "Function", "f", "p", "a.py", 1), ("2", "Function", "g", "p", "a.py", 5)],
                                  "id string, type string, name string, project_id string, file string, line_start int").withColumn("properties", F.create_map().cast("map<string,string>"))
    edges = spark.createDataFrame([("1", "2", "CALLS", False)], "from_id string, to_id string, type string, cross_project boolean")
    assert [r.caller_id for r in ask(nodes, edges, "who calls g").collect()] == ["1"]
    assert [r.callee_id for r in ask(nodes, edges, "what does it call f").collect()] == ["2"]
    assert ask(nodes, edges, "functions named g").count() == 1 and ask(nodes, edges, "file a.py").count() == 2
