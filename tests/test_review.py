from pyspark.sql import functions as F

from codeloom.operators import review

DIFF = """diff --git a/src/a.py b/src/a.py
index 1..2 100644
--- a/src/a.py
+++ b/src/a.py
@@ -1,2 +1,3 @@ def f
 x
-y
+z
+w
@@ -10 +11 @@
-q
+r
diff --git a/old.py b/new.py
rename from old.py
rename to new.py
diff --git a/i.png b/i.png
new file mode 100644
Binary files /dev/null and b/i.png differ
"""


def files_of(spark, text):
    return review.diff_files(spark.createDataFrame([("d", text)], "diff_id string, diff string"))


def test_diff_files_and_hunks(spark):
    files = files_of(spark, DIFF)
    rows = {r.path: r for r in files.collect()}
    assert rows["src/a.py"].status == "modified" and rows["src/a.py"].old_path is None
    assert (rows["src/a.py"].lines_added, rows["src/a.py"].lines_deleted) == (3, 2)
    assert rows["new.py"].status == "renamed" and rows["new.py"].old_path == "old.py"
    assert rows["i.png"].status == "added" and rows["i.png"].is_binary
    hunks = review.diff_hunks(files).orderBy("hunk_no").collect()
    assert [(h.old_start, h.old_count, h.new_start, h.new_count, h.header) for h in hunks] == [(1, 2, 1, 3, "def f"), (10, 1, 11, 1, "")]
    assert hunks[0].content.split("\n") == ["@@ -1,2 +1,3 @@ def f", " x", "-y", "+z", "+w"]


def hunk(start, header, size):
    return f"@@ -{start},1 +{start},1 @@ {header}\n" + "\n".join("+" + "v" * 30 for _ in range(size))


def diff_of(path, hunks):
    return f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n" + "\n".join(hunks) + "\n"


def chunks_of(spark, path, hunks, limit):
    return review.chunk_hunks(files_of(spark, diff_of(path, hunks)), limit).orderBy("chunk_no").collect()


def test_small_diff_is_one_chunk(spark):
    (only,) = chunks_of(spark, "a.py", [hunk(1, "", 1), hunk(9, "", 1)], 400)
    assert only.n_hunks == 2 and only.context_before == ""


def test_chunks_start_at_definitions_and_carry_context(spark):
    rows = chunks_of(spark, "a.py", [hunk(1, "", 4), hunk(9, "def g():", 4), hunk(20, "", 2)], 60)
    assert [r.n_hunks for r in rows] == [1, 1, 1] or [r.n_hunks for r in rows] == [1, 2]
    assert rows[0].context_after.startswith("@@ -9,1") and rows[0].context_before == ""
    assert rows[1].context_before.split("\n")[-1].startswith("+v")
    assert sum(r.n_hunks for r in rows) == 3


def greedy(tokens, limit):
    """Chunking of an unknown language, hunk by hunk."""
    chunks, current, held = [], [], 0
    for t in tokens:
        if t > limit:
            if current:
                chunks.append(current)
            chunks.append([t])
            current, held = [], 0
            continue
        if held + t > limit and current:
            chunks.append(current)
            current, held = [], 0
        current.append(t)
        held += t
    return chunks + ([current] if current else [])


def test_unknown_language_leaves_oversized_hunks_alone(spark):
    sizes = [2, 3, 40, 1, 1, 9, 50, 2, 2]
    hunks = [hunk(i * 50 + 1, "", n) for i, n in enumerate(sizes)]
    rows = chunks_of(spark, "a.unknown", hunks, 100)
    tokens = [len(h) // 4 for h in hunks]
    tokens[-1] = (len(hunks[-1]) + 1) // 4  # the document's last newline
    expected = greedy(tokens, 100)
    assert [r.estimated_tokens for r in rows] == [sum(c) for c in expected]
    assert all(r.context_before == r.context_after == "" for r in rows)


def test_classification_order(spark):
    paths = [("src/auth/x.py", 1, "critical"), ("yarn.lock", 999, "noise"), ("dist/auth/x.js", 5, "noise"), ("tests/test_a.py", 51, "important"),
             ("tests/test_a.py", 50, "minor"), ("README", 2, "minor"), ("src/api/x.py", 1, "important"), ("lib/x.py", 60, "important"), ("lib/x.py", 3, "minor"),
             ("pkg/config.py", 1, "critical")]
    rows = spark.createDataFrame([(p, n, 0, False, w) for p, n, w in paths], "path string, lines_added long, lines_deleted long, is_binary boolean, want string")
    assert review.classify_files(rows).filter(F.col("want") != F.col("file_class")).count() == 0


def test_prioritize_keeps_all_critical_files(spark):
    rows = [("r", f"auth/{i}.py", 1, 0, False) for i in range(25)] + [("r", f"api/{i}.py", i, 0, False) for i in range(5)]
    out = review.prioritize_files(spark.createDataFrame(rows, "review_id string, path string, lines_added long, lines_deleted long, is_binary boolean"))
    assert out.count() == 30 and out.filter("to_review").count() == 25 and out.filter("to_review AND file_class <> 'critical'").count() == 0
