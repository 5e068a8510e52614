"""Change review: diffs, hunks, triage, chunks, issues, assessments.

A diff document is one row, so it is cut inside its row with array functions;
nothing is shuffled to parse it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.scaling import any_of, top_k
from codeloom.session import kept

# File classes by path, checked in the order of classify().
NOISE = [
    r"\.lock$", r"lock\.json$", r"\.min\.(js|css)$", r"(^|/)dist/", r"(^|/)build/", r"(^|/)node_modules/",
    r"(^|/)vendor/", r"(^|/)\.git/", r"(^|/)__pycache__/", r"\.pyc$", r"(^|/)coverage/", r"\.map$",
    r"(^|/)\.next/", r"(^|/)\.nuxt/",
]
CRITICAL_PATHS = [
    r"(^|/)auth/", r"(^|/)authentication/", r"(^|/)crypto/", r"(^|/)security/", r"(^|/)secrets/",
    r"(^|/)password", r"(^|/)credentials", r"(^|/)oauth", r"(^|/)jwt", r"(^|/)api[-_]?key",
]
CRITICAL_FILES = [
    r"\.env(\..+)?$", r"config\.(py|ts|js|json|yaml|yml)$", r"settings\.(py|ts|js|json|yaml|yml)$",
    r"secrets\.(py|ts|js|json|yaml|yml)$", r"credentials\.(py|ts|js|json|yaml|yml)$", r"package\.json$",
    r"pyproject\.toml$", r"requirements\.txt$", r"Gemfile$", r"Cargo\.toml$", r"go\.mod$",
    r"docker-compose\.ya?ml$", r"Dockerfile$",
]
TESTS = [r"(^|/)tests?/", r"(^|/)__tests__/", r"\.test\.(ts|tsx|js|jsx)$", r"\.spec\.(ts|tsx|js|jsx)$",
         r"_test\.(py|go)$", r"test_.*\.py$"]
DOCS = [r"\.md$", r"\.rst$", r"\.txt$", r"(^|/)docs?/", r"README", r"CHANGELOG", r"LICENSE"]
IMPORTANT = [r"(^|/)api/", r"(^|/)routes/", r"(^|/)endpoints/", r"(^|/)handlers/", r"(^|/)controllers/",
             r"(^|/)services/", r"(^|/)models/", r"(^|/)schemas/", r"(^|/)database/", r"(^|/)migrations?/"]

# Domain by path part, first hit wins.
DOMAINS = {
    "security": ["auth", "security", "crypto", "password", "oauth", "jwt", "token"],
    "api": ["api", "routes", "endpoints", "handlers", "controllers"],
    "database": ["database", "db", "models", "schema", "migration", "query"],
    "testing": ["test", "spec", "__tests__", "fixtures"],
    "ui": ["components", "views", "pages", "templates", "frontend"],
    "infrastructure": ["docker", "k8s", "kubernetes", "terraform", "ci", "cd"],
}

# What ties an issue to a principle.
PRINCIPLE_KEYWORDS = [
    "error handling", "security", "sql injection", "validation", "authentication", "authorization",
    "logging", "testing", "documentation",
]

# Definition starts per language, and language by file ending.
BOUNDARIES = {
    "python": [r"^\s*(async\s+)?def\s+\w+", r"^\s*class\s+\w+"],
    "javascript": [r"^\s*(async\s+)?function\s+\w+", r"^\s*class\s+\w+",
                   r"^\s*(const|let|var)\s+\w+\s*=\s*(async\s+)?\(", r"^\s*(const|let|var)\s+\w+\s*=\s*function"],
    "typescript": [r"^\s*(async\s+)?function\s+\w+", r"^\s*class\s+\w+",
                   r"^\s*(const|let|var)\s+\w+\s*=\s*(async\s+)?\(", r"^\s*(export\s+)?(const|let|var)\s+\w+"],
    "go": [r"^\s*func\s+", r"^\s*type\s+\w+\s+struct"],
    "rust": [r"^\s*(pub\s+)?fn\s+", r"^\s*(pub\s+)?struct\s+", r"^\s*(pub\s+)?impl\s+"],
    "java": [r"^\s*(public|private|protected)?\s*(static)?\s*\w+\s+\w+\s*\(",
             r"^\s*(public|private|protected)?\s*(abstract)?\s*class\s+"],
}
ENDINGS = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
           ".go": "go", ".rs": "rust", ".java": "java"}

CHARS_PER_TOKEN = 4
INPUT_SHARE, INPUT_CENTS, OUTPUT_CENTS = 0.6, 300, 1500


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / CHARS_PER_TOKEN).cast("bigint")


# ------------------------------------------------------------------ diffs


def _chop(parts: Column) -> Column:
    """Drop the newline that ends every part but the last."""
    return F.transform(parts, lambda p, i: F.when(
        (i < F.size(parts) - 1) & p.endswith("\n"), F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p))


def diff_files(diffs: DataFrame) -> DataFrame:
    """File sections of diff documents (diff_id, diff), hunks kept as an array."""
    sections = F.filter(F.split("diff", r"(?m)^(?=diff --git a/.+ b/.+$)"), lambda s: s.rlike(r"^diff --git a/.+ b/.+"))
    each = diffs.select("diff_id", F.posexplode(_chop(sections)).alias("file_no", "section"))
    lines = F.split("section", "\n")
    head = F.get(lines, F.lit(0))
    marks = F.filter(lines, lambda x: x.rlike(r"^(new file mode|deleted file mode|rename from .)"))
    last = F.element_at(marks, -1)
    renames = F.filter(lines, lambda x: x.rlike(r"^rename from ."))
    old, new = F.regexp_extract(head, r"^diff --git a/(.+) b/(.+)$", 1), F.regexp_extract(head, r"^diff --git a/(.+) b/(.+)$", 2)
    parts = F.split("section", r"(?m)^(?=@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@)")
    hunks = F.when(F.size(parts) > 1, _chop(F.slice(parts, 2, 1_000_000_000))).otherwise(F.array().cast("array<string>"))
    hunks = F.when(parts[0] == "", hunks).otherwise(hunks)
    parsed = each.select(
        "diff_id", "file_no",
        new.alias("path"),
        F.when(F.size(renames) > 0, F.regexp_extract(F.element_at(renames, -1), r"^rename from (.+)$", 1))
        .when(old != new, old).alias("old_path"),
        F.when(F.size(marks) == 0, "modified").when(last.startswith("new"), "added")
        .when(last.startswith("deleted"), "deleted").otherwise("renamed").alias("status"),
        F.exists(lines, lambda x: x.startswith("Binary files")).alias("is_binary"),
        F.concat("section", F.lit("\n")).alias("raw_diff"),
        hunks.alias("hunks"),
    )
    body = F.flatten(F.transform("hunks", lambda h: F.split(h, "\n")))
    return parsed.select(
        "*",
        F.size(F.filter(body, _is_added)).cast("bigint").alias("lines_added"),
        F.size(F.filter(body, _is_deleted)).cast("bigint").alias("lines_deleted"),
    )


def _is_added(line: Column) -> Column:
    return line.startswith("+") & ~line.startswith("+++")


def _is_deleted(line: Column) -> Column:
    return line.startswith("-") & ~line.startswith("---")


def diff_hunks(files: DataFrame) -> DataFrame:
    """One row per hunk of :func:`diff_files`."""
    pattern = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)"
    each = files.select("diff_id", "file_no", "path", F.posexplode("hunks").alias("hunk_no", "content"))
    part = lambda i: F.regexp_extract("content", pattern, i)
    count = lambda i: F.coalesce(F.nullif(part(i), F.lit("")), F.lit("1")).try_cast("int")
    return each.select(
        "diff_id", "file_no", "path", "hunk_no",
        part(1).try_cast("int").alias("old_start"), count(2).alias("old_count"),
        part(3).try_cast("int").alias("new_start"), count(4).alias("new_count"),
        F.trim(part(5)).alias("header"), "content",
    )


def diff_stats(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count("*").alias("files_changed"), F.sum("lines_added").alias("additions"), F.sum("lines_deleted").alias("deletions")
    )


def formatting_only(files: DataFrame) -> DataFrame:
    """Files whose changed lines are blank for more than 80 %, or that have none."""
    changed = F.filter(F.split("raw_diff", "\n"), lambda x: _is_added(x) | _is_deleted(x))
    blank = F.filter(changed, lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x)), r"\s", "") == "")
    return files.withColumn(
        "is_formatting_only", (F.size(changed) == 0) | (F.size(blank) * 10 > F.size(changed) * 8)
    )


def _boundary_start(path: Column, header: Column, content: Column) -> Column:
    """Does a hunk start a definition, by the language of its file?"""
    hit = F.lit(None).cast("boolean")
    for ending, language in ENDINGS.items():
        rule = "(?m)" + "|".join(f"(?:{p})" for p in BOUNDARIES[language])
        found = header.rlike(rule) | F.substring(content, 1, 200).rlike(rule)
        hit = F.coalesce(hit, F.when(path.endswith(ending), found))
    return hit


def chunk_hunks(files: DataFrame, max_tokens: int = 400, overlap: int = 3) -> DataFrame:
    """Review chunks of at most ``max_tokens`` per file; a hunk is never split.

    The greedy pass is an array fold inside the file's row. A small diff is one
    chunk. With a known language a chunk also starts at every definition and
    carries lines of its neighbours; otherwise an oversized hunk stands alone.
    """
    tokens = estimate_tokens(F.col("raw_diff"))
    header = lambda h: F.trim(F.regexp_extract(h, r"^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@(.*)", 1))
    marked = files.withColumn("_known", F.col("path").rlike("|".join(f"\\{e}$" for e in ENDINGS))).withColumn(
        "_hunks", F.transform("hunks", lambda h: F.struct(
            h.alias("content"), estimate_tokens(h).alias("tokens"),
            F.coalesce(_boundary_start(F.col("path"), header(h), h), F.lit(False)).alias("starts"))),
    )
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("bigint").alias("tokens"), F.lit(0).alias("held"),
                     F.array().cast("array<int>").alias("ids"))

    def step(acc: Column, h: Column) -> Column:
        alone = ~F.col("_known") & (h["tokens"] > max_tokens)
        cut = (acc["held"] > 0) & ((F.col("_known") & h["starts"]) | alone | (acc["tokens"] + h["tokens"] > max_tokens))
        mine = acc["chunk"] + cut.cast("int")
        return F.struct(
            F.when(alone, mine + 1).otherwise(mine).alias("chunk"),
            F.when(alone, F.lit(0)).when(cut, h["tokens"]).otherwise(acc["tokens"] + h["tokens"]).cast("bigint").alias("tokens"),
            F.when(alone, F.lit(0)).when(cut, F.lit(1)).otherwise(acc["held"] + 1).alias("held"),
            F.concat(acc["ids"], F.array(mine)).alias("ids"),
        )

    large = marked.filter(tokens > max_tokens).withColumn("_ids", F.aggregate("_hunks", start, step)["ids"])
    zipped = large.withColumn("_z", F.arrays_zip(F.col("_hunks").alias("h"), F.col("_ids").alias("id"))).withColumn(
        "chunk_no", F.explode(F.array_distinct("_ids")))
    members = lambda d: F.filter("_z", lambda z: z["id"] == F.col("chunk_no") + d)
    mine, before, after = members(0), members(-1), members(1)
    tail = F.split(F.element_at(before, -1)["h"]["content"], "\n")
    head = F.split(F.element_at(after, 1)["h"]["content"], "\n")
    chunks = zipped.select(
        "diff_id", "file_no", "path", "chunk_no",
        F.size(mine).alias("n_hunks"),
        F.aggregate(mine, F.lit(0).cast("bigint"), lambda s, z: s + z["h"]["tokens"]).alias("estimated_tokens"),
        F.when(F.col("_known") & (F.size(before) > 0), F.array_join(
            F.slice(tail, F.greatest(F.size(tail) - overlap + 1, F.lit(1)), F.lit(overlap)), "\n")).otherwise("").alias("context_before"),
        F.when(F.col("_known") & (F.size(after) > 0), F.array_join(F.slice(head, F.lit(1), F.lit(overlap)), "\n"))
        .otherwise("").alias("context_after"),
    )
    small = marked.filter(tokens <= max_tokens).select(
        "diff_id", "file_no", "path", F.lit(0).alias("chunk_no"), F.size("hunks").alias("n_hunks"),
        tokens.alias("estimated_tokens"), F.lit("").alias("context_before"), F.lit("").alias("context_after"),
    )
    return chunks.unionByName(small)


# ----------------------------------------------------------------- triage


def file_class(path: Column, lines: Column, is_binary: Column) -> Column:
    sized = F.when(lines > 50, "important").otherwise("minor")
    return (
        F.when(is_binary, "noise")
        .when(any_of(path, NOISE), "noise")
        .when(any_of(path, CRITICAL_PATHS + CRITICAL_FILES), "critical")
        .when(any_of(path, TESTS + DOCS), sized)
        .when(any_of(path, IMPORTANT), "important")
        .otherwise(sized)
    )


def classify_files(changes: DataFrame) -> DataFrame:
    """``changes``: path, lines_added, lines_deleted, is_binary, and any other columns."""
    lines = F.col("lines_added") + F.col("lines_deleted")
    return changes.withColumn("lines_changed", lines).withColumn(
        "file_class", file_class(F.col("path"), F.col("lines_changed"), F.col("is_binary"))
    )


def detect_domain(changes: DataFrame) -> DataFrame:
    lowered = F.lower("path")
    domain = F.lit(None).cast("string")
    for name, parts in reversed(DOMAINS.items()):
        domain = F.when(lowered.rlike("|".join(parts)), name).otherwise(domain)
    return changes.withColumn("domain", domain)


def prioritize_files(changes: DataFrame, max_files: int = 20) -> DataFrame:
    """All critical files, then important and minor ones while there is room.

    Only the best ``max_files`` per review and class compete, trimmed before
    the shuffle; a review with a third of all files costs no more than others.
    Classes are written down, as they cost the most and are read four times.
    """
    ranked = kept(classify_files(changes).select("review_id", "path", "lines_changed", "file_class"))
    critical = ranked.filter(F.col("file_class") == "critical").select("review_id", "path")
    taken = critical.groupBy("review_id").agg(F.count("*").alias("_critical"))
    best = top_k(
        ranked.filter(F.col("file_class").isin("important", "minor")),
        ["review_id", "file_class"], [F.col("lines_changed").desc(), F.col("path")], max_files,
    )
    window = Window.partitionBy("review_id").orderBy("file_class", F.col("lines_changed").desc(), "path")
    chosen = (
        best.withColumn("_place", F.row_number().over(window)).join(taken, "review_id", "left")
        .filter(F.col("_place") <= F.greatest(F.lit(max_files) - F.coalesce("_critical", F.lit(0)), F.lit(0)))
        .select("review_id", "path").unionByName(critical).withColumn("_chosen", F.lit(True))
    )
    return ranked.join(chosen, ["review_id", "path"], "left").select(
        "review_id", "path", "file_class", "lines_changed", F.col("_chosen").isNotNull().alias("to_review")
    )


# ------------------------------------------------------- issues, assessment


def parse_review_responses(responses: DataFrame) -> DataFrame:
    """Issues in stored reviewer responses (response_id, file, response)."""
    pattern = r"(?s)<issue\s+severity=['\"]?(blocking|warning|suggestion)['\"]?\s*>(.*?)</issue>"
    each = responses.select("response_id", "file", F.posexplode(F.arrays_zip(
        F.regexp_extract_all("response", F.lit(pattern), F.lit(1)).alias("severity"),
        F.regexp_extract_all("response", F.lit(pattern), F.lit(2)).alias("body"))).alias("issue_no", "i"))
    body = F.col("i.body")

    def tag(name: str, inner: str = "(.*?)") -> Column:
        rule = f"(?s)<{name}>{inner}</{name}>"
        return F.when(body.rlike(rule), _strip(F.regexp_extract(body, rule, 1)))

    return each.select(
        "response_id", "file", "issue_no", F.col("i.severity").alias("severity"),
        F.coalesce(tag("message"), F.lit("Issue found")).alias("message"),
        tag("line", r"(\d+)").try_cast("int").alias("line"), tag("suggestion").alias("suggestion"),
    )


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def response_summaries(responses: DataFrame) -> DataFrame:
    rule = "(?s)<summary>(.*?)</summary>"
    found = F.when(F.col("response").rlike(rule), _strip(F.regexp_extract("response", rule, 1)))
    return responses.select("response_id", F.coalesce(found, F.lit("Review completed.")).alias("summary"))


def review_assessment(issues: DataFrame, key: str = "review_id") -> DataFrame:
    counts = issues.groupBy(key).agg(
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("blocking", "warning", "suggestion")]
    )
    verdict = (
        F.when((F.col("n_blocking") > 0) | (F.col("n_warning") > 3), "request_changes")
        .when(F.col("n_warning") > 0, "needs_discussion").otherwise("approve")
    )
    return counts.withColumn("assessment", verdict)


def cross_file_findings(changes: DataFrame) -> DataFrame:
    """Missing tests and missing API documentation, one row per finding."""
    low = F.lower("path")
    test, api = low.contains("test"), low.contains("api") | low.contains("routes")
    doc = F.col("path").endswith(".md") | low.contains("doc")
    big = F.col("lines_added") + F.col("lines_deleted") > 20
    facts = changes.groupBy("review_id").agg(
        F.count("*").alias("files"), F.bool_or(test).alias("tests"), F.count_if(~test & big).alias("big_sources"),
        F.bool_or(api).alias("apis"), F.bool_or(doc).alias("docs"),
    ).filter(F.col("files") >= 2)
    findings = F.array(
        F.when(~F.col("tests") & (F.col("big_sources") > 0), F.struct(
            F.lit("warning").alias("severity"), F.lit("missing_tests").alias("finding"), F.col("big_sources").alias("n_files"))),
        F.when(F.col("apis") & ~F.col("docs"), F.struct(
            F.lit("suggestion").alias("severity"), F.lit("missing_docs").alias("finding"), F.lit(0).cast("bigint").alias("n_files"))),
    )
    return facts.select("review_id", F.inline(F.filter(findings, lambda f: f.isNotNull())))


def review_cost(usage: DataFrame, key: str, tokens: str) -> DataFrame:
    """Cents per group, 60 % of the tokens as input."""
    total = usage.groupBy(key).agg(F.sum(tokens).alias("tokens"))
    per_token = (INPUT_SHARE * INPUT_CENTS + (1 - INPUT_SHARE) * OUTPUT_CENTS) / 1_000_000
    return total.withColumn("cost_cents", F.round(F.col("tokens") * F.lit(per_token), 6))


def _signature(text: Column) -> Column:
    """Bit set of the principle keywords in a text."""
    lowered = F.lower(text)
    return sum((F.when(lowered.contains(k), F.lit(1 << i)).otherwise(F.lit(0)) for i, k in enumerate(PRINCIPLE_KEYWORDS)), F.lit(0))


def principle_signatures(principles: DataFrame) -> DataFrame:
    return principles.withColumn("signature", _signature(F.col("content"))).filter("signature <> 0")


def match_principles(issues: DataFrame, principles: DataFrame) -> DataFrame:
    """Issues that touch a principle through a shared keyword.

    Principles with the same keyword set are hit by the same issues, so issues
    meet at most 511 keyword sets instead of every principle. The violations of
    an issue are the principles of :func:`principle_signatures` with the set.
    ``issues``: issue_id, message.
    """
    sets = principle_signatures(principles).groupBy("signature").agg(F.count("*").alias("n_principles"))
    bits = lambda c: F.filter(F.transform(F.sequence(F.lit(0), F.lit(len(PRINCIPLE_KEYWORDS) - 1)),
                                          lambda i: F.when(F.getbit(c, i) == 1, i)), lambda i: i.isNotNull())
    by_bit = sets.withColumn("_bit", F.explode(bits(F.col("signature").cast("bigint"))))
    asked = issues.withColumn("_bit", F.explode(bits(_signature(F.col("message")).cast("bigint"))))
    return asked.join(F.broadcast(by_bit), "_bit").select("issue_id", "signature", "n_principles").distinct()


def needs_sync(heads: DataFrame, runs: DataFrame) -> DataFrame:
    """Projects whose head commit was never extracted last, or never at all.

    ``heads``: project_id, head_sha. ``runs``: project_id, commit_sha,
    extracted_at, id.
    """
    last = runs.groupBy("project_id").agg(F.max_by("commit_sha", F.struct("extracted_at", "id")).alias("last_sha"))
    return heads.join(last, "project_id", "left").filter(
        F.col("last_sha").isNull() | (F.col("last_sha") != F.col("head_sha"))
    )
