"""Language of source files, and which schemas speak for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.pattern_tables import SCHEMAS

# Language -> file endings, in order of declaration.
ENDINGS = {
    "python": [".py", ".pyw", ".pyx", ".pxd", ".pxi"],
    "typescript": [".ts", ".tsx", ".mts", ".cts"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "java": [".java"],
    "go": [".go"],
    "rust": [".rs"],
    "ruby": [".rb", ".rake", ".gemspec"],
    "php": [".php", ".phtml", ".php5", ".php7"],
    "csharp": [".cs"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp", ".hxx", ".h++"],
    "c": [".c", ".h"],
    "kotlin": [".kt", ".kts"],
    "swift": [".swift"],
    "scala": [".scala", ".sc"],
    "sql": [".sql"],
    "yaml": [".yml", ".yaml"],
    "json": [".json"],
    "markdown": [".md", ".markdown"],
}

# Interpreter names, checked in order.
SHEBANGS = {
    "python": ["python", "python3", "python2"],
    "javascript": ["node", "nodejs", "deno", "bun"],
    "ruby": ["ruby"],
}

# Content patterns per language; (?m) where lines count.
CONTENT = {
    "python": [r"(?m)^import\s+\w+", r"(?m)^from\s+\w+\s+import", r"(?m)^def\s+\w+\s*\(", r"(?m)^class\s+\w+"],
    "typescript": [r"(?m)^import\s+.*\s+from\s+['\"]", r"(?m)^export\s+(interface|type|class|function|const)",
                   r":\s*(string|number|boolean|void|any)\s*[;=)]"],
    "javascript": [r"(?m)^import\s+.*\s+from\s+['\"]", r"(?m)^const\s+\w+\s*=", r"(?m)^function\s+\w+\s*\(", r"module\.exports\s*="],
    "java": [r"(?m)^package\s+[\w.]+;", r"(?m)^import\s+[\w.]+;", r"public\s+(class|interface|enum)\s+\w+"],
    "go": [r"(?m)^package\s+\w+", r"(?m)^import\s+\(", r"(?m)^func\s+\w+\s*\("],
    "rust": [r"(?m)^use\s+[\w:]+;", r"(?m)^mod\s+\w+;", r"(?m)^fn\s+\w+\s*\(", r"(?m)^pub\s+(fn|struct|enum|trait)"],
    "ruby": [r"(?m)^require\s+['\"]", r"(?m)^class\s+\w+", r"(?m)^def\s+\w+", r"(?m)^module\s+\w+"],
    "php": [r"(?m)^<\?php", r"(?m)^namespace\s+[\w\\]+;", r"(?m)^use\s+[\w\\]+;"],
    "csharp": [r"(?m)^using\s+[\w.]+;", r"(?m)^namespace\s+[\w.]+", r"public\s+(class|interface|struct)\s+\w+"],
    "cpp": [r"(?m)^#include\s+[<\"]", r"(?m)^namespace\s+\w+\s*\{", r"^class\s+\w+\s*[:\{]"],
    "c": [r"(?m)^#include\s+[<\"]", r"(?m)^typedef\s+", r"^struct\s+\w+\s*\{"],
    "kotlin": [r"(?m)^package\s+[\w.]+", r"(?m)^import\s+[\w.]+", r"(?m)^fun\s+\w+\s*\(", r"(?m)^class\s+\w+"],
    "swift": [r"(?m)^import\s+\w+", r"(?m)^func\s+\w+\s*\(", r"(?m)^class\s+\w+", r"(?m)^struct\s+\w+"],
    "scala": [r"(?m)^package\s+[\w.]+", r"(?m)^import\s+[\w.]+", r"(?m)^object\s+\w+", r"(?m)^class\s+\w+"],
    "sql": [r"(?mi)^(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)\s+"],
}
SPECIAL_NAMES = {"gemfile": "ruby", "rakefile": "ruby", "podfile": "ruby", "package.json": "json", "tsconfig.json": "json",
                 "go.mod": "go", "go.sum": "go"}
NOT_CODE = ("yaml", "json", "markdown", "sql", "unknown")


def text_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _case(branches: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in branches) + " END"


_BASE = "regexp_extract(path, '([^/]*)/*$', 1)"
#: Ending with its dot; names that only start with a dot have none.
_ENDING = f"lower(regexp_extract({_BASE}, {text_literal(r'^.+([.][^.]*)$')}, 1))"


def _any(values: list[str]) -> str:
    return "(" + ", ".join(text_literal(v) for v in values) + ")"


def language_of() -> Column:
    """Language from the columns path and content, as one SQL expression.

    The many content tests sit inside a lambda: it is evaluated only for files
    that nothing cheaper identified, and stays out of the generated method,
    which they would push past the JVM's size limit.
    """
    by_ending = _case([(f"{_ENDING} IN {_any(endings)}", text_literal(k)) for k, endings in ENDINGS.items()])
    first = "lower(substring_index(content, '\\n', 1))"
    by_shebang = _case([(f"startswith({first}, '#!') AND {first} RLIKE {text_literal('|'.join(names))}", text_literal(k))
                        for k, names in SHEBANGS.items()])
    # Without a single hit the first entry outranks the others, and has no language.
    scores = ["named_struct('score', 0, 'order', 1, 'language', CAST(NULL AS STRING))"] + [
        f"named_struct('score', {' + '.join(f'CAST(c RLIKE {text_literal(p)} AS INT)' for p in rules)}, 'order', {-i}, 'language', {text_literal(k)})"
        for i, (k, rules) in enumerate(CONTENT.items())]
    by_content = f"element_at(transform(array(content), c -> array_max(array({', '.join(scores)})).language), 1)"
    special = _case([(f"lower({_BASE}) = {text_literal(name)}", text_literal(k)) for name, k in SPECIAL_NAMES.items()])
    return F.expr(f"coalesce({by_ending}, {by_shebang}, {by_content}, {special}, 'unknown')")


def detect_language(files: DataFrame) -> DataFrame:
    """``files``: path, content."""
    return files.withColumn("language", language_of())


def code_files_only(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("language").isin(*NOT_CODE))


def match_schemas(files: DataFrame, trust: dict[str, float] | None = None, schemas: dict | None = None) -> DataFrame:
    """Schemas that speak for each file, best first, in an array column.

    Import texts count the schema's boost, path globs half of it and content
    patterns three tenths; a known trust scales the sum by 0.5 + trust. The few
    schemas are literals, so a file is scored in its own row without a join.
    """
    trust = trust or {}
    scored = []
    for i, (name, (languages, boost, imports, globs, patterns)) in enumerate((schemas or SCHEMAS).items()):
        points = [f"if(contains(f.content, {text_literal(t)}), {boost}D, 0D)" for t in imports]
        points += [f"if(f.path RLIKE {text_literal(g.replace('*', '.*').replace('?', '.'))}, {boost * 0.5}D, 0D)" for g in globs]
        points += [f"if(f.content RLIKE {text_literal(p)}, {boost * 0.3}D, 0D)" for p in patterns]
        total = f"({' + '.join(points) or '0D'}) * {0.5 + trust[name] if name in trust else 1.0}D"
        known = f"{trust[name]}D" if name in trust else "CAST(NULL AS DOUBLE)"
        scored.append(f"named_struct('order', {i}, 'schema', {text_literal(name)}, "
                      f"'score', if(f.language IN {_any(languages)}, {total}, 0D), 'trust', {known})")
    ranked = (
        f"array_sort(filter(array({', '.join(scored)}), s -> s.score > 0), (a, b) -> CASE WHEN round(a.score, 9) > round(b.score, 9) THEN -1 "
        "WHEN round(a.score, 9) < round(b.score, 9) THEN 1 ELSE a.order - b.order END)"
    )
    one = f"transform(array(struct(path, content, language)), f -> transform({ranked}, s -> named_struct('schema', s.schema, 'score', s.score, 'trust', s.trust)))"
    return files.withColumn("schemas", F.expr(f"element_at({one}, 1)"))


def with_base_fallback(files: DataFrame, schemas: dict | None = None) -> DataFrame:
    """Files no schema speaks for get the base schema of their language, if any."""
    known = [n for n in (schemas or SCHEMAS) if n.startswith("base-")]
    base = F.concat(F.lit("base-"), "language")
    only = F.when(base.isin(*known), F.array(F.struct(base.alias("schema"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("trust"))))
    return files.withColumn("schemas", F.when(F.size("schemas") == 0, F.coalesce(only, F.col("schemas"))).otherwise(F.col("schemas")))


def schema_matches(files: DataFrame) -> DataFrame:
    """One row per file and matching schema, ranked."""
    ranked = files.select("project_id", "path", F.posexplode_outer("schemas").alias("_i", "_s")).filter("_s IS NOT NULL")
    return ranked.select(
        "project_id", "path", (F.col("_i") + 1).alias("rank"), "_s.schema", "_s.score", "_s.trust")


def schemas_for_dependencies(detection: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Schemas whose dependency list meets a project's dependencies.

    ``detection``: schema, dependency. ``dependencies``: project_id, dependency.
    """
    return dependencies.select("project_id", "dependency").distinct().join(detection, "dependency").select(
        "project_id", "schema").distinct()


def schemas_for_frameworks(schemas: DataFrame, frameworks: DataFrame) -> DataFrame:
    """Schemas named by a project's frameworks or languages.

    ``schemas``: schema, framework, language. ``frameworks``: project_id, name.
    """
    named = schemas.select("schema", F.explode(F.array("framework", "language")).alias("name")).filter("name IS NOT NULL")
    return frameworks.select("project_id", "name").distinct().join(named, "name").select("project_id", "schema").distinct()
