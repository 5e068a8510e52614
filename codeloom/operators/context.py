"""Context of source files: imports, manifests, frameworks, exports, related files, configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.scaling import each_item, first_per_key, top_k
from codeloom.session import cut_lineage

# Framework -> (import prefixes, language), in order.
FRAMEWORKS = {
    "nestjs": (["@nestjs/common", "@nestjs/core"], "typescript"),
    "express": (["express"], "typescript"),
    "fastify": (["fastify"], "typescript"),
    "koa": (["koa"], "typescript"),
    "nextjs": (["next", "next/router", "next/image"], "typescript"),
    "react": (["react", "react-dom"], "typescript"),
    "vue": (["vue", "@vue/"], "typescript"),
    "angular": (["@angular/core", "@angular/common"], "typescript"),
    "fastapi": (["fastapi", "from fastapi"], "python"),
    "django": (["django", "from django"], "python"),
    "flask": (["flask", "from flask"], "python"),
    "sqlalchemy": (["sqlalchemy", "from sqlalchemy"], "python"),
    "prisma": (["@prisma/client"], "typescript"),
    "typeorm": (["typeorm"], "typescript"),
    "sequelize": (["sequelize"], "typescript"),
    "mongoose": (["mongoose"], "typescript"),
    "jest": (["jest", "@jest/"], "typescript"),
    "vitest": (["vitest"], "typescript"),
    "pytest": (["pytest", "from pytest"], "python"),
}
# Dependency -> category.
CATEGORIES = {
    "framework": ["@nestjs/common", "@nestjs/core", "express", "fastify", "next", "react", "vue", "@angular/core"],
    "orm": ["@prisma/client", "typeorm", "sequelize", "mongoose"],
    "testing": ["jest", "vitest", "@jest/core", "mocha"],
    "build": ["typescript", "esbuild", "webpack", "vite"],
}
RESOLVED_ENDINGS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs"]

# Import forms, tried in order on every line.
IMPORT_FORMS = {
    "es6": (r"^import\s+(?:(?:\{([^}]+)\})|(?:(\*\s+as\s+\w+))|(?:(\w+)))\s+from\s+['\"]([^'\"]+)['\"]", None),
    "type": (r"^import\s+type\s+\{([^}]+)\}\s+from\s+['\"]([^'\"]+)['\"]", None),
    "require": (r"(?:const|let|var)\s+(?:\{([^}]+)\}|(\w+))\s*=\s*require\(['\"]([^'\"]+)['\"]\)", None),
    "python": (r"^import\s+([\w.]+)(?:\s+as\s+(\w+))?", "python"),
    "from": (r"^from\s+([\w.]+)\s+import\s+(.+)", "python"),
    "go": (r"^\s*(?:import\s+)?\"([^\"]+)\"", "go"),
    "rust": (r"^use\s+([\w:]+)(?:::(\{[^}]+\}|\w+))?", "rust"),
}


def _framework_of(module: Column, language: Column) -> Column:
    """First framework whose prefix the module has; only TypeScript and JavaScript files look at other languages' frameworks."""
    hint = F.lit(None).cast("string")
    for name, (prefixes, of) in reversed(FRAMEWORKS.items()):
        starts = F.lit(False)
        for prefix in prefixes:
            starts = starts | module.startswith(prefix)
        hint = F.when(starts & language.isin(of, "typescript", "javascript"), name).otherwise(hint)
    return hint


def parse_imports(files: DataFrame) -> DataFrame:
    """Import statements by line: module, symbols, relative or not, framework hint.

    ``files``: project_id, path, language, content.
    """
    numbered = F.filter(
        F.transform(F.split("content", "\n"), lambda l, i: F.struct((i + 1).alias("line"), l.alias("raw"))),
        lambda x: x["raw"].rlike(r"import|require\(|^use\s|^\s*\""))
    rows = each_item(files, ["project_id", "path", "language"], numbered, "x")
    line = F.col("x.raw")
    form = F.lit(None).cast("string")
    for name, (rule, language) in reversed(IMPORT_FORMS.items()):
        hit = line.rlike(rule) if language is None else (line.rlike(rule) & (F.col("language") == language))
        form = F.when(hit, name).otherwise(form)
    tagged = rows.select("project_id", "path", "language", F.col("x.line").alias("line"), line.alias("raw"), form.alias("form")).filter("form IS NOT NULL")
    group = lambda name, i: F.regexp_extract("raw", IMPORT_FORMS[name][0], i)
    comma = lambda text: F.transform(F.split(text, ","), F.trim)
    bare = lambda text: F.transform(comma(text), lambda s: F.trim(F.get(F.split(s, " as "), F.lit(0))))
    some = lambda text: F.filter(F.array(text), lambda s: s != "")
    is_form = lambda name: F.col("form") == name
    module = (
        F.when(is_form("es6"), group("es6", 4)).when(is_form("type"), group("type", 2)).when(is_form("require"), group("require", 3))
        .when(is_form("python"), group("python", 1)).when(is_form("from"), group("from", 1)).when(is_form("go"), group("go", 1))
        .otherwise(group("rust", 1))
    )
    es6 = F.concat(F.when(group("es6", 1) != "", bare(group("es6", 1))).otherwise(F.array().cast("array<string>")),
                   some(F.trim(F.replace(group("es6", 2), F.lit("* as "), F.lit("")))), some(group("es6", 3)))
    require = F.concat(F.when(group("require", 1) != "", comma(group("require", 1))).otherwise(F.array().cast("array<string>")), some(group("require", 2)))
    rust = (
        F.when(group("rust", 2).startswith("{"), comma(F.regexp_replace(group("rust", 2), r"^\{|\}$", "")))
        .when(group("rust", 2) != "", F.array(group("rust", 2)))
        .otherwise(F.array(F.element_at(F.split(group("rust", 1), "::"), -1)))
    )
    symbols = (
        F.when(is_form("es6"), es6).when(is_form("type"), comma(group("type", 1))).when(is_form("require"), require)
        .when(is_form("python"), F.array(F.coalesce(F.nullif(group("python", 2), F.lit("")), group("python", 1))))
        .when(is_form("from"), F.filter(bare(group("from", 2)), lambda s: s != "*"))
        .when(is_form("go"), F.array(F.element_at(F.split(group("go", 1), "/"), -1))).otherwise(rust)
    )
    found = tagged.select("project_id", "path", "language", "line", "form", module.alias("module"), symbols.alias("symbols"))
    return found.select(
        "*", (F.col("module").startswith(".") | F.col("module").startswith("/")).alias("is_relative"),
        _framework_of(F.col("module"), F.col("language")).alias("framework"))


def parse_manifests(manifests: DataFrame) -> DataFrame:
    """Dependencies declared in manifest files (project_id, file, content).

    Requirement files count only where the project's other manifests declare nothing.
    """
    name = F.regexp_extract("file", r"([^/]*)$", 1)
    shape = "struct<dependencies:map<string,string>,devDependencies:map<string,string>>"
    package = manifests.filter(name == "package.json").withColumn("_j", F.from_json("content", shape))
    star = F.lit("*")
    parts = [
        package.select("project_id", F.explode("_j.dependencies").alias("dependency", "version"), F.lit(False).alias("is_dev")),
        package.select("project_id", F.explode("_j.devDependencies").alias("dependency", "version"), F.lit(True).alias("is_dev")),
    ]
    block = F.regexp_extract("content", r"(?s)\[project\].*?dependencies\s*=\s*\[(.*?)\]", 1)
    lines = F.filter(F.transform(F.split(block, "\n"), lambda l: F.regexp_extract(l, "[\"']([^\"'>=<]+)", 1)), lambda d: d != "")
    parts.append(manifests.filter(name == "pyproject.toml").select(
        "project_id", F.explode(lines).alias("dependency"), star.alias("version"), F.lit(False).alias("is_dev")))
    declared = parts[0].unionByName(parts[1]).unionByName(parts[2])
    wanted = F.filter(F.transform(F.split("content", "\n"), lambda l: F.regexp_extract(l, "^([a-zA-Z0-9_-]+)", 1)), lambda d: d != "")
    required = manifests.filter(name == "requirements.txt").join(declared.select("project_id"), "project_id", "left_anti").select(
        "project_id", F.explode(wanted).alias("dependency"), star.alias("version"), F.lit(False).alias("is_dev"))
    category = F.lit("unknown")
    for kind, names in CATEGORIES.items():
        category = F.when(F.col("dependency").isin(*names), kind).otherwise(category)
    # Only package.json entries are categorised.
    return declared.unionByName(required).withColumn("category", F.when(F.col("version") == "*", F.lit("unknown")).otherwise(category))


def detect_frameworks(imports: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Frameworks per project with confidence.

    The first hint is worth 0.7 as an import or 0.6 as a dependency; every
    further import adds 0.1 and every further dependency 0.2, up to 1. Evidence
    is counted; the rows behind it are the inputs. ``imports``: project_id,
    framework. ``dependencies``: project_id, dependency.
    """
    hinted = imports.filter("framework IS NOT NULL").groupBy("project_id", F.col("framework").alias("name")).agg(F.count("*").alias("_i"))
    fits = F.array(*[
        F.when(F.col("dependency").rlike("^(" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")"), F.lit(name))
        for name, (prefixes, _) in FRAMEWORKS.items()])
    needed = each_item(dependencies, ["project_id"], F.filter(fits, lambda f: f.isNotNull()), "name").groupBy("project_id", "name").agg(
        F.count("*").alias("_d"))
    both = hinted.join(needed, ["project_id", "name"], "full_outer").na.fill(0, ["_i", "_d"])
    i, dep = F.col("_i"), F.col("_d")
    score = F.when(i > 0, 0.7 + (i - 1) * 0.1 + dep * 0.2).otherwise(0.6 + (dep - 1) * 0.2)
    return both.select("project_id", "name", F.round(F.least(F.lit(1.0), score), 6).alias("confidence"), i.alias("n_imports"), dep.alias("n_dependencies"))


# ------------------------------------------------------------- related files


def _normal(path: Column) -> Column:
    """Path with ``.`` and ``..`` worked out."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(
        p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(done, "/")


def related_files(imports: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None, max_files: int | None = None) -> DataFrame:
    """Files that relative and aliased imports point to; ``max_files`` shortens the list of a file.

    For an import without an ending every known ending is tried, the file
    before its index file. Files are filed under the names that lead to them, so an
    import meets them once. ``imports``: project_id, path, module, line.
    ``files``: project_id, path. Aliases count from the project root; the first that fits holds.
    """
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    local = F.col("module").startswith(".") | F.col("module").startswith("/")
    target = F.when(F.col("module").startswith("/"), F.col("module")).otherwise(F.concat(folder, "module"))
    for alias, place in reversed((aliases or {}).items()):
        hit = (F.col("module") == alias) | F.col("module").startswith(alias + "/")
        local = local | hit
        target = F.when(hit, F.concat(F.lit(place), F.substring(F.col("module"), F.lit(len(alias) + 1), F.length("module")))).otherwise(target)
    wanted = imports.filter(local).select("project_id", "path", "module", "line", _normal(target).alias("_t"))
    known = files.select("project_id", F.col("path").alias("resolved")).distinct()
    own = [(2 * i + k, middle + e) for i, e in enumerate(RESOLVED_ENDINGS) for k, middle in enumerate(("", "/index"))]
    tries = [F.when(F.col("resolved").endswith(tail), F.struct(F.lit(place).alias("place"), F.expr(f"left(resolved, length(resolved) - {len(tail)})").alias("_t")))
             for place, tail in own]
    exact = F.struct(F.lit(99).alias("place"), F.col("resolved").alias("_t"))
    no_ending = lambda t: F.regexp_extract(t, r"[^/]+(\.[^/.]*)$", 1) == ""
    named = known.select("project_id", "resolved", F.inline(F.filter(F.array(*tries, exact), lambda x: x.isNotNull() & ((x["place"] == 99) | no_ending(x["_t"])))))
    found = first_per_key(named, ["project_id", "_t"], [F.col("place")])
    hits = wanted.join(found.select("project_id", "_t", "resolved"), ["project_id", "_t"])
    once = hits.groupBy("project_id", "path", "resolved").agg(F.min(F.struct("line", "module")).alias("_first")).select(
        "project_id", "path", "resolved", "_first.*")
    return once if max_files is None else top_k(once, ["project_id", "path"], [F.col("line"), F.col("module")], max_files)


# ------------------------------------------------------------------ exports

# TypeScript export forms, tried in order on every line.
TS_EXPORTS = {
    "default_class": r"^export\s+default\s+class\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([\w,\s]+))?",
    "class": r"^export\s+class\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([\w,\s]+))?",
    "interface": r"^export\s+interface\s+(\w+)(?:<([^>]+)>)?(?:\s+extends\s+([\w,\s<>]+))?",
    "type": r"^export\s+type\s+(\w+)(?:<([^>]+)>)?\s*=",
    "function": r"^export\s+(?:async\s+)?function\s+(\w+)(?:<([^>]+)>)?\s*\(([^)]*)\)(?:\s*:\s*([^{]+))?",
    "const": r"^export\s+(?:const|let|var)\s+(\w+)(?:\s*:\s*([^=]+))?",
    "enum": r"^export\s+enum\s+(\w+)",
    "default": r"^export\s+default\s+(\w+)",
    "named": r"^export\s+\{([^}]+)\}",
}
TS_METHOD = r"^\s+(?:async\s+)?(\w+)(?:<([^>]+)>)?\s*\(([^)]*)\)(?:\s*:\s*([^{]+))?"
NO_METHODS = ("constructor", "if", "for", "while", "switch")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _given(before: str, text: Column, after: str = "") -> Column:
    """Text with what surrounds it, or nothing when it is empty."""
    return F.when(text != "", F.concat(F.lit(before), text, F.lit(after))).otherwise("")


def _python_exports(files: DataFrame) -> DataFrame:
    listed = F.regexp_extract("content", r"(?s)__all__\s*=\s*\[(.*?)\]", 1)
    has_all = F.col("content").rlike(r"(?s)__all__\s*=\s*\[.*?\]")
    allowed = F.transform(F.split(listed, ","), lambda s: F.regexp_replace(_strip(s), "['\"]", ""))
    rule_class = r"(?m)^class\s+(\w+)(?:\(([^)]+)\))?:"
    rule_def = r"(?m)^(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)(?:\s*->\s*([^:]+))?:"
    all_of = lambda rule, i: F.regexp_extract_all("content", F.lit(rule), F.lit(i))
    classes = F.transform(F.arrays_zip(all_of(rule_class, 1).alias("n"), all_of(rule_class, 2).alias("b")), lambda z: F.struct(
        z["n"].alias("name"), F.lit("class").alias("kind"), F.concat(F.lit("class "), z["n"], _given("(", _strip(z["b"]), ")")).alias("signature")))
    functions = F.filter(F.transform(
        F.arrays_zip(all_of(rule_def, 1).alias("n"), all_of(rule_def, 2).alias("p"), all_of(rule_def, 3).alias("r")), lambda z: F.struct(
            z["n"].alias("name"), F.lit("function").alias("kind"),
            F.concat(F.lit("def "), z["n"], F.lit("("), _strip(z["p"]), F.lit(")"), _given(" -> ", _strip(z["r"]))).alias("signature"))),
        lambda e: ~e["name"].rlike("^_(?!_)"))
    rows = each_item(files.withColumn("_all", F.when(has_all, allowed)), ["project_id", "path", "_all"], F.concat(classes, functions), "e")
    return rows.filter(F.col("_all").isNull() | F.array_contains("_all", F.col("e.name"))).select(
        "project_id", "path", "e.*", F.lit(False).alias("is_default"))


def _typescript_exports(files: DataFrame) -> DataFrame:
    """Exports by line; methods belong to the exported class open around them.

    Windows run inside one file, which is bounded by the size limit of the scan.
    """
    lines = F.transform(F.split("content", "\n"), lambda l, i: F.struct(i.alias("line"), l.alias("text")))
    rows = each_item(files, ["project_id", "path"], lines, "x").select("project_id", "path", "x.*")
    form = F.lit(None).cast("string")
    for name, rule in reversed(TS_EXPORTS.items()):
        hit = F.col("text").rlike(rule)
        if name == "default":
            hit = hit & ~F.col("text").contains("class")
        form = F.when(hit, name).otherwise(form)
    net = F.length(F.replace(F.col("text"), F.lit("}"))) - F.length(F.replace(F.col("text"), F.lit("{")))
    in_file = Window.partitionBy("project_id", "path").orderBy("line")
    class_name = F.when(F.col("form").isin("default_class", "class"), F.regexp_extract("text", r"class\s+(\w+)", 1))
    seen = rows.withColumn("form", form).withColumn("_depth", F.sum(net).over(in_file)).select(
        "*",
        F.max(F.when(F.col("_depth") == 0, F.col("line"))).over(in_file).alias("_closed"),
        F.max(F.when(class_name.isNotNull(), F.col("line"))).over(in_file).alias("_opened"),
        F.last(class_name, ignorenulls=True).over(in_file).alias("_class"),
    )
    inside = (F.col("_opened") >= F.coalesce("_closed", F.lit(-1))) & (F.col("_depth") >= 1) & F.col("form").isNull()
    group = lambda name, i: F.regexp_extract("text", TS_EXPORTS[name], i)
    method = lambda i: F.regexp_extract("text", TS_METHOD, i)

    def entry(name: Column, kind: str, signature: Column, default: bool = False) -> Column:
        return F.array(F.struct(name.alias("name"), F.lit(kind).alias("kind"), signature.cast("string").alias("signature"), F.lit(default).alias("is_default")))

    def class_entry(name: str, default: bool) -> Column:
        text = F.concat(F.lit("class "), group(name, 1), _given(" extends ", group(name, 2)), _given(" implements ", _strip(group(name, 3))))
        return entry(group(name, 1), "class", text, default)

    call = lambda head, g, p, r: F.concat(head, _given("<", g, ">"), F.lit("("), _strip(p), F.lit(")"), _given(": ", _strip(r)))
    none = F.lit(None).cast("string")
    named = F.transform(F.split(group("named", 1), ","), lambda n: F.struct(
        F.trim(F.get(F.split(F.trim(n), " as "), F.lit(0))).alias("name"), F.lit("unknown").alias("kind"), none.alias("signature"), F.lit(False).alias("is_default")))
    is_form = lambda name: F.col("form") == name
    entries = (
        F.when(is_form("default_class"), class_entry("default_class", True)).when(is_form("class"), class_entry("class", False))
        .when(is_form("interface"), entry(group("interface", 1), "interface", F.concat(
            F.lit("interface "), group("interface", 1), _given("<", group("interface", 2), ">"), _given(" extends ", _strip(group("interface", 3))))))
        .when(is_form("type"), entry(group("type", 1), "type", F.concat(F.lit("type "), group("type", 1), _given("<", group("type", 2), ">"))))
        .when(is_form("function"), entry(group("function", 1), "function", call(
            F.concat(F.lit("function "), group("function", 1)), group("function", 2), group("function", 3), group("function", 4))))
        .when(is_form("const"), entry(group("const", 1), "const", F.concat(F.lit("const "), group("const", 1), _given(": ", _strip(group("const", 2))))))
        .when(is_form("enum"), entry(group("enum", 1), "enum", F.concat(F.lit("enum "), group("enum", 1))))
        .when(is_form("default"), entry(group("default", 1), "unknown", none, True))
        .when(is_form("named"), named)
        .when(inside & F.col("text").rlike(TS_METHOD) & ~method(1).isin(*NO_METHODS), entry(
            F.concat_ws(".", "_class", method(1)), "function", call(F.concat_ws(".", "_class", method(1)), method(2), method(3), method(4))))
    )
    found = each_item(seen, ["project_id", "path", "line", F.coalesce("form", F.lit("method")).alias("form")], entries, "e").filter("e.name <> ''")
    # A name listed again by an export clause or as a method adds nothing.
    earlier = Window.partitionBy("project_id", "path", F.col("e.name")).orderBy("line")
    return found.withColumn("_n", F.row_number().over(earlier)).filter(
        (F.col("_n") == 1) | ~F.col("form").isin("named", "method")).select("project_id", "path", "e.*")


def extract_exports(files: DataFrame) -> DataFrame:
    """Exported symbols with kind and signature; ``__all__`` limits Python modules."""
    python = _python_exports(files.filter(F.col("language") == "python"))
    return python.unionByName(_typescript_exports(files.filter(F.col("language").isin("typescript", "javascript"))))


# ------------------------------------------------------------- configuration


def parse_env_files(files: DataFrame) -> DataFrame:
    """Variables of ``.env`` files (project_id, path, content); the last line of the last file by path wins."""
    lines = F.filter(F.transform(F.split("content", "\n"), lambda l, i: F.struct(i.alias("at"), _strip(l).alias("text"))),
                     lambda x: (x["text"] != "") & ~x["text"].startswith("#") & x["text"].contains("="))
    rows = each_item(files, ["project_id", "path"], lines, "x")
    raw = _strip(F.regexp_extract("x.text", r"^[^=]*=(.*)$", 1))
    quoted = raw.rlike("^\".*\"$") | raw.rlike("^'.*'$")
    value = F.when(quoted & (F.length(raw) > 1), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    found = rows.select("project_id", _strip(F.regexp_extract("x.text", "^([^=]*)=", 1)).alias("name"), value.alias("value"),
                        F.struct("path", F.col("x.at").alias("at")).alias("_at"))
    return found.groupBy("project_id", "name").agg(F.max_by("value", "_at").alias("value")).withColumn("method", F.lit("env"))


def flatten_config(configs: DataFrame) -> DataFrame:
    """Leaves of nested JSON configurations under dotted and bare names.

    ``configs``: project_id, content. Levels are opened one after another until
    none is left; each is written down, so a deep document costs a small job for
    each level. Lists and nulls are no leaves. Keys count in the order of the
    text, and the later leaf wins, also under a repeated key.
    """
    level = configs.select("project_id", F.col("content").alias("v"), F.lit("").alias("name"), F.lit("").alias("order"))
    leaves = None
    while True:
        # Read twice: as text, which keeps inner objects as written, and as variants, which tell a text from an object.
        parsed = level.select(
            "project_id", "name", "order",
            F.map_entries(F.from_json("v", "map<string,string>")).alias("raw"), F.map_entries(F.from_json("v", "map<string,variant>")).alias("typed"))
        opened = parsed.select("project_id", "name", "order", F.posexplode(F.arrays_zip("raw", "typed")).alias("pos", "e"))
        typed = cut_lineage(opened.select(
            "project_id", F.when(F.col("name") != "", F.concat_ws(".", "name", "e.raw.key")).otherwise(F.col("e.raw.key")).alias("name"),
            F.col("e.raw.key").alias("leaf"), F.concat("order", F.lpad(F.col("pos").cast("string"), 9, "0")).alias("order"),
            F.col("e.raw.value").alias("v"), F.schema_of_variant("e.typed.value").alias("_t"),
            F.try_variant_get("e.typed.value", "$", "string").alias("value")))
        simple = ~F.col("_t").startswith("OBJECT") & ~F.col("_t").startswith("ARRAY") & (F.col("_t") != "VOID")
        mine = typed.filter(simple).select("project_id", "name", "leaf", "value", "order")
        leaves = mine if leaves is None else leaves.unionByName(mine)
        level = typed.filter(F.col("_t").startswith("OBJECT")).select("project_id", "v", "name", "order")
        if level.isEmpty():
            break
    names = F.when(F.col("name") == F.col("leaf"), F.array("name")).otherwise(F.array("name", "leaf"))
    both = leaves.select("project_id", F.explode(names).alias("name"), "value", "order")
    return both.groupBy("project_id", "name").agg(F.max_by("value", "order").alias("value")).withColumn("method", F.lit("config"))
