"""Source files to nodes and edges.

A file is one bounded row (the scan drops files over its size limit), so all
of its matches, scopes and resolutions are worked out inside that row with
array functions. No stage shuffles; the one Python step runs compiled
expressions over Arrow batches because line numbers need match offsets, which
no built-in returns, and finds the ends of scopes while it has the lines.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import scopes as scope_ends
from codeloom.functions.pattern_tables import PATTERNS, SCHEMAS
from codeloom.functions.scalars import camel_case, snake_case
from codeloom.functions.scaling import each_item
from codeloom.session import in_slice, kept, release_shuffles, slices

CALLABLE = ("Function", "Method")
BRACE_LANGUAGES = ("typescript", "javascript")

# Imports and class heads per language family.
HEADS = {
    "import:python": r"^(?:from\s+(\S+)\s+)?import\s+(.+)$",
    "import:brace": r"^import\s+(?:{([^}]+)}|(\S+))\s+from\s+['\"]([^'\"]+)['\"];?$",
    "class:python": r"^class\s+([A-Z][a-zA-Z0-9_]*)\s*\(([^)]+)\)\s*:",
    "class:brace": (r"^(?:export\s+)?(?:abstract\s+)?class\s+([A-Z][a-zA-Z0-9_]*)\s*(?:extends\s+([A-Z][a-zA-Z0-9_.<>]*))?"
                    r"\s*(?:implements\s+([^{]+))?\s*\{"),
}
# Bases that are no parents, words that are no calls, call forms.
MARKER_BASES = ["object", "type", "ABC", "Protocol", "Generic", "TypedDict", "NamedTuple", "Enum", "IntEnum", "StrEnum", "Flag", "IntFlag"]
NOT_CALLS = (
    "if for while switch catch with return throw new typeof delete void instanceof in of export import require default "
    "class function async await yield try finally else case break continue"
).split()
CALLS = {
    "python": [(r"(?:await\s+)?([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", 1), (r"(?:await\s+)?self\.([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", 1),
               (r"(?:await\s+)?([a-zA-Z_][a-zA-Z0-9_]*)\.([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", 2)],
    "other": [(r"(?:await\s+)?([a-zA-Z_$][a-zA-Z0-9_$]*)\s*(?:<[^>]+>)?\s*\(", 1), (r"(?:await\s+)?this\.([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\(", 1),
              (r"(?:await\s+)?([a-zA-Z_$][a-zA-Z0-9_$]*)\.([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\(", 2)],
}

MATCHES = "array<struct<pattern:string,seq:int,line:int,end:int,groups:array<string>>>"


def compiled(patterns: Sequence[tuple]) -> dict[str, re.Pattern]:
    """Expressions by id; word classes are ASCII as in the pattern dialect."""
    table = {}
    for row in patterns:
        schema, group, name, rule, *rest = row
        flags = rest[4] if len(rest) > 4 else "gm"
        options = re.ASCII | (re.M if "m" in flags else 0) | (re.S if "s" in flags else 0) | (re.I if "i" in flags else 0)
        table[f"{schema}/{group}/{name}"] = re.compile(rule, options)
    return table


def required_text(rule: re.Pattern) -> str:
    """The longest text that every match of an expression holds, or nothing where none is sure.

    Looking for a text is far cheaper than running the expression, which in most files finds nothing.
    """
    if rule.flags & re.I:
        return ""
    runs = [""]

    def walk(ops) -> None:
        for op, value in ops:
            name = str(op)
            if name == "LITERAL":
                runs[-1] += chr(value)
            elif name == "SUBPATTERN" and not value[1] and not value[2]:
                walk(value[3])
            elif name != "AT":
                runs.append("")
                if name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
                    walk(value[2])
                    runs.append("")

    walk(re._parser.parse(rule.pattern, rule.flags))
    return max(runs, key=len)


def _scoped(patterns: Sequence[tuple]) -> dict[str, int]:
    """Patterns whose nodes have a scope, and the group that captures the indentation of their definition (0: none)."""
    groups = {}
    for schema, group, name, _, captures, node, *_rest in patterns:
        if node and (node[0] == "Class" or node[0] in CALLABLE):
            spec = captures.get("indent", 0)
            groups[f"{schema}/{group}/{name}"] = spec[0] if isinstance(spec, tuple) else spec
    return groups


def matcher(rules: dict[str, re.Pattern], scoped: dict[str, int]):
    """Column function (content, pattern ids, language) -> matches with lines, groups and ends of scopes.

    Matches of a batch are flat columns, from which the nested array is put together once.
    """

    needed = {name: required_text(rule) for name, rule in rules.items()}

    @F.arrow_udf(MATCHES)
    def find(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for contents, wanted, languages in batches:
            patterns, seqs, lines, ends, groups = [], [], [], [], []
            files, captures = [0], [0]
            for text, names, language in zip(contents.to_pylist(), wanted.to_pylist(), languages.to_pylist()):
                text, scopes = text or "", None
                kind = scope_ends.IndentScopes if language == "python" else scope_ends.BraceScopes if language in BRACE_LANGUAGES else None
                for name in names:
                    if needed[name] not in text:
                        continue
                    line, seen, seq = 1, 0, 0
                    for match in rules[name].finditer(text):
                        line += text.count("\n", seen, match.start())
                        seen = match.start()
                        end = None
                        if kind and name in scoped:
                            scopes = scopes or kind(text.split("\n"))
                            end = scopes.end(line, len(match[scoped[name]] or "") if scoped[name] else 0)
                        patterns.append(name)
                        seqs.append(seq)
                        lines.append(line)
                        ends.append(end)
                        groups.extend(match.groups())
                        captures.append(len(groups))
                        seq += 1
                files.append(len(patterns))
            columns = [pa.array(patterns, pa.string()), *(pa.array(c, pa.int32()) for c in (seqs, lines, ends)),
                       pa.ListArray.from_arrays(pa.array(captures, pa.int32()), pa.array(groups, pa.string()))]
            rows = pa.StructArray.from_arrays(columns, ["pattern", "seq", "line", "end", "groups"])
            yield pa.ListArray.from_arrays(pa.array(files, pa.int32()), rows)

    return find


def _literal_lookup(key: Column, values: dict, kind: str) -> Column:
    """Value of a constant map; the map is one folded literal in the plan."""
    return F.try_element_at(F.from_json(F.lit(json.dumps(values)), f"map<string,{kind}>"), key)


def _rules_of(schema: Column, patterns: Sequence[tuple]) -> Column:
    by_schema: dict[str, list[str]] = {}
    for row in patterns:
        by_schema.setdefault(row[0], []).append(f"{row[0]}/{row[1]}/{row[2]}")
    return _literal_lookup(schema, by_schema, "array<string>")


def find_matches(files: DataFrame, patterns: Sequence[tuple] = PATTERNS) -> DataFrame:
    """Adds ``lines``, ``matches`` and ``heads`` to files.

    ``files``: project_id, path, language, content, schemas. Rows appended to
    ``patterns`` (with their schema in ``schemas``) are user patterns. Line ends
    of all kinds count as one, so that ``$`` stands before each.
    """
    files = files.withColumn("content", F.regexp_replace("content", "\r\n?", "\n"))
    rules = compiled(patterns)
    heads = {k: re.compile(v, re.M | re.ASCII) for k, v in HEADS.items()}
    wanted = F.flatten(F.transform("schemas", lambda s: F.coalesce(_rules_of(s["schema"], patterns), F.array().cast("array<string>"))))
    family = F.when(F.col("language") == "python", F.lit("python")).when(F.col("language").isin(*BRACE_LANGUAGES), "brace")
    head_names = F.when(family.isNull(), F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("import:"), family), F.concat(F.lit("class:"), family)))
    find = matcher({**rules, **heads}, _scoped(patterns))
    is_head = lambda m: m["pattern"].startswith("import:") | m["pattern"].startswith("class:")
    return files.withColumn("lines", F.split("content", "\n")).withColumn(
        "_found", find("content", F.concat(wanted, head_names), "language")
    ).withColumn("matches", F.filter("_found", lambda m: ~is_head(m))).withColumn(
        "heads", F.filter("_found", is_head)).drop("_found")


# ------------------------------------------------------------------ nodes


def node_id(*parts: Column | str) -> Column:
    """Stable id, so that a second run gives the same nodes."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def capture_transform(text: Column, change: Column) -> Column:
    """Captured text changed as the pattern says: not at all for an empty name, else to trim, uppercase, lowercase, camelCase or snake_case."""
    return (
        F.when(change == "", text).when(change == "trim", _trim(text)).when(change == "uppercase", F.upper(text))
        .when(change == "lowercase", F.lower(text)).when(change == "camelCase", camel_case(text)).otherwise(snake_case(text))
    )


def _captures(match: Column, patterns: Sequence[tuple]) -> Column:
    """Captured text by name: group, else default, then transformed."""
    table = {}
    for schema, group, name, _, captures, *_rest in patterns:
        specs = [spec if isinstance(spec, tuple) else (spec, None, None) for spec in captures.values()]
        table[f"{schema}/{group}/{name}"] = [
            {"name": key, "group": g, "change": t or "", "default": d or ""} for key, (g, t, d) in zip(captures, specs)]

    def value(spec: Column) -> Column:
        text = F.coalesce(F.nullif(F.get(match["groups"], spec["group"] - 1), F.lit("")), spec["default"])
        return capture_transform(text, spec["change"])

    specs = _literal_lookup(match["pattern"], table, "array<struct<name:string,group:int,change:string,default:string>>")
    return F.map_from_entries(F.transform(specs, lambda c: F.struct(c["name"], value(c))))


def extracted_matches(found: DataFrame, patterns: Sequence[tuple] = PATTERNS) -> DataFrame:
    """One row per match: pattern, order, captures, confidence."""
    each = each_item(found, ["project_id", "path"], F.col("matches"), "m")
    ids = {f"{p[0]}/{p[1]}/{p[2]}": i for i, p in enumerate(patterns)}
    order = _literal_lookup(F.col("m.pattern"), ids, "int")
    captures = _captures(F.col("m"), patterns)
    rows = each.select("project_id", "path", F.split_part(F.col("m.pattern"), F.lit("/"), F.lit(1)).alias("schema"),
                       F.col("m.pattern").alias("pattern"), order.alias("pattern_no"), F.col("m.seq").alias("seq"),
                       F.col("m.line").alias("line"), captures.alias("captures"))
    filled = F.size(F.filter(F.map_values("captures"), lambda v: v != ""))
    return rows.withColumn("confidence", F.when(F.size("captures") > 0, filled / F.size("captures")).otherwise(0.5))


def _node_array(patterns: Sequence[tuple]) -> Column:
    """Nodes of a file as an array column, in emission order."""
    table = {f"{p[0]}/{p[1]}/{p[2]}": {"no": i, "type": p[5][0], "name": p[5][1], "extra": p[7]} for i, p in enumerate(patterns) if p[5]}

    def placed(m: Column) -> Column:
        """What the pattern says and captures first, so that later steps read them as fields."""
        return F.struct(m["pattern"].alias("pattern"), m["seq"].alias("seq"), m["line"].alias("line"), m["end"].alias("end"),
                        _literal_lookup(m["pattern"], table, "struct<no:int,type:string,name:string,extra:int>").alias("of"),
                        _captures(m, patterns).alias("captures"))

    def node(m: Column) -> Column:
        of = m["of"]
        name = F.coalesce(F.nullif(F.try_element_at(m["captures"], of["name"]), F.lit("")), F.lit("unknown"))
        end = F.coalesce(m["end"], m["line"] + of["extra"])
        return F.struct(
            node_id("project_id", "path", of["type"], name, m["line"].cast("string")).alias("id"), of["type"].alias("type"), name.alias("name"),
            m["line"].alias("line_start"), end.cast("int").alias("line_end"),
            F.split_part(m["pattern"], F.lit("/"), F.lit(1)).alias("schema"),
            of["no"].alias("pattern_no"), m["seq"].alias("seq"),
            m["pattern"].alias("pattern"), m["captures"].alias("captures"),
        )

    with_node = F.filter("matches", lambda m: m["pattern"].isin(*table))
    return F.transform(F.transform(with_node, placed), node)


def with_nodes(found: DataFrame, patterns: Sequence[tuple] = PATTERNS) -> DataFrame:
    """Adds ``nodes`` (array) and ``file_id`` to the output of :func:`find_matches`."""
    return (
        found.withColumn("nodes", _node_array(patterns))
        .withColumn("file_id", node_id("project_id", "path", F.lit("File"), "path", F.lit("1")))
    )


def _properties(captures: Column, pattern: Column, patterns: Sequence[tuple]) -> Column:
    """Template properties: a capture of that name, else the text itself."""
    table = {}
    for schema, group, name, _, _caps, node, *_rest in patterns:
        if node and node[2]:
            table[f"{schema}/{group}/{name}"] = node[2]
    template = F.coalesce(_literal_lookup(pattern, table, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.transform_values(template, lambda _, ref: F.coalesce(F.try_element_at(captures, ref), ref))


def file_nodes(files: DataFrame) -> DataFrame:
    """One node per file, spanning all of its lines; needs no matching."""
    return files.select(
        node_id("project_id", "path", F.lit("File"), "path", F.lit("1")).alias("id"), F.lit("File").alias("type"), F.col("path").alias("name"),
        "project_id", F.col("path").alias("file"), F.lit(1).alias("line_start"), F.size(F.split("content", "\n")).alias("line_end"),
        F.lit(1.0).alias("confidence"),
        F.create_map(F.lit("language"), F.col("language"), F.lit("size"), F.octet_length("content").cast("string")).alias("properties"),
        F.lit(None).cast("string").alias("schema"),
    )


def node_rows(prepared: DataFrame) -> DataFrame:
    """One row per matched node of the output of :func:`with_nodes`.

    Schemas may find the same node; equal ids are one node, the first schema's.
    """
    return each_item(prepared, ["project_id", "path", "file_id"], unique_nodes(F.col("nodes")), "_n").select("project_id", "path", "file_id", "_n.*")


def extract_nodes(prepared: DataFrame, patterns: Sequence[tuple] = PATTERNS, rows: DataFrame | None = None) -> DataFrame:
    """File nodes and matched nodes as rows of the node table.

    ``prepared`` is the output of :func:`with_nodes`, ``rows`` that of :func:`node_rows` where it is written down already.
    """
    found = (node_rows(prepared) if rows is None else rows).select(
        "id", "type", "name", "project_id", F.col("path").alias("file"), "line_start", "line_end", F.lit(0.8).alias("confidence"),
        _properties(F.col("captures"), F.col("pattern"), patterns).alias("properties"), "schema",
    )
    return file_nodes(prepared).unionByName(found)


def unique_nodes(nodes: Column) -> Column:
    """First node per id inside a file."""
    ids = F.transform(nodes, lambda n: n["id"])
    return F.filter(nodes, lambda n, i: F.array_position(ids, n["id"]) == i + 1)


def extraction_confidence(prepared: DataFrame, patterns: Sequence[tuple] = PATTERNS, schemas: dict = SCHEMAS) -> DataFrame:
    """Per file and schema: mean match confidence plus the schema's boost, at most 1."""
    boost = _literal_lookup(F.col("schema"), {k: v[1] for k, v in schemas.items()}, "double")
    asked = each_item(prepared, ["project_id", "path"], F.transform("schemas", lambda s: s["schema"]), "schema")
    mean = extracted_matches(prepared, patterns).groupBy("project_id", "path", "schema").agg(
        F.avg("confidence").alias("_mean"), F.count("*").alias("matches"))
    return asked.join(mean, ["project_id", "path", "schema"], "left").select(
        "project_id", "path", "schema", F.coalesce("matches", F.lit(0)).alias("matches"),
        F.least(F.coalesce("_mean", boost) + boost, F.lit(1.0)).alias("confidence"))


# ------------------------------------------------------------------ edges


def _head_rows(prepared: DataFrame, kind: str) -> DataFrame:
    mine = F.filter("heads", lambda h: h["pattern"].startswith(f"{kind}:"))
    return each_item(prepared, ["project_id", "path", "language", "file_id", "nodes"], mine, "h")


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def extract_imports(prepared: DataFrame) -> DataFrame:
    """IMPORTS edges from files to modules, with alias and line."""
    rows = _head_rows(prepared, "import")
    group = lambda i: F.coalesce(F.get(F.col("h.groups"), F.lit(i)), F.lit(""))
    python = F.col("h.pattern") == "import:python"

    def named(clause: Column, style: str) -> Column:
        return F.transform(F.split(clause, ","), lambda p: F.struct(
            F.get(F.split(_trim(p), r"\s+as\s+"), F.lit(0)).alias("name"),
            F.get(F.split(_trim(p), r"\s+as\s+"), F.lit(1)).alias("alias"), F.lit(style).alias("style")))

    single = F.filter(F.array(F.struct(group(1).alias("name"), F.lit(None).cast("string").alias("alias"), F.lit("default").alias("style"))),
                      lambda s: s["name"] != "")
    items = F.when(python, named(group(1), "python")).otherwise(F.concat(single, named(group(0), "named")))
    each = each_item(rows, ["project_id", "path", "file_id", F.col("h.line").alias("line"), python.alias("_py"), group(0).alias("_from"),
                            group(2).alias("_module")], F.filter(items, lambda s: s["name"] != ""), "s")
    name = F.col("s.name")
    full = F.when(F.col("_py"), F.when(F.col("_from") != "", F.concat_ws(".", "_from", name)).otherwise(name)).otherwise(F.col("_module"))
    module = F.when(F.col("_py"), F.when(F.col("_from") != "", F.col("_from")).otherwise(name)).otherwise(F.col("_module"))
    return each.select(
        "project_id", "path", F.col("file_id").alias("from_id"), full.alias("to_id"), F.lit("IMPORTS").alias("type"),
        name.alias("import_name"), F.when(F.col("s.alias") != name, F.col("s.alias")).alias("alias"), module.alias("module"), "line",
        F.lit(0.9).alias("confidence"),
    )


def _sorted_names(rank: Column, last: bool) -> Column:
    """(name, rank, place, id) of the nodes whose rank is not null, so sorted that the one a name means comes first."""
    place = lambda i: -i if last else i
    ranked = F.transform("nodes", lambda n, i: F.struct(n["name"].alias("name"), rank(n).alias("rank"), place(i).alias("place"), n["id"].alias("id")))
    return F.sort_array(F.filter(ranked, lambda x: x["rank"].isNotNull() & x["name"].isNotNull()))


def _name_map(names: str) -> Column:
    """Name to id from a column made by :func:`_sorted_names`, which must be a column so that it is built once a file."""
    first = F.filter(names, lambda x, i: (i == 0) | (F.get(F.col(names), i - 1)["name"] != x["name"]))
    return F.map_from_entries(F.transform(first, lambda x: F.struct(x["name"], x["id"])))


def extract_inheritance(prepared: DataFrame) -> DataFrame:
    """INHERITS and IMPLEMENTS edges; parents resolve to classes of the same file.

    Names are resolved inside the file's row; what is exploded holds the edge alone.
    """
    classes = _sorted_names(lambda n: F.when(n["type"] == "Class", 0), last=False)
    either = _sorted_names(lambda n: F.when(n["type"].isin("Class", "Interface"), 0), last=False)
    files = prepared.select("project_id", "path", "heads", classes.alias("_sorted"), either.alias("_either_sorted"))
    files = files.select("project_id", "path", "heads", _name_map("_sorted").alias("_classes"), _name_map("_either_sorted").alias("_either"))

    def edges(h: Column) -> Column:
        group = lambda i: F.coalesce(F.get(h["groups"], F.lit(i)), F.lit(""))
        edge = lambda name, kind: F.struct(
            F.try_element_at("_classes", group(0)).alias("from_id"), group(0).alias("from_name"), name.alias("parent"), F.lit(kind).alias("edge"),
            F.try_element_at("_either" if kind == "IMPLEMENTS" else "_classes", name).alias("target"))

        def parents(clause: Column, kind: str, drop: str) -> Column:
            parts = F.filter(F.transform(F.split(clause, ","), _trim), lambda p: p != "")
            return F.transform(F.transform(parts, lambda p: _trim(F.regexp_replace(p, drop, ""))), lambda p: edge(p, kind))

        bases = F.filter(parents(group(1), "INHERITS", r"\[.*\]"), lambda p: ~p["parent"].isin(*MARKER_BASES))
        extends = F.filter(F.array(edge(_trim(F.regexp_replace(group(1), "<.*>", "")), "INHERITS")), lambda p: p["parent"] != "")
        return F.when(h["pattern"] == "class:python", bases).otherwise(F.concat(extends, parents(group(2), "IMPLEMENTS", "<.*>")))

    heads = F.filter("heads", lambda h: h["pattern"].startswith("class:"))
    each = each_item(files, ["project_id", "path"], F.flatten(F.transform(heads, edges)), "e").filter("e.from_id IS NOT NULL")
    target = F.col("e.target")
    # Written as two literals, so that who asks for another kind leaves these edges out.
    kind = F.when(F.col("e.edge") == "IMPLEMENTS", "IMPLEMENTS").otherwise("INHERITS")
    return each.select(
        "project_id", "path", "e.from_id", F.coalesce(target, "e.parent").alias("to_id"), kind.alias("type"), "e.from_name",
        F.col("e.parent").alias("parent_name"), target.isNotNull().alias("is_resolved"), F.when(target.isNotNull(), 0.95).otherwise(0.7).alias("confidence"))


def extract_calls(prepared: DataFrame) -> DataFrame:
    """CALLS edges from every callable and class to the names called in its lines.

    Classes shadow callables of the same name; the last definition wins. Names are
    resolved inside the file's row; what is exploded holds the edge alone.
    """
    rank = lambda n: F.when(n["type"] == "Class", 0).when(n["type"].isin(*CALLABLE), 1)
    files = prepared.select("project_id", "path", "language", "lines", "nodes", _sorted_names(rank, last=True).alias("_sorted"))
    files = files.select("project_id", "path", "language", "lines", _name_map("_sorted").alias("_ids"),
                         F.filter(unique_nodes(F.col("nodes")), lambda n: n["type"].isin("Class", *CALLABLE)).alias("_scopes"))

    def found(text: Column, family: str) -> Column:
        return F.concat(*[F.regexp_extract_all(text, F.lit(rule), F.lit(group)) for rule, group in CALLS[family]])

    def edges(n: Column) -> Column:
        text = F.array_join(F.slice("lines", n["line_start"], F.greatest(n["line_end"] - n["line_start"] + 1, F.lit(0))), "\n")
        # An array of one text, so that the text is put together once for all rules.
        names = F.flatten(F.transform(F.array(text), lambda t: F.when(F.col("language") == "python", found(t, "python")).otherwise(found(t, "other"))))
        kept = F.filter(F.array_distinct(names), lambda x: ~x.isin(*NOT_CALLS) & (x != n["name"]) & (F.length(x) > 1))
        return F.transform(kept, lambda x: F.struct(
            n["id"].alias("from_id"), n["name"].alias("from_name"), n["type"].alias("kind"), x.alias("target_name"), F.try_element_at("_ids", x).alias("target")))

    rows = each_item(files, ["project_id", "path"], F.flatten(F.transform("_scopes", edges)), "e")
    known, in_class = F.col("e.target").isNotNull(), F.col("e.kind") == "Class"
    return rows.select(
        "project_id", "path", "e.from_id", F.coalesce("e.target", "e.target_name").alias("to_id"), F.lit("CALLS").alias("type"), "e.from_name",
        "e.target_name", known.alias("is_resolved"), in_class.alias("from_class_scope"),
        F.when(known & ~in_class, 0.9).when(known, 0.8).when(~in_class, 0.6).otherwise(0.5).alias("confidence"))


def template_edges(prepared: DataFrame, patterns: Sequence[tuple] = PATTERNS) -> DataFrame:
    """Edges declared by patterns that also make a node.

    "Current" class and function are the last ones made by earlier patterns of
    the schema; a class clears the function. A source that cannot be resolved
    drops the edge, an unknown target gets a placeholder id.
    """
    ids = {f"{p[0]}/{p[1]}/{p[2]}": p[6] for p in patterns if p[5] and p[6]}
    if not ids:
        raise ValueError("no pattern declares an edge")
    each = each_item(prepared, ["project_id", "path", "file_id", "nodes"], F.filter("nodes", lambda n: n["pattern"].isin(*ids)), "n")
    part = lambda i: _literal_lookup(F.col("n.pattern"), {k: e[i] for k, e in ids.items()}, "string")
    earlier = F.filter("nodes", lambda m: (m["schema"] == F.col("n.schema")) & (m["pattern_no"] < F.col("n.pattern_no")))
    kinds = sorted({e[0] for e in ids.values()})
    # The one kind there may be is a literal, so that who asks for another leaves these edges out.
    kind = F.lit(kinds[0]) if len(kinds) == 1 else part(0)
    rows = each.select("project_id", "path", "file_id", "n", earlier.alias("_before"), kind.alias("type"), part(1).alias("_from"), part(2).alias("_to"))
    last = lambda *kinds: F.try_element_at(F.filter("_before", lambda m: m["type"].isin(*kinds)), F.lit(-1))
    cls, scope = last("Class"), last("Class", *CALLABLE)
    function = F.when(scope["type"] != "Class", scope["id"])

    def named(reference: Column) -> Column:
        name = F.try_element_at(F.col("n.captures"), reference)
        return F.try_element_at(F.filter("_before", lambda m: m["name"] == name), F.lit(-1))["id"]

    source = (
        F.when(F.col("_from") == "current_node", F.col("n.id")).when(F.col("_from") == "current_file", F.col("file_id"))
        .when(F.col("_from") == "current_class", cls["id"]).when(F.col("_from") == "current_function", function).otherwise(named(F.col("_from")))
    )
    target_name = F.nullif(F.try_element_at(F.col("n.captures"), F.col("_to")), F.lit(""))
    placeholder = F.when(target_name.isNotNull(), node_id("project_id", "path", F.lit("placeholder"), target_name))
    target = (
        F.when(F.col("_to") == "current_node", F.col("n.id")).when(F.col("_to") == "current_file", F.col("file_id"))
        .otherwise(F.coalesce(named(F.col("_to")), placeholder))
    )
    return rows.select("project_id", "path", source.alias("from_id"), target.alias("to_id"), "type", F.col("n.name").alias("node_name"),
                       F.lit(0.7).alias("confidence")).filter("from_id IS NOT NULL AND to_id IS NOT NULL")


def contains_default(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """CONTAINS edges from the file to nodes nothing else contains.

    Both tables are read, and their ids met, a slice at a time where there are many.
    """
    files = nodes.filter(F.col("type") == "File").select("project_id", "file", F.col("id").alias("from_id"))
    inside = edges.filter(F.col("type") == "CONTAINS").select("to_id")
    others = nodes.filter(F.col("type") != "File").select("project_id", "file", F.col("id").alias("to_id"))
    number = slices(others.count())
    loose = [in_slice(others, "to_id", i, number).join(in_slice(inside, "to_id", i, number), "to_id", "left_anti") for i in range(number)]
    found = loose[0] if number == 1 else kept(*loose)
    return found.join(files, ["project_id", "file"]).select("from_id", "to_id", F.lit("CONTAINS").alias("type"), F.lit(1.0).alias("confidence"))


def extract_mesh(files: DataFrame, patterns: Sequence[tuple] = PATTERNS) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of files carrying ``schemas``.

    The matched files are written once, as compressed columns in the shared folder,
    since nodes and each kind of edge read some of them and matching costs far more
    than reading back. Lines are not written; they are cut from the content again.
    Their nodes are written once more as rows, from which the node table and the
    CONTAINS edges read the columns they need without opening the files' arrays.
    """
    matched = with_nodes(find_matches(files, patterns), patterns).drop("matches", "lines", "schemas")
    prepared = kept(matched).withColumn("lines", F.split("content", "\n"))
    release_shuffles(files.sparkSession)
    rows = kept(node_rows(prepared).drop("pattern_no", "seq"))
    nodes = extract_nodes(prepared, patterns, rows)
    keep = ["project_id", "path", "from_id", "to_id", "type", "confidence"]
    edges = (
        extract_imports(prepared).select(*keep)
        .unionByName(extract_inheritance(prepared).select(*keep))
        .unionByName(extract_calls(prepared).select(*keep))
        .unionByName(template_edges(prepared, patterns).select(*keep))
    )
    # No pattern or edge kind above emits CONTAINS, so every node is contained by its file.
    contained = rows.select("project_id", "path", F.col("file_id").alias("from_id"), F.col("id").alias("to_id"), F.lit("CONTAINS").alias("type"),
                            F.lit(1.0).alias("confidence"))
    return nodes, edges.unionByName(contained)


def verification_context(nodes: DataFrame, files: DataFrame, around: int = 10) -> DataFrame:
    """Numbered source lines of each node with ten lines before and after.

    ``files``: project_id, file, content. The file's lines are an array in its
    row, so only the wanted slice is ever expanded.
    """
    wanted = nodes.filter(F.col("type") != "File").select("id", "project_id", "file", "line_start", "line_end")
    joined = wanted.join(files.select("project_id", "file", F.split("content", "\n").alias("_lines")), ["project_id", "file"])

    def numbered(first: Column, last: Column) -> Column:
        start = F.greatest(first, F.lit(1))
        size = F.greatest(last - start + 1, F.lit(0))
        return F.array_join(F.transform(F.slice("_lines", start, size), lambda l, i: F.concat((start + i).cast("string"), F.lit(": "), l)), "\n")

    a, b = F.col("line_start"), F.col("line_end")
    return joined.select("id", numbered(a - around, a - 1).alias("before"), numbered(a, b).alias("source"), numbered(b + 1, b + around).alias("after"))


def parse_verifications(responses: DataFrame) -> DataFrame:
    """Stored verifier responses (node_id, response) to status and corrections."""
    def tag(name: str, inner: str) -> Column:
        rule = f"<{name}>({inner})</{name}>"
        return F.when(F.col("response").rlike(rule), F.regexp_extract("response", rule, 1))

    status = F.coalesce(tag("status", r"\w+"), F.lit("verified"))
    corrected = F.col("status") == "corrected"
    return responses.withColumn("status", status).select(
        "node_id", "status", F.coalesce(tag("confidence", r"[\d.]+").try_cast("double"), F.lit(0.5)).alias("confidence"),
        F.coalesce(_trim(tag("reasoning", "[^<]+")), F.lit("No reasoning provided")).alias("reasoning"),
        F.when(corrected, tag("corrected_line_start", r"\d+").try_cast("int")).alias("line_start"),
        F.when(corrected, tag("corrected_line_end", r"\d+").try_cast("int")).alias("line_end"),
    )


def apply_corrections(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """Nodes with corrected lines, names and properties.

    ``results``: node_id, status, line_start, line_end, and optionally name and
    properties; one row per node.
    """
    for column, kind in (("name", "string"), ("properties", "map<string,string>")):
        if column not in results.columns:
            results = results.withColumn(column, F.lit(None).cast(kind))
    fixes = results.filter(F.col("status") == "corrected").select(
        F.col("node_id").alias("id"), F.struct("line_start", "line_end", "name", "properties").alias("_fix"))
    joined = nodes.join(fixes, "id", "left")
    fixed = F.col("_fix").isNotNull()
    old = F.coalesce(F.col("properties"), F.create_map().cast("map<string,string>"))
    new = F.coalesce(F.col("_fix.properties"), F.create_map().cast("map<string,string>"))
    marks = F.create_map(F.lit("_verified"), F.lit("true"), F.lit("_correction_applied"), F.lit("true"))
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k) & ~F.map_contains_key(marks, k))
    merged = F.map_concat(kept, F.map_filter(new, lambda k, _: ~F.map_contains_key(marks, k)), marks)
    return joined.select(*[
        F.coalesce(F.col(f"_fix.{c}"), F.col(c)).alias(c) if c in ("line_start", "line_end", "name")
        else F.when(fixed, merged).otherwise(F.col("properties")).alias(c) if c == "properties" else F.col(c)
        for c in nodes.columns], fixed.alias("is_corrected"))


def apply_enhancements(nodes: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers (id, name, type, confidence) replace nodes they are more sure about."""
    best = answers.groupBy("id").agg(F.max_by(F.struct("name", "type", "confidence"), "confidence").alias("_a"))
    joined = nodes.join(best, "id", "left")
    better = F.coalesce(F.col("_a.confidence") > F.col("confidence"), F.lit(False))
    return joined.select(*[
        F.when(better, F.coalesce(F.col(f"_a.{c}"), F.col(c))).otherwise(F.col(c)).alias(c) if c in ("name", "type", "confidence") else F.col(c)
        for c in nodes.columns], better.alias("is_enhanced"))


# Node and edge types accepted from discovery.
DISCOVERED_NODES = (
    "File Module Class Interface Function Method Variable Import Decorator ApiEndpoint ApiParameter ApiResponse Queue Topic "
    "Consumer Producer Database Table Column Model ExternalService ConfigValue"
).split()
DISCOVERED_EDGES = (
    "CONTAINS IMPORTS EXPORTS INHERITS IMPLEMENTS CALLS USES RETURNS ACCEPTS DECORATES DECORATED_BY EXPOSES HANDLED_BY "
    "PUBLISHES_TO SUBSCRIBES_TO READS_FROM WRITES_TO QUERIES CALLS_SERVICE DEPENDS_ON"
).split()


def valid_discovered_nodes(nodes: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    return nodes.filter(F.col("type").isin(*DISCOVERED_NODES) & (F.col("confidence") >= min_confidence))


def valid_discovered_edges(edges: DataFrame, valid_nodes: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Edges of known type whose names resolve in their file; the last definition wins.

    ``edges``: file, from_name, to_name, type, confidence. ``valid_nodes``: id,
    file, name, position.
    """
    names = valid_nodes.groupBy("file", "name").agg(F.max_by("id", "position").alias("id"))
    kept = edges.filter(F.col("type").isin(*DISCOVERED_EDGES) & (F.col("confidence") >= min_confidence))
    side = lambda p: names.select("file", F.col("name").alias(f"{p}_name"), F.col("id").alias(f"{p}_id"))
    return kept.join(side("from"), ["file", "from_name"]).join(side("to"), ["file", "to_name"]).select(
        "file", "from_id", "to_id", "type", "confidence")
