"""Tables behind generated documentation: API, functions, classes, modules.

Lists of callers or methods are returned as rows, never collected per owner:
one function may have a third of all callers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.scaling import first_per_key
from codeloom.operators.mesh import CALLABLE_TYPES, ENDPOINT_TYPES, listing

NEAR_LINES = 50


def _prop(name: str) -> Column:
    """A property, empty text counting as missing."""
    return F.nullif(F.col("properties")[name], F.lit(""))


def _endpoints(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("type").isin(*ENDPOINT_TYPES)).select(
        "id", "name", "file", "line_start", "project_id",
        F.coalesce(_prop("method"), F.lit("GET")).alias("method"),
        F.coalesce(_prop("path"), F.col("name")).alias("path"),
        _prop("path").alias("declared_path"),
    )


def _near(endpoints: DataFrame, parts: DataFrame) -> DataFrame:
    """Parts within 49 lines of an endpoint in the same file.

    Lines are cut into cells of 50, and a part is offered to its own cell and
    both neighbours, so the join stays an equi join on (project, file, cell).
    """
    left = endpoints.withColumn("_cell", F.floor(F.col("line_start") / NEAR_LINES))
    right = parts.withColumnRenamed("line_start", "part_line").withColumn(
        "_cell",
        F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)),
                              lambda d: F.floor(F.col("part_line") / NEAR_LINES) + d)),
    )
    return left.join(right, ["project_id", "file", "_cell"]).filter(
        F.abs(F.col("line_start") - F.col("part_line")) < NEAR_LINES
    )


def api_docs(nodes: DataFrame) -> DataFrame:
    """Endpoints with one row per parameter and per response.

    Parameters come from nearby ApiParameter nodes plus the ``{name}`` parts of
    the path that are not among them; an endpoint without nearby responses gets
    a default 200.
    """
    endpoints = _endpoints(nodes)
    head = ["id", "method", "path", "file", "line_start"]
    parameters = nodes.filter(F.col("type") == "ApiParameter").select(
        "project_id", "file", "line_start",
        F.col("name").alias("item"),
        F.coalesce(_prop("type"), F.lit("string")).alias("item_type"),
        F.coalesce(_prop("location"), F.lit("query")).alias("location"),
        F.coalesce(F.col("properties")["required"] == "true", F.lit(False)).alias("required"),
    )
    declared = _near(endpoints, parameters).select(*head, F.lit("parameter").alias("kind"), "item", "item_type",
                                                   "location", "required")
    in_path = endpoints.select(
        *head,
        F.explode(F.array_distinct(F.regexp_extract_all("declared_path", F.lit(r"\{(\w+)\}"), F.lit(1)))).alias("item"),
    ).join(declared.select("id", "item"), ["id", "item"], "left_anti").select(
        *head, F.lit("parameter").alias("kind"), "item", F.lit("string").alias("item_type"),
        F.lit("path").alias("location"), F.lit(True).alias("required"),
    )
    responses = nodes.filter(F.col("type") == "ApiResponse").select(
        "project_id", "file", "line_start",
        F.coalesce(F.col("properties")["status"], F.lit("200")).alias("item"),
    )
    answered = _near(endpoints, responses).select(*head, "item")
    default = endpoints.select(*head, F.lit("200").alias("item")).join(answered.select("id"), "id", "left_anti")
    replies = answered.unionByName(default).select(
        *head, F.lit("response").alias("kind"), "item", F.lit(None).cast("string").alias("item_type"),
        F.lit(None).cast("string").alias("location"), F.lit(None).cast("boolean").alias("required"),
    )
    return declared.unionByName(in_path).unionByName(replies)


def function_docs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per function one row for every caller, callee and parameter."""
    functions = nodes.filter(F.col("type").isin(*CALLABLE_TYPES))
    calls = edges.filter(F.col("type") == "CALLS").select("from_id", "to_id")
    names = nodes.select(F.col("id").alias("other_id"), F.col("name").alias("item"))
    ids = functions.select("id")

    def related(own: str, other: str, kind: str) -> DataFrame:
        return (
            calls.select(F.col(own).alias("id"), F.col(other).alias("other_id"))
            .join(ids, "id", "left_semi").join(names, "other_id")
            .select("id", F.lit(kind).alias("kind"), "item").distinct()
        )

    parameters = functions.filter(F.col("properties")["parameters"].isNotNull()).select(
        "id", F.lit("parameter").alias("kind"),
        F.explode(F.transform(F.split(F.col("properties")["parameters"], ","), F.trim)).alias("item"),
    )
    return related("to_id", "from_id", "caller").unionByName(related("from_id", "to_id", "callee")).unionByName(parameters)


def function_summary(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Every function with its counts; functions without relations included."""
    counts = docs.groupBy("id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}s") for k in ("caller", "callee", "parameter")]
    )
    return (
        nodes.filter(F.col("type").isin(*CALLABLE_TYPES)).select("project_id", "file", "id", "name", "line_start")
        .join(counts, "id", "left").na.fill(0, ["n_callers", "n_callees", "n_parameters"])
    )


def class_docs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per class or interface one row for every base and contained method."""
    owners = nodes.filter(F.col("type").isin("Class", "Interface")).select(F.col("id").alias("from_id"))
    target = nodes.select(F.col("id").alias("to_id"), F.col("name").alias("item"), F.col("type").alias("target_type"))
    joined = edges.join(owners, "from_id", "left_semi").join(target, "to_id")
    kind = F.when(F.col("type").isin("INHERITS", "IMPLEMENTS"), "base").when(
        (F.col("type") == "CONTAINS") & F.col("target_type").isin(*CALLABLE_TYPES), "method"
    )
    return joined.select(F.col("from_id").alias("id"), kind.alias("kind"), "item").filter("kind IS NOT NULL").distinct()


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def endpoints_by_prefix(nodes: DataFrame) -> DataFrame:
    parts = _segments(F.col("path"))
    return (
        _endpoints(nodes)
        .select(F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("prefix"))
        .groupBy("prefix").agg(F.count("*").alias("n"))
    )


def endpoint_tag(path: Column, file: Column) -> Column:
    """First path segment, else the directory of the file, else ``default``."""
    first = F.get(_segments(path), F.lit(0))
    folders = F.split(file, "/")
    parent = F.nullif(F.get(folders, F.size(folders) - 2), F.lit(""))
    return F.when(first.isNotNull() & ~first.startswith("{"), first).otherwise(F.coalesce(parent, F.lit("default")))


def endpoints_by_tag(nodes: DataFrame) -> DataFrame:
    return (
        _endpoints(nodes).select(endpoint_tag(F.col("path"), F.col("file")).alias("tag"))
        .groupBy("tag").agg(F.count("*").alias("n"))
    )


def functions_by_file(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Top-level functions (no dot in the name) with the size of their file's group."""
    top = nodes.filter(F.col("type").isin(*CALLABLE_TYPES) & ~F.col("name").contains("."))
    sizes = top.groupBy("project_id", "file").agg(
        F.count("*").alias("n_functions"), F.countDistinct("name").alias("n_names"),
        F.min("name").alias("first_name"), F.max("name").alias("last_name"),
    )
    return listing(sizes, ["project_id", "file"], limit)


def file_functions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Top-level functions (no dot in the name) as rows of their file,.

    Each with the numbers of its distinct callers, callees and parameters. No
    list per file is built; a sink that writes a page per file sorts by
    project_id, file, line_start and id.
    """
    return function_summary(nodes.filter(~F.col("name").contains(".")), function_docs(nodes, edges))


#: Groups of module heads that are told apart before anything is shuffled; a fixed value.
_HEADS = 1 << 15


def _head(text: Column, at: Column, size: Column) -> Column:
    """Group of a window of ``size`` characters, by its length and up to three first characters."""
    return F.pmod(F.xxhash64(size, F.substring(text, at, F.least(size, F.lit(3)))), F.lit(_HEADS)).alias("_head")


def module_dependencies(imports: DataFrame) -> DataFrame:
    """File to imported file, where the import text lies inside a known file name.

    ``imports``: file, module. Only files that import something count as known,
    the first by name wins. A file name is cut into its windows of the lengths that
    modules have. Those that begin like no module are left out where they are cut,
    by a table of fixed size; the others meet equal modules, after the first file of
    a window has been found, so that a common window costs a row per task.
    """
    used = imports.select("file", "module").filter("module <> ''").distinct()
    files = used.select(F.col("file").alias("target")).distinct()
    modules = used.select("module", F.length("module").alias("_size"))
    heads = modules.select(_head(F.col("module"), F.lit(1), F.col("_size"))).distinct()
    sizes = F.broadcast(modules.agg(F.collect_set("_size").alias("_sizes")))
    cut = files.crossJoin(sizes).select("target", F.explode("_sizes").alias("_size"))
    starts = F.when(F.length("target") >= F.col("_size"), F.sequence(F.lit(1), F.length("target") - F.col("_size") + 1))
    windows = cut.select("target", "_size", F.explode(starts).alias("_at"))
    headed = windows.withColumn("_head", _head(F.col("target"), F.col("_at"), F.col("_size")))
    known = headed.join(F.broadcast(heads), "_head", "left_semi")
    first = known.groupBy(F.substring("target", F.col("_at"), F.col("_size")).alias("module")).agg(F.min("target").alias("target"))
    folder = F.when(F.col("file").contains("/"), F.regexp_extract("file", "^(.*)/[^/]*$", 1)).otherwise(".")
    # Sizes of cut text are guessed far too low, so the hint keeps it from being broadcast.
    return (
        used.join(first.hint("merge"), "module").filter(F.col("file") != F.col("target"))
        .select("file", "target", folder.alias("directory")).distinct()
    )


def er_relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Data relations between models."""
    models = nodes.filter(F.col("type").isin("Model", "Table")).select("id", "name")
    return (
        edges.filter(F.col("type").isin("READS_FROM", "WRITES_TO", "QUERIES"))
        .join(models.select(F.col("id").alias("from_id"), F.col("name").alias("from_model")), "from_id")
        .join(models.select(F.col("id").alias("to_id"), F.col("name").alias("to_model")), "to_id")
        .select("from_model", "to_model", "type")
    )
