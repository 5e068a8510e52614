"""Queries over the code mesh: one node table and one edge table.

Nodes: id, type, name, project_id, branch, file, line_start, line_end,
confidence, properties. Edges: from_id, to_id, type, cross_project.
Listings take an optional ``limit``; with one they return the first rows in
the stated order, without one they return every row and leave sorting to the
sink.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.scaling import first_per_key, overlap_join, top_k
from codeloom.session import cut_lineage, kept

ENDPOINT_TYPES = ("ApiEndpoint", "Endpoint")
CALLABLE_TYPES = ("Function", "Method")

#: Bits of one of Spark's bitmaps; a fixed value.
BITS = 1 << 15
#: Names in more files than this are bitmaps of files, others rows: a row of 16 bytes against a bitmap of 4 KB.
FEW_FILES = 256

# Edge types that carry a link between projects.
LINK_EDGE_TYPES = {
    "queue": ("CONNECTS_VIA_QUEUE", "PUBLISHES_TO", "SUBSCRIBES_TO"),
    "api": ("CONNECTS_VIA_API", "CALLS_SERVICE"),
    "database": ("CONNECTS_VIA_DATABASE", "READS_FROM", "WRITES_TO"),
}


def listing(df: DataFrame, order: Sequence[Column | str], limit: int | None) -> DataFrame:
    return df if limit is None else df.orderBy(*order).limit(limit)


def _where(df: DataFrame, **equal: str | None) -> DataFrame:
    """Equality filters for the arguments that were given."""
    given = [F.col(k) == F.lit(v) for k, v in equal.items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def _side(nodes: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("id", *columns)])


def get_nodes(nodes, project_id=None, branch=None, file=None, node_type=None, limit=None) -> DataFrame:
    kept = _where(nodes, project_id=project_id, branch=branch, file=file, type=node_type)
    return listing(kept, ["file", "line_start", "id"], limit)


def get_edges(nodes: DataFrame, edges: DataFrame, project_id=None, branch=None) -> DataFrame:
    """Edges whose source is in the project and whose target is a known node."""
    sources = _where(nodes, project_id=project_id, branch=branch).select(F.col("id").alias("from_id"))
    targets = nodes.select(F.col("id").alias("to_id"))
    return edges.join(sources, "from_id", "left_semi").join(targets, "to_id", "left_semi")


def find_functions(nodes, project_id=None, name_pattern=None, limit=None) -> DataFrame:
    kept = _where(nodes.filter(F.col("type").isin(*CALLABLE_TYPES)), project_id=project_id)
    if name_pattern is not None:
        kept = kept.filter(F.col("name").rlike(f"^(?:{name_pattern})$"))
    return listing(kept, ["name", "id"], limit)


def find_api_endpoints(nodes, project_id=None, method=None, path_pattern=None, limit=None) -> DataFrame:
    kept = _where(nodes.filter(F.col("type").isin(*ENDPOINT_TYPES)), project_id=project_id).select(
        "*", F.col("properties")["method"].alias("method"), F.col("properties")["path"].alias("path")
    )
    if method is not None:
        kept = kept.filter(F.col("method") == method.upper())
    if path_pattern is not None:
        kept = kept.filter(F.col("path").rlike(f"^(?:{path_pattern})$"))
    return listing(kept, ["method", "path", "id"], limit)


def search_by_name(nodes, name_pattern, node_type=None, project_id=None, limit=None) -> DataFrame:
    kept = _where(nodes, type=node_type, project_id=project_id)
    return listing(kept.filter(F.col("name").rlike(f"(?i)^.*(?:{name_pattern}).*$")), ["name", "id"], limit)


def find_file_contents(nodes, file_part, project_id=None, limit=None) -> DataFrame:
    kept = _where(nodes, project_id=project_id).filter(F.col("file").contains(file_part))
    return listing(kept, ["line_start", "file", "id"], limit)


def node_at_location(nodes: DataFrame, locations: DataFrame) -> DataFrame:
    """Innermost node overlapping each location.

    ``locations``: location_id, file, line_from, line_to. Nodes with the same lines
    of a file are one span, locations with the same lines one probe.
    """
    spans = first_per_key(
        nodes.filter(F.col("type") != "File").select("file", "id", "type", "name", "line_start", "line_end"),
        ["file", "line_start", "line_end"], [F.col("id")])
    places = ["file", "line_from", "line_to"]
    probes = locations.select(*places).distinct()
    hits = overlap_join(spans, probes, ["file"], ("line_start", "line_end"), ("line_from", "line_to"))
    order = [(F.col("line_end") - F.col("line_start")).alias("size"), F.col("id")]
    columns = ["id", "type", "name", "line_start", "line_end"]
    best = first_per_key(hits.select(*places, *columns), places, order)
    placed = locations.select("location_id", *places).join(best.hint("merge"), places)
    return first_per_key(placed.select("location_id", *columns), ["location_id"], order)


def find_callers(nodes, edges, function_name=None, project_id=None, limit=None) -> DataFrame:
    """Callers of ``function_name``, or of every function."""
    target = _side(_where(nodes, name=function_name), "target", "name")
    caller = _side(_where(nodes, project_id=project_id), "caller", "name", "file", "line_start", "project_id")
    calls = edges.filter(F.col("type") == "CALLS").select(
        F.col("from_id").alias("caller_id"), F.col("to_id").alias("target_id")
    )
    return listing(
        calls.join(target, "target_id").join(caller, "caller_id"),
        ["caller_file", "caller_line_start", "caller_id", "target_id"],
        limit,
    )


def find_callees(nodes, edges, function_name=None, project_id=None, limit=None) -> DataFrame:
    caller = _side(_where(nodes, name=function_name, project_id=project_id), "caller", "name")
    callee = _side(nodes, "callee", "name", "file", "line_start")
    calls = edges.filter(F.col("type") == "CALLS").select(
        F.col("from_id").alias("caller_id"), F.col("to_id").alias("callee_id")
    )
    return listing(
        calls.join(caller, "caller_id").join(callee, "callee_id"),
        ["callee_name", "caller_id", "callee_id"],
        limit,
    )


def trace_queue_flow(nodes: DataFrame, edges: DataFrame, queue_name: str | None = None) -> DataFrame:
    """Both ends of every queue that has a producer and a consumer.

    A path is (producer, queue, consumer). The number of paths through a hot
    queue is a product, so each end is returned once, with the number of ends
    on the other side; all paths are the producer rows times the consumer rows
    of a queue. The subscription edge may point either way.
    """
    queues = nodes.select(
        F.col("id").alias("queue_id"),
        F.col("name").alias("queue_name"),
        F.col("properties")["queue"].alias("_queue"),
    )
    if queue_name is not None:
        queues = queues.filter((F.col("queue_name") == queue_name) | (F.col("_queue") == queue_name))
    queues = queues.drop("_queue")
    publish = edges.filter(F.col("type") == "PUBLISHES_TO").select(
        F.col("to_id").alias("queue_id"), F.col("from_id").alias("node_id"), F.lit("producer").alias("role")
    )
    subscribe = edges.filter(F.col("type") == "SUBSCRIBES_TO")
    consume = subscribe.select(
        F.col("to_id").alias("queue_id"), F.col("from_id").alias("node_id"), F.lit("consumer").alias("role")
    ).unionByName(
        subscribe.select(
            F.col("from_id").alias("queue_id"), F.col("to_id").alias("node_id"), F.lit("consumer").alias("role")
        )
    )
    known = nodes.select(F.col("id").alias("node_id"), F.col("name").alias("node_name"))
    ends = publish.unionByName(consume).join(known, "node_id").join(queues, "queue_id")
    sizes = (
        ends.groupBy("queue_id")
        .agg(
            F.count_if(F.col("role") == "producer").alias("_producers"),
            F.count_if(F.col("role") == "consumer").alias("_consumers"),
        )
        .filter((F.col("_producers") > 0) & (F.col("_consumers") > 0))
    )
    other = F.when(F.col("role") == "producer", F.col("_consumers")).otherwise(F.col("_producers"))
    return ends.join(sizes, "queue_id").select(
        "queue_id", "queue_name", "role", "node_id", "node_name", other.alias("other_ends")
    )


def cross_project_links(nodes, edges, project_id=None, link_type=None, limit=None) -> DataFrame:
    kept = edges.filter(F.col("cross_project"))
    if link_type is not None:
        kept = kept.filter(F.col("type").isin(*LINK_EDGE_TYPES[link_type]))
    joined = kept.join(_side(nodes, "from", "name", "project_id"), "from_id").join(
        _side(nodes, "to", "name", "project_id"), "to_id"
    )
    if project_id is not None:
        joined = joined.filter((F.col("from_project_id") == project_id) | (F.col("to_project_id") == project_id))
    return listing(joined, ["from_id", "to_id"], limit)


def resolve_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with a known source, marked unresolved where the target is no node."""
    sources = nodes.select(F.col("id").alias("from_id"), "project_id", "branch")
    known = nodes.select(F.col("id").alias("to_id"), F.lit(True).alias("_known"))
    return (
        edges.join(sources, "from_id")
        .join(known, "to_id", "left")
        .select("from_id", "to_id", "type", "project_id", "branch", F.col("_known").isNull().alias("is_unresolved"))
    )


def unresolved_references(resolved: DataFrame) -> DataFrame:
    """One row per missing target, project and branch."""
    return (
        resolved.filter("is_unresolved")
        .groupBy(F.col("to_id").alias("name"), "project_id", "branch")
        .agg(F.count("*").alias("n_edges"))
    )


def dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return (
        edges.join(_side(nodes, "from", "name", "project_id"), "from_id")
        .join(_side(nodes, "to", "name"), "to_id")
        .select(
            "from_id", "to_id",
            F.col("from_name").alias("source"),
            F.col("to_name").alias("target"),
            "type",
            F.col("from_project_id").alias("project_id"),
        )
    )


def neighbourhood(nodes: DataFrame, edges: DataFrame, node_id: str | None = None,
                  max_callers: int = 10, max_outgoing: int = 20) -> DataFrame:
    """Callers and outgoing edges of a node, or of every node, ranked by name."""
    known = nodes.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"))
    incoming = edges.filter(F.col("type") == "CALLS").select(
        F.col("to_id").alias("id"), F.col("from_id").alias("other_id"), F.lit("caller").alias("role"), "type"
    )
    outgoing = edges.select(
        F.col("from_id").alias("id"), F.col("to_id").alias("other_id"), F.lit("outgoing").alias("role"), "type"
    )

    def part(df: DataFrame, k: int) -> DataFrame:
        df = df if node_id is None else df.filter(F.col("id") == node_id)
        order = [F.col("other_name"), F.col("other_id"), F.col("type")]
        return top_k(df.join(known, "other_id"), ["id"], order, k)

    return (
        part(incoming, max_callers)
        .unionByName(part(outgoing, max_outgoing))
        .join(nodes.select("id"), "id", "left_semi")
        .select("id", "role", "type", "other_id", "other_name")
    )


def dedup_by_id(df: DataFrame, order: Sequence[str], key: str = "id") -> DataFrame:
    return first_per_key(df, [key], [F.col(c) for c in order])


def project_stats(nodes: DataFrame, project_id: str | None = None) -> DataFrame:
    return _where(nodes, project_id=project_id).groupBy("project_id", "type").agg(F.count("*").alias("n"))


def mesh_statistics(nodes: DataFrame, edges: DataFrame, runs: DataFrame) -> DataFrame:
    """Per project and branch: nodes, files, edges, last commit by time.

    Nodes, edges and runs are aggregated apart and joined on the small result,
    so no node is counted once per edge.
    """
    keys = ["project_id", "branch"]
    of_nodes = nodes.groupBy(*keys).agg(
        F.count("*").alias("n_nodes"), F.countDistinct("file").alias("n_files"),
        F.countDistinct("type").alias("n_types"),
    )
    of_edges = (
        edges.join(nodes.select(F.col("id").alias("from_id"), *keys), "from_id")
        .groupBy(*keys).agg(F.count("*").alias("n_edges"))
    )
    last = runs.groupBy(*keys).agg(F.max_by("commit_sha", F.struct("extracted_at", "id")).alias("last_commit"))
    return (
        of_nodes.join(of_edges, keys, "left").join(last, keys, "left")
        .select(*keys, "n_nodes", "n_files", "n_types",
                F.coalesce("n_edges", F.lit(0)).cast("bigint").alias("n_edges"), "last_commit")
    )


def list_projects(nodes: DataFrame, runs: DataFrame, name_part: str | None = None) -> DataFrame:
    """Per project: branches, node count, newest run; optional name substring."""
    if name_part is not None:
        wanted = F.lower("project_id").contains(name_part.lower())
        nodes, runs = nodes.filter(wanted), runs.filter(wanted)
    of_nodes = nodes.groupBy("project_id").agg(
        F.countDistinct("branch").alias("n_branches"),
        F.array_join(F.array_sort(F.collect_set("branch")), ",").alias("branches"),
        F.count("*").alias("n_nodes"),
    )
    last = runs.groupBy("project_id").agg(F.max("extracted_at").alias("last_extraction"))
    return of_nodes.join(last, "project_id", "left")


def project_files(nodes: DataFrame, project_id=None, branch=None) -> DataFrame:
    return _where(nodes, project_id=project_id, branch=branch).select("project_id", "branch", "file").distinct()


def extraction_statistics(results: DataFrame, max_bytes: int = 1 << 20) -> DataFrame:
    """Files processed and skipped, files per tier, node and edge totals."""
    done = F.col("size") <= max_bytes

    def tier(n: int) -> Column:
        return F.count_if(done & (F.col("tier") == n)).alias(f"tier{n}")

    return results.agg(
        F.count_if(done).alias("files_processed"),
        F.count_if(~done).alias("files_skipped"),
        tier(1), tier(2), tier(3),
        F.coalesce(F.sum(F.when(done, F.col("n_nodes"))), F.lit(0)).cast("bigint").alias("total_nodes"),
        F.coalesce(F.sum(F.when(done, F.col("n_edges"))), F.lit(0)).cast("bigint").alias("total_edges"),
    )


def containing_class(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Class around each method, unless an edge already says so.

    The first class by line that starts before the method and either ends after
    it or ends on the method's first line; confidence 0.7. Classes and methods with
    the same lines of a file meet once, whatever their number.
    """
    home, span = ["project_id", "file"], ["method_start", "method_end"]
    classes = first_per_key(nodes.filter(F.col("type") == "Class").select(
        *home, F.col("id").alias("class_id"), F.col("line_start").alias("class_start"), F.col("line_end").alias("class_end"),
    ), [*home, "class_start", "class_end"], [F.col("class_id")])
    methods = nodes.filter(F.col("type") == "Method").select(
        *home, F.col("id").alias("method_id"), F.col("line_start").alias("method_start"), F.col("line_end").alias("method_end"),
    )
    around = overlap_join(
        classes, methods.select(*home, *span).distinct(), home, ("class_start", "class_end"), ("method_start", "method_start")
    ).filter(
        (F.col("class_start") < F.col("method_start"))
        & ((F.col("class_end") > F.col("method_end")) | (F.col("class_end") == F.col("method_start")))
    )
    order = [F.col("class_start"), F.col("class_id")]
    best = first_per_key(around.select(*home, *span, "class_id", "class_start"), [*home, *span], order)
    first = first_per_key(
        methods.join(best.hint("merge"), [*home, *span]).select("method_id", "class_id", "class_start"), ["method_id"], order
    )
    known = edges.filter(F.col("type") == "CONTAINS").select(
        F.col("from_id").alias("class_id"), F.col("to_id").alias("method_id")
    )
    return (
        first.join(known.hint("merge"), ["class_id", "method_id"], "left_anti")
        .select("class_id", "method_id", F.lit("CONTAINS").alias("type"), F.lit(0.7).alias("confidence"))
    )


def mesh_diff(left: DataFrame, right: DataFrame, compare: Sequence[str]) -> DataFrame:
    """Nodes only left, only right, or changed, matched by type, name and file.

    Several nodes may share the key within a branch; each side is reduced to
    one fingerprint per key first.
    """
    keys = ["type", "name", "file"]

    def side(df: DataFrame, name: str) -> DataFrame:
        row = F.xxhash64(*compare)
        return df.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), F.bit_xor(row).alias(f"_x_{name}"),
                                     F.sum(row.cast("decimal(38,0)")).alias(f"_s_{name}"))

    joined = side(left, "left").join(side(right, "right"), keys, "full_outer")
    change = (
        F.when(F.col("n_right").isNull(), "only_left")
        .when(F.col("n_left").isNull(), "only_right")
        .when((F.col("n_left") != F.col("n_right")) | (F.col("_x_left") != F.col("_x_right"))
              | (F.col("_s_left") != F.col("_s_right")), "changed")
    )
    return joined.withColumn("change", change).filter("change IS NOT NULL").select(*keys, "change")


def suggest_reviewers(nodes: DataFrame, edges: DataFrame, changed_files: DataFrame, k: int = 5) -> DataFrame:
    """Files that reference a changed file most; priority high above three references."""
    target = nodes.join(changed_files.select("file").distinct(), "file", "left_semi").select(
        F.col("id").alias("to_id"), F.col("file").alias("changed_file")
    )
    source = nodes.select(F.col("id").alias("from_id"), F.col("file").alias("referencing_file"))
    counted = (
        edges.filter(F.col("type").isin("IMPORTS", "USES", "CALLS"))
        .join(target, "to_id").join(source, "from_id")
        .groupBy("changed_file", "referencing_file").agg(F.count("*").alias("refs"))
    )
    best = top_k(counted, ["changed_file"], [F.col("refs").desc(), F.col("referencing_file")], k)
    return best.withColumn("priority", F.when(F.col("refs") > 3, "high").otherwise("medium"))


def _numbered(files: DataFrame) -> DataFrame:
    """``files`` (file, distinct) with a number each that is dense enough for bitmaps.

    Files are dealt over as many groups as fill a bitmap to the half and numbered
    inside their group, so no task numbers them all. A group that grows beyond a
    bitmap goes on in the next one.
    """
    groups = files.agg(F.greatest(F.ceil(F.count("*") / (BITS // 2)), F.lit(1))).scalar()
    dealt = files.withColumn("group", F.pmod(F.xxhash64("file"), groups))
    row = F.row_number().over(Window.partitionBy("group").orderBy("file"))
    number = F.shiftleft(F.col("group").cast("long"), 40) + row
    return dealt.select("file", F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("place"))


def files_reached(wanted: DataFrame, held: DataFrame, few: int = FEW_FILES) -> DataFrame:
    """Distinct files that hold any of the names a file wants.

    ``wanted``: file, name; ``held``: name, file; both distinct. Returns file and
    reached, for files that reach any; the file itself counts where it holds one
    of its names, a held file of null does not. A name in more than ``few`` files
    is a set of bitmaps, united per wanting file, so a name that all files want
    and hold makes a row for some ten thousand pairs. Other names stay rows; those
    whose bit is set already are not counted again. Counts are exact either way.
    """
    held = held.filter("file IS NOT NULL")
    sizes = held.groupBy("name").agg(F.count("*").alias("files"))
    numbers = cut_lineage(_numbered(held.select("file").distinct()))
    held = kept(held.join(sizes, "name").join(numbers, "file").select("name", "bucket", "place", (F.col("files") > few).alias("many")))
    sets = held.filter("many").groupBy("name", "bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    united = kept(wanted.join(sets, "name").groupBy("file", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")))
    single = wanted.join(held.filter("NOT many"), "name").select("file", "bucket", "place").distinct()
    byte = F.conv(F.hex(F.expr("substring(bits, cast(place div 8 + 1 AS int), 1)")), 16, 10).cast("int")
    in_set = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(place % 8 AS int))")) != 0, F.lit(False))
    counted = united.select("file", F.bitmap_count("bits").alias("n")).unionByName(
        single.join(united, ["file", "bucket"], "left").filter(~in_set).groupBy("file").agg(F.count("*").alias("n")))
    return counted.groupBy("file").agg(F.sum("n").alias("reached"))


def impact_analysis(nodes: DataFrame, edges: DataFrame, changed_files: DataFrame) -> DataFrame:
    """Effect of each changed file taken as a change set of its own.

    Callers and callees are found by function name and all of them count. Calls
    are counted per name, distinct calling files by :func:`files_reached`, so no
    changed file meets the calling files of a common name one by one. What is
    used more than once is written down.
    """
    changed = kept(nodes.join(changed_files.select("file").distinct(), "file", "left_semi").select("id", "file", "name", "type"))
    functions = kept(changed.filter(F.col("type").isin(*CALLABLE_TYPES)).groupBy("file", "name").agg(F.count("*").alias("same")))
    caller = nodes.select(F.col("id").alias("from_id"), F.col("name").alias("from_name"), F.col("file").alias("from_file"))
    callee = nodes.select(F.col("id").alias("to_id"), F.col("name").alias("to_name"))
    calls = kept(
        edges.filter(F.col("type") == "CALLS").select("from_id", "to_id")
        .join(caller, "from_id").join(callee, "to_id")
        .groupBy("from_name", "to_name", "from_file").agg(F.count("*").alias("n"))
    )
    per_name = (
        calls.select(F.col("to_name").alias("name"), F.col("n").alias("up"), F.lit(0).alias("down"))
        .unionByName(calls.select(F.col("from_name").alias("name"), F.lit(0).alias("up"), F.col("n").alias("down")))
        .groupBy("name").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    )
    counts = functions.join(per_name, "name").groupBy("file").agg(
        F.sum(F.col("up") * F.col("same")).alias("callers"), F.sum(F.col("down") * F.col("same")).alias("callees"))
    called_in = calls.select(F.col("to_name").alias("name"), F.col("from_file").alias("file")).distinct()
    own = functions.join(called_in, ["name", "file"], "left_semi").select("file").distinct().withColumn("own", F.lit(1))
    affected = (
        files_reached(functions.select("file", "name"), called_in).join(own, "file", "left")
        .select("file", (F.col("reached") - F.coalesce("own", F.lit(0))).alias("affected_files"))
        .join(counts, "file", "full_outer")
    )
    endpoints = changed.filter(F.col("type").isin(*ENDPOINT_TYPES)).groupBy("file").agg(F.count("*").alias("endpoints"))
    of_file = changed.select("id", "file")
    linked = edges.filter("cross_project").select("from_id", "to_id", "type", F.explode(F.array("from_id", "to_id")).alias("id"))
    links = linked.join(of_file, "id").select("file", "from_id", "to_id", "type").distinct().groupBy("file").agg(F.count("*").alias("links"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    joined = (
        changed.select("file").distinct()
        .join(affected, "file", "left").join(endpoints, "file", "left").join(links, "file", "left")
        .select("file", *[zero(c) for c in ("affected_files", "callers", "callees", "endpoints", "links")])
    )
    risk = (
        F.when((F.col("links") > 0) | (F.col("endpoints") > 5), "high")
        .when((F.col("endpoints") > 0) | (F.col("callers") > 10), "medium")
        .otherwise("low")
    )
    return joined.withColumn("risk", risk)


def impact_warnings(impact: DataFrame) -> DataFrame:
    """Total impact of a change set and the warnings it raises, long form."""
    return impact.select(
        "file",
        F.explode(F.filter(F.array(
            F.when(F.col("links") > 0, F.lit("cross_project")),
            F.when(F.col("endpoints") > 0, F.lit("api")),
            F.when(F.col("callers") > 10, F.lit("many_callers")),
        ), lambda w: w.isNotNull())).alias("warning"),
    )
