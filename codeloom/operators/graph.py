"""Bounded traversals as rounds of joins.

Every round reads the edge table once and joins a frontier that was written to
the checkpoint folder, so plans do not grow with depth and a lost executor
costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.scaling import top_k
from codeloom.session import cut_lineage

# Topic -> broader topics.
TOPIC_PARENTS = {
    "schema:typescript": ["schema:javascript-family", "schema:language"],
    "schema:javascript": ["schema:javascript-family", "schema:language"],
    "schema:python": ["schema:language"],
    "schema:java": ["schema:jvm-family", "schema:language"],
    "schema:kotlin": ["schema:jvm-family", "schema:language"],
    "schema:csharp": ["schema:dotnet-family", "schema:language"],
    "schema:go": ["schema:language"],
    "schema:rust": ["schema:language"],
    "schema:react": ["schema:typescript", "schema:framework"],
    "schema:nextjs": ["schema:react", "schema:framework"],
    "schema:spring": ["schema:java", "schema:framework"],
    "schema:aspnet": ["schema:csharp", "schema:framework"],
    "schema:fastapi": ["schema:python", "schema:framework"],
    "schema:django": ["schema:python", "schema:framework"],
    "extraction:class": ["extraction:type"],
    "extraction:function": ["extraction:type"],
    "extraction:method": ["extraction:type"],
    "extraction:import": ["extraction:type"],
    "extraction:decorator": ["extraction:type"],
}


def closure(steps: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Least number of steps from each start to what it reaches.

    ``steps``: src, dst. ``starts``: id. Returns start_id, id, distance with
    0 < distance <= depth. Distances only; a cycle ends because visited pairs
    are dropped.
    """
    edges = cut_lineage(steps.select("src", "dst").distinct())
    frontier = starts.select(F.col("id").alias("start_id"), "id").distinct()
    seen = frontier.withColumn("distance", F.lit(0))
    for distance in range(1, depth + 1):
        reached = (
            frontier.join(edges, F.col("id") == F.col("src"))
            .select("start_id", F.col("dst").alias("id")).distinct()
            .join(seen.select("start_id", "id"), ["start_id", "id"], "left_anti")
        )
        frontier = cut_lineage(reached)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("distance", F.lit(distance)))
    return seen.filter(F.col("distance") > 0)


def class_hierarchy(nodes: DataFrame, edges: DataFrame, class_name: str | None = None,
                    direction: str = "both", depth: int = 5) -> DataFrame:
    """Ancestors (``up``) and descendants (``down``) within ``depth`` steps.

    Without a name one closure, over every child that has a parent, serves both
    ways: what is above one end is below the other. With a name each way starts
    from that class alone.
    """
    inherit = edges.filter(F.col("type").isin("INHERITS", "IMPLEMENTS")).select(
        F.col("from_id").alias("src"), F.col("to_id").alias("dst")
    )
    classes = nodes.filter(F.col("type") == "Class")
    ways = ("up", "down") if direction == "both" else (direction,)
    turned = inherit.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if class_name is None:
        children = nodes.select("id").join(inherit.select(F.col("src").alias("id")), "id", "left_semi")
        above = closure(inherit, children, depth)
        seen_from = {"up": ("start_id", "id"), "down": ("id", "start_id")}
        rows = [F.struct(F.col(seen_from[way][0]).alias("start_id"), F.col(seen_from[way][1]).alias("id"), "distance", F.lit(way).alias("direction")) for way in ways]
        pairs = above.select(F.explode(F.array(*rows)).alias("row")).select("row.*")
        pairs = pairs.join(classes.select(F.col("id").alias("start_id")), "start_id", "left_semi")
    else:
        named = classes.filter(F.col("name") == class_name)
        found = [closure(inherit if way == "up" else turned, named, depth).withColumn("direction", F.lit(way)) for way in ways]
        pairs = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return pairs.join(nodes.select("id", F.col("name").alias("related_name")), "id").select(
        F.col("start_id").alias("class_id"), F.col("id").alias("related_id"), "related_name", "direction", "distance"
    )


def shortest_path(links: DataFrame, source: str, target: str, max_nodes: int = 4) -> DataFrame:
    """One shortest undirected path of at most ``max_nodes`` nodes.

    ``links``: node, hub, both ways of a bipartite view of the graph: two nodes
    are neighbours when one is the other's hub, or when both share a clique hub
    (``is_clique``). Groups of alike nodes thus cost one hub, not all pairs.
    Returns position, node; no rows when there is no such path.
    """
    links = cut_lineage(links)
    direct = links.filter(~F.col("is_clique")).select("node", "hub")
    both = direct.unionByName(direct.select(F.col("hub").alias("node"), F.col("node").alias("hub")))
    clique = links.filter("is_clique").select("node", "hub")
    spark = links.sparkSession
    level = spark.range(1).select(F.lit(source).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(1).alias("position"))
    level = level.join(both.select("node").unionByName(clique.select("node")), "node", "left_semi")
    levels = [cut_lineage(level)]
    visited = levels[0].select("node")
    for position in range(2, max_nodes + 1):
        frontier = levels[-1].select(F.col("node").alias("parent"))
        if not levels[-1].filter(F.col("node") == target).isEmpty():
            break
        one = both.join(frontier, F.col("hub") == F.col("parent")).select("node", "parent")
        # First member of the frontier stands for the whole clique hub.
        hubs = (
            clique.join(frontier, F.col("node") == F.col("parent"))
            .groupBy("hub").agg(F.min("parent").alias("parent"))
        )
        via = clique.join(hubs, "hub").select("node", "parent")
        step = (
            one.unionByName(via).join(visited, "node", "left_anti")
            .groupBy("node").agg(F.min("parent").alias("parent")).withColumn("position", F.lit(position))
        )
        step = cut_lineage(step)
        if step.isEmpty():
            break
        levels.append(step)
        visited = visited.unionByName(step.select("node"))
    rows = levels[-1].filter(F.col("node") == target)
    # Walk back level by level; levels[i] holds position i + 1.
    for i in range(len(levels) - 2, -1, -1):
        needed = rows.filter(F.col("position") == i + 2).select(F.col("parent").alias("node"))
        rows = rows.unionByName(levels[i].join(needed, "node", "left_semi"))
    return rows.select("position", "node")


def call_graph(calls: DataFrame, root: str | None = None, max_nodes: int = 30) -> DataFrame:
    """Functions around ``root`` by breadth first search over calls by name.

    ``calls``: caller, callee (names). The node budget is spent by level, then
    name, so the visited set never exceeds ``max_nodes`` names. Without a root
    the first ``max_nodes`` connected functions by name are returned.
    """
    pairs = calls.select("caller", "callee").distinct()
    both = cut_lineage(pairs.unionByName(pairs.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))).distinct())
    if root is None:
        names = both.select(F.col("caller").alias("name")).distinct().orderBy("name").limit(max_nodes)
        return names.withColumn("level", F.lit(0))
    visited = both.filter(F.col("caller") == root).select(F.col("caller").alias("name")).distinct().withColumn("level", F.lit(0))
    visited = cut_lineage(visited)
    size, level = visited.count(), 0
    while 0 < size < max_nodes:
        frontier = visited.filter(F.col("level") == level).select(F.col("name").alias("caller"))
        level += 1
        reached = (
            both.join(F.broadcast(frontier), "caller", "left_semi")
            .select(F.col("callee").alias("name")).distinct()
            .join(F.broadcast(visited.select("name")), "name", "left_anti")
            .orderBy("name").limit(max_nodes - size)
        )
        grown = cut_lineage(visited.unionByName(reached.withColumn("level", F.lit(level))))
        if grown.count() == size:
            break
        visited, size = grown, grown.count()
    return visited


def inherited_patterns(schemas: DataFrame, patterns: DataFrame, depth: int = 5) -> DataFrame:
    """Patterns of each schema and of its ancestors.

    ``schemas``: schema_id, extends. ``patterns``: schema_id, pattern.
    """
    steps = schemas.filter("extends IS NOT NULL").select(F.col("schema_id").alias("src"), F.col("extends").alias("dst"))
    own = schemas.select(F.col("schema_id").alias("start_id"), F.col("schema_id").alias("id"))
    up = closure(steps, schemas.select(F.col("schema_id").alias("id")), depth).select("start_id", "id")
    return (
        own.unionByName(up).join(patterns.select(F.col("schema_id").alias("id"), "pattern"), "id")
        .select(F.col("start_id").alias("schema_id"), "pattern").distinct()
    )


def _all_topics() -> list[tuple[str, str]]:
    """Transitive closure of the fixed topic table, each topic above itself."""
    pairs = []
    for topic in {*TOPIC_PARENTS, *(p for ps in TOPIC_PARENTS.values() for p in ps)}:
        above, todo = set(), [topic]
        while todo:
            current = todo.pop()
            if current not in above:
                above.add(current)
                todo.extend(TOPIC_PARENTS.get(current, []))
        pairs += [(topic, a) for a in sorted(above)]
    return sorted(pairs)


def topic_rollup(outcomes: DataFrame) -> DataFrame:
    """Outcomes and successes per topic, each counted for its broader topics too.

    ``outcomes``: topic, success. Rows are summed per topic before they meet
    the small fixed topic table. Topics outside the table stand for themselves.
    """
    spark = outcomes.sparkSession
    table = spark.createDataFrame(_all_topics(), "topic string, above string")
    per_topic = outcomes.groupBy("topic").agg(F.count("*").alias("n"), F.count_if("success").alias("ok"))
    return (
        per_topic.join(F.broadcast(table), "topic", "left")
        .groupBy(F.coalesce("above", "topic").alias("topic"))
        .agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))
    )
