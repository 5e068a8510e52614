"""Links between projects, from producer and consumer references.

References: type, identifier, direction, node_id, project_id.

All matching happens between distinct (project, identifier) pairs with counts,
never between single references: an identifier used by a third of all
references is one row per project and direction. Counts of links come from hubs,
one per shared name; pairs of projects are rows only where they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import scalars
from codeloom.functions.scaling import first_per_key
from codeloom.operators.mesh import ENDPOINT_TYPES

# Confidence per kind of match, in order of preference.
RANKS = {
    1: (0.95, "literal"),
    2: (0.85, "literal"),
    3: (0.85, "config"),
    4: (0.75, "config"),
    5: (0.70, "pattern"),
    6: (0.60, "pattern"),
}
MIN_CONFIDENCE = 0.5
CONFIG_ORDER = {"env": (1, 0.9), "docker-compose": (2, 0.85), "config": (3, 0.8)}

# Properties that name an outside resource -> (type, direction).
REFERENCE_PROPERTIES = {
    "queue_name": ("queue", "both"), "queue_url": ("queue", "both"), "topic_name": ("topic", "both"),
    "topic_arn": ("topic", "both"), "sqs_queue": ("queue", "both"), "kafka_topic": ("topic", "both"),
    "api_url": ("api", "produce"), "base_url": ("api", "produce"), "endpoint": ("api", "produce"),
    "service_url": ("api", "produce"), "table_name": ("database", "both"), "database_name": ("database", "both"),
    "db_name": ("database", "both"), "schema": ("database", "both"),
}


def collect_references(nodes: DataFrame) -> DataFrame:
    """What each node offers to or takes from other projects, by its type."""
    kind = F.col("type")
    prop = lambda name: F.nullif(F.col("properties")[name], F.lit(""))
    endpoint, data = kind.isin(*ENDPOINT_TYPES), kind.isin("Database", "Table", "Model")
    ref_type = (
        F.when(kind == "Topic", "topic").when(kind.isin("Queue", "Consumer", "Producer"), "queue").when(endpoint, "api")
        .when(kind == "ExternalService", "service").when(data, "database").when(kind == "ConfigValue", "config")
    )
    identifier = (
        F.when(kind.isin("Consumer", "Producer"), F.coalesce(prop("queue"), prop("topic"), F.col("name")))
        .when(endpoint, F.concat_ws(" ", F.coalesce(prop("method"), prop("http_method"), F.lit("GET")),
                                    F.coalesce(prop("path"), F.col("name"))))
        .otherwise(F.col("name"))
    )
    direction = (
        F.when(kind.isin("Consumer", "ConfigValue") | endpoint, "consume")
        .when(kind.isin("Producer", "ExternalService"), "produce").otherwise("both")
    )
    return nodes.select(
        ref_type.alias("type"), identifier.alias("identifier"), direction.alias("direction"),
        F.col("id").alias("node_id"), "project_id", F.col("file").alias("source_file"), "confidence",
    ).filter("type IS NOT NULL")


def collect_property_references(nodes: DataFrame) -> DataFrame:
    """References named by well-known properties, at confidence 0.6."""
    each = nodes.select("id", "project_id", "file", F.explode("properties").alias("_key", "identifier"))
    kind, direction = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (t, d) in REFERENCE_PROPERTIES.items():
        kind = F.when(F.col("_key") == name, t).otherwise(kind)
        direction = F.when(F.col("_key") == name, d).otherwise(direction)
    return each.filter(F.col("identifier") != "").select(
        kind.alias("type"), "identifier", direction.alias("direction"), F.col("id").alias("node_id"), "project_id",
        F.col("file").alias("source_file"), F.lit(0.6).alias("confidence"), F.col("_key").alias("source"),
    ).filter("type IS NOT NULL")


def best_config(config: DataFrame) -> DataFrame:
    """One value per project and name: environment, then compose, then config."""
    order, confidence = F.lit(9), F.lit(0.0)
    for method, (place, value) in CONFIG_ORDER.items():
        order = F.when(F.col("method") == method, place).otherwise(order)
        confidence = F.when(F.col("method") == method, value).otherwise(confidence)
    ranked = config.filter(F.col("value") != "").select(
        "project_id", "name", "value", "method", order.alias("_order"), confidence.alias("confidence"))
    return first_per_key(ranked, ["project_id", "name"], [F.col("_order"), F.col("value")]).drop("_order")


def resolve_identifiers(refs: DataFrame, config: DataFrame) -> DataFrame:
    """Identifiers with variables replaced from the project's configuration.

    Only distinct identifiers holding a ``$`` are looked up. ``resolved`` is null
    where nothing was replaced; confidence is that of the weakest value used.
    """
    rule = r"(\$\{[A-Z_][A-Z0-9_]*\}|\$[A-Z_][A-Z0-9_]*)"
    asked = refs.filter(scalars.has_variable("identifier")).select("project_id", "identifier").distinct()
    tokens = asked.select("*", F.posexplode(F.regexp_extract_all("identifier", F.lit(rule), F.lit(1))).alias("_at", "_token"))
    named = tokens.withColumn("name", F.regexp_replace("_token", r"[${}]", ""))
    values = named.join(best_config(config).select("project_id", "name", "value", "confidence"), ["project_id", "name"])
    # The tokens of one identifier are a handful, so this list stays small.
    found = values.groupBy("project_id", "identifier").agg(
        F.array_sort(F.collect_list(F.struct("_at", "_token", "value"))).alias("_subs"), F.min("confidence").alias("confidence"))
    resolved = F.aggregate("_subs", F.col("identifier"), lambda s, t: F.replace(s, t["_token"], t["value"]))
    return found.select("project_id", "identifier", resolved.alias("resolved"), "confidence").filter(
        F.col("resolved") != F.col("identifier"))


def _identifiers(refs: DataFrame, config: DataFrame) -> DataFrame:
    """Distinct identifiers per project and direction, how often each is referenced, and what it resolves to."""
    resolved = resolve_identifiers(refs, config).select("project_id", "identifier", F.col("resolved").alias("_r"))
    return (
        refs.groupBy("type", "project_id", "identifier", "direction").agg(F.count("*").alias("n"))
        .join(resolved, ["project_id", "identifier"], "left")
        .withColumn("resolved", F.coalesce("_r", "identifier")).drop("_r")
    )


def _rank_keys() -> dict[int, Column]:
    """Per preference rank the key that two identifiers of a match share."""
    ident, resolved = F.col("identifier"), F.col("resolved")
    kind = F.col("type")
    pattern = (
        F.when(kind.isin("queue", "topic"), scalars.queue_name(ident))
        .when(kind == "api", scalars.api_path(ident))
        .when(kind == "database", scalars.table_name(ident))
    )
    return {1: ident, 2: F.lower(ident), 3: resolved, 4: F.lower(resolved), 5: pattern,
            6: F.when(kind == "api", scalars.without_verb(scalars.api_path(ident)))}


#: Ranks whose keys identifiers are joined on: equal identifiers are equal in lower case too, so these meet all pairs of the others.
_JOINED = (2, 4, 5, 6)


def _keys(grouped: DataFrame) -> DataFrame:
    """One row per joined rank under which an identifier can be matched, with the key of rank 5."""
    keys = _rank_keys()
    each = F.array(*[F.struct(F.lit(r).alias("at"), keys[r].alias("key")) for r in _JOINED])
    return grouped.select("*", keys[5].alias("pattern"), F.inline(F.filter(each, lambda k: k["key"].isNotNull())))


def _best_rank() -> Column:
    """Best rank of a pair that met under the joined rank ``at``; null where it meets under a better one as well."""
    same = lambda name, fold=lambda c: c: fold(F.col(f"p.{name}")) == fold(F.col(f"c.{name}"))
    met = F.when(same("identifier", F.lower), 2).when(same("resolved", F.lower), 4).when(same("pattern"), 5).otherwise(6)
    exact = F.when((met == 2) & same("identifier"), 1).when((met == 4) & same("resolved"), 3).otherwise(met)
    return F.when(met == F.col("p.at"), exact)


def _by_rank(rank: Column, place: int, kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for r, values in RANKS.items():
        out = F.when(rank == r, values[place]).otherwise(out)
    return out


def match_references(refs: DataFrame, config: DataFrame, min_confidence: float = MIN_CONFIDENCE, project_id: str | None = None) -> DataFrame:
    """Producer and consumer identifiers that mean the same thing.

    One row per (type, producing project, identifier and direction, consuming
    project and identifier) with the best rank, and how many references stand
    on each side; ``n_pairs`` reference pairs are linked by it. The rows are the
    square of the projects that share an identifier; with ``project_id`` only
    those with that project at one end are made, which is linear in the others.
    A pair that meets under several ranks is kept under the best of them alone, as
    its keys tell, so pairs are not shuffled. Counts over all projects come from :func:`link_counts` without any pair.
    """
    known = _identifiers(refs, config)
    # What an identifier matches does not depend on the direction, so a consumer is one row.
    taken = known.filter(F.col("direction").isin("consume", "both")).groupBy("type", "project_id", "identifier").agg(
        F.first("resolved").alias("resolved"), F.sum("n").alias("n"))
    producers, consumers = _keys(known.filter(F.col("direction").isin("produce", "both"))).alias("p"), _keys(taken).alias("c")
    makes, takes = F.col("p.project_id"), F.col("c.project_id")
    meets = (F.col("p.type") == F.col("c.type")) & (F.col("p.at") == F.col("c.at")) & (F.col("p.key") == F.col("c.key")) & (makes != takes)
    meet = lambda p, c: p.join(c, meets).select(
        "p.type", makes.alias("from_project"), F.col("p.identifier").alias("from_identifier"), F.col("p.direction").alias("from_direction"),
        takes.alias("to_project"), F.col("c.identifier").alias("to_identifier"), _best_rank().alias("rank"),
        F.col("p.n").alias("n_from"), F.col("c.n").alias("n_to")).filter("rank IS NOT NULL")
    if project_id is None:
        best = meet(producers, consumers)
    else:
        best = meet(producers.filter(makes == project_id), consumers).unionByName(
            meet(producers.filter(makes != project_id), consumers.filter(takes == project_id)))
    return (
        best.withColumn("confidence", _by_rank(F.col("rank"), 0, "double")).withColumn("method", _by_rank(F.col("rank"), 1, "string"))
        .withColumn("n_pairs", F.col("n_from") * F.col("n_to")).filter(F.col("confidence") >= min_confidence)
    )


def _counted_sets() -> dict[tuple[int, ...], dict[int, int]]:
    """For every set of ranks whose keys are grouped together: in which best rank its pairs count, and with which sign.

    Equal identifiers are equal in lower case too, so rank 1 lies within rank 2
    and rank 3 within rank 4. What a rank adds to those before it follows by
    inclusion and exclusion over the ranks that lie within no other.
    """
    counted: dict[tuple[int, ...], dict[int, int]] = {}
    before = {1: [], 2: [], 3: [2], 4: [2], 5: [2, 4], 6: [2, 4, 5]}
    inner = {2: 1, 4: 3}
    for rank, others in before.items():
        for chosen in range(1 << len(others)):
            also = [o for k, o in enumerate(others) if chosen >> k & 1]
            sign = (-1) ** len(also)
            for own, turn in ((rank, 1), (inner.get(rank), -1)):
                if own is not None:
                    at = counted.setdefault(tuple(sorted({own, *also})), {})
                    at[rank] = at.get(rank, 0) + sign * turn
    return {ranks: {r: n for r, n in of.items() if n} for ranks, of in counted.items()}


def link_hubs(refs: DataFrame, config: DataFrame, sets: tuple[tuple[int, ...], ...] = ((1,), (2,), (3,), (4,), (5,), (6,))) -> DataFrame:
    """Per type, set of ranks and key: the projects and references on either side, and the reference pairs between projects.

    A hub stands for all links through one name. Pairs within a project are no
    links; they are taken off by project. Nothing grows beyond the identifiers.
    """
    keys = _rank_keys()
    each = F.array(*[F.struct(F.lit(k).alias("set"), F.array(*[keys[r] for r in ranks]).alias("key")) for k, ranks in enumerate(sets)])
    whole = F.filter(each, lambda s: F.forall(s["key"], lambda k: k.isNotNull()))
    rows = _identifiers(refs, config).select("type", "project_id", "direction", "n", F.inline(whole))
    side = lambda role: F.sum(F.when(F.col("direction").isin(role, "both"), F.col("n")).otherwise(0))
    per = rows.groupBy("type", "set", "key", "project_id").agg(side("produce").alias("_p"), side("consume").alias("_c"))
    return per.groupBy("type", "set", "key").agg(
        F.count_if(F.col("_p") > 0).alias("from_projects"), F.count_if(F.col("_c") > 0).alias("to_projects"),
        F.sum("_p").alias("n_from"), F.sum("_c").alias("n_to"), (F.sum("_p") * F.sum("_c") - F.sum(F.col("_p") * F.col("_c"))).alias("n_pairs"))


def link_counts(refs: DataFrame, config: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Reference pairs per type and best rank, the same as by :func:`match_references`, from the sizes of hubs alone."""
    sets = _counted_sets()
    signs = F.array(*[F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(n).alias("sign")) for r, n in of.items()]) for of in sets.values()])
    totals = link_hubs(refs, config, tuple(sets)).groupBy("type", "set").agg(F.sum("n_pairs").alias("n_pairs"))
    signed = totals.select("type", "n_pairs", F.inline(F.get(signs, F.col("set"))))
    return (
        signed.groupBy("type", "rank").agg(F.sum(F.col("sign") * F.col("n_pairs")).alias("n_pairs"))
        .withColumn("confidence", _by_rank(F.col("rank"), 0, "double")).withColumn("method", _by_rank(F.col("rank"), 1, "string"))
        .filter((F.col("n_pairs") > 0) & (F.col("confidence") >= min_confidence))
    )


def link_type(kind: Column) -> Column:
    return F.when(kind.isin("queue", "topic"), "queue").when(kind == "database", "database").otherwise("api")


def create_links(matches: DataFrame, bidirectional: bool = True) -> DataFrame:
    """Link rows with a forward and, if asked, a reverse edge each."""
    kind = F.col("type")
    produces = F.col("from_direction") == "produce"
    forward = (
        F.when(kind.isin("queue", "topic"), F.when(produces, "PUBLISHES_TO").otherwise("SUBSCRIBES_TO"))
        .when(kind.isin("api", "service"), "CALLS_SERVICE")
        .when(kind == "database", F.when(produces, "WRITES_TO").otherwise("READS_FROM")).otherwise("DEPENDS_ON")
    )
    reverse = (
        F.when(kind.isin("queue", "topic"), "SUBSCRIBES_TO").when(kind.isin("api", "service"), "HANDLED_BY")
        .when(kind == "database", "READS_FROM").otherwise("DEPENDS_ON")
    )
    resolution = F.when(F.col("method").isin("literal", "config"), F.col("method")).otherwise("ai")
    ends = lambda a, b, edge, back: F.struct(
        F.col(f"{a}_project").alias("source_project"), F.col(f"{a}_identifier").alias("source_identifier"),
        F.col(f"{b}_project").alias("target_project"), F.col(f"{b}_identifier").alias("target_identifier"),
        edge.alias("edge_type"), F.lit(back).alias("is_reverse"))
    edges = [ends("from", "to", forward, False)] + ([ends("to", "from", reverse, True)] if bidirectional else [])
    return matches.select(
        link_type(kind).alias("link_type"), kind.alias("reference_type"), F.col("from_direction"), "confidence",
        resolution.alias("resolution_method"), "n_pairs", F.inline(F.array(*edges)),
    )


def link_members(matches: DataFrame, refs: DataFrame) -> DataFrame:
    """The nodes behind the identifiers that were matched, per role."""
    ends = [F.struct(F.col(f"{side}_project").alias("project_id"), F.col(f"{side}_identifier").alias("identifier"), F.lit(role).alias("role"))
            for side, role in (("from", "producer"), ("to", "consumer"))]
    wanted = matches.select("type", F.inline(F.array(*ends))).distinct()
    fits = ((F.col("role") == "producer") & F.col("direction").isin("produce", "both")) | (
        (F.col("role") == "consumer") & F.col("direction").isin("consume", "both"))
    return refs.join(wanted, ["type", "project_id", "identifier"]).filter(fits).select(
        "type", "project_id", "identifier", "role", "node_id")


def link_stats(counts: DataFrame, bidirectional: bool = True) -> DataFrame:
    """Matched reference pairs, links and edges per producer type, from :func:`link_counts`."""
    per = F.lit(2 if bidirectional else 1)
    return counts.groupBy("type").agg(
        F.sum("n_pairs").alias("matches"), F.sum("n_pairs").alias("links"), (F.sum("n_pairs") * per).alias("edges"))
