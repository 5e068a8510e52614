"""Scored knowledge records: listing, search, belief graph, feedback folds.

Beliefs: id, content, conviction (0..1), domain, category, usage_count.
Search rows: id, kind, content, conviction, domain, category, source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.scaling import top_k
from codeloom.operators.mesh import listing

# Stop words, stripped punctuation, colours, deltas in hundredths.
STOP_WORDS = (
    "should always never about using which their these those would could".split()
)
PUNCTUATION = ".,;:!?()\"'"
COLOURS = {"high": "#4CAF50", "medium": "#FFC107", "low": "#F44336"}
EDGE_COLOURS = {"MENTIONS": "#999999", "SAME_DOMAIN": "#2196F3", "SAME_CATEGORY": "#FF9800"}
ENTITY_COLOUR = "#9C27B0"
FEEDBACK_DELTAS = {"helpful": 5, "not_helpful": -3, "misleading": -10, "outdated": -5}
ADJUST_DELTAS = {"reinforce": 10, "weaken": -15}
REVIEW_BELOW = 30
AVOID_KEYWORDS = ("regex", "keyword")


def list_beliefs(beliefs, domain=None, category=None, min_conviction=None, limit=None) -> DataFrame:
    kept = beliefs
    for column, value in (("domain", domain), ("category", category)):
        kept = kept.filter(F.col(column) == value) if value else kept
    if min_conviction is not None:
        kept = kept.filter(F.col("conviction") >= min_conviction)
    return listing(kept, [F.col("conviction").desc(), "id"], limit)


def list_principles(principles, domain=None, min_conviction=None, limit=None) -> DataFrame:
    kept = principles.filter(F.col("domain") == domain) if domain else principles
    if min_conviction is not None:
        kept = kept.filter(F.col("conviction") >= min_conviction)
    return listing(kept, [F.col("conviction").desc(), "id"], limit)


def list_patterns(patterns, domain=None, limit=None) -> DataFrame:
    kept = patterns.filter(F.col("domain") == domain) if domain else patterns
    return listing(kept, [F.col("usage_count").desc(), F.col("conviction").desc(), "id"], limit)


def review_queue(items: DataFrame, limit: int | None = None) -> DataFrame:
    return listing(items.filter(~F.col("resolved")), [F.col("flagged_at").desc(), "id"], limit)


def resolve_reviews(items: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Close items named in ``resolutions`` (id, resolution); contents stay."""
    return items.join(resolutions, "id", "left").withColumn(
        "resolved", F.col("resolved") | F.col("resolution").isNotNull()
    )


def memory_union(beliefs: DataFrame, principles: DataFrame, patterns: DataFrame) -> DataFrame:
    """Beliefs, principles and patterns as one table of search rows.

    ``text`` is what keywords are looked up in, ``content`` what is shown.
    """
    none = F.lit(None).cast("string")
    return (
        beliefs.select("id", F.lit("belief").alias("kind"), "content", F.col("content").alias("text"),
                       "conviction", "domain", "category")
        .unionByName(principles.select("id", F.lit("principle").alias("kind"), "content", F.col("content").alias("text"),
                                       "conviction", "domain", none.alias("category")))
        .unionByName(patterns.select("id", F.lit("pattern").alias("kind"),
                                     F.concat_ws(": ", "name", "description").alias("content"),
                                     F.concat_ws(" ", "name", "description").alias("text"),
                                     "conviction", "domain", none.alias("category")))
    )


def keyword_search(memory: DataFrame, queries: Sequence[str], limit: int = 10,
                   domain: str | None = None, min_conviction: float | None = None) -> DataFrame:
    """Best rows per query by the share of query words contained in the text.

    The queries are arguments, so they are inlined into one projection: every
    text is read once for all of them and there is no join. A conviction bound
    of 0 means no bound, and patterns are exempt from it.
    """
    kept = memory.filter(F.col("domain") == domain) if domain else memory
    if min_conviction:
        kept = kept.filter((F.col("kind") == "pattern") | (F.col("conviction") >= min_conviction))
    scored = []
    for query in queries:
        words = [w.lower() for w in query.split()]
        if words:
            hits = sum((F.contains(F.col("_text"), F.lit(w)).cast("int") for w in words), F.lit(0))
            scored.append(F.struct(F.lit(query).alias("query"), (hits / F.lit(float(len(words)))).alias("score")))
    if not scored:
        return kept.select(F.lit("").alias("query"), "id", "kind", "content", "conviction", "domain", "category",
                           F.lit(0.0).alias("score")).filter(F.lit(False))
    flat = (
        kept.withColumn("_text", F.lower("text"))
        .select("id", "kind", "conviction", "domain", "category", F.inline(F.array(*scored)))
        .filter(F.col("score") > 0)
    )
    best = top_k(flat, ["query"], [F.col("score").desc(), F.col("kind"), F.col("id")], limit)
    # Long texts stay out of the ranking shuffle and join in afterwards.
    # At most ``limit`` rows a query, so the texts are not shuffled.
    return memory.select("kind", "id", "content").join(F.broadcast(best), ["kind", "id"])


def query_beliefs(memory: DataFrame, queries: Sequence[str], limit: int = 10,
                  category: str | None = None, min_conviction: float | None = None) -> DataFrame:
    """Top rows over all kinds first, then the beliefs among them."""
    found = keyword_search(memory, queries, limit, min_conviction=min_conviction).filter(F.col("kind") == "belief")
    return found.filter(F.col("category") == category) if category else found


def find_examples(memory: DataFrame, examples: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Code examples of the patterns among the best rows: k each, k overall.

    ``examples``: id (of the pattern), position, example.
    """
    best = keyword_search(memory, [query], limit).filter(F.col("kind") == "pattern").select("id", "score")
    joined = examples.join(F.broadcast(best), "id")
    per = top_k(joined, ["id"], [F.col("position")], limit)
    return per.orderBy(F.col("score").desc(), "id", "position").limit(limit).select("id", "position", "example")


def memory_counts(beliefs: DataFrame, principles: DataFrame, patterns: DataFrame) -> DataFrame:
    def one(df: DataFrame, kind: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")

    parts = one(beliefs, "beliefs").unionByName(one(principles, "principles")).unionByName(one(patterns, "patterns"))
    return parts.unionByName(parts.agg(F.sum("n").alias("n")).select(F.lit("total").alias("kind"), "n"))


def conviction_bands(beliefs: DataFrame) -> DataFrame:
    c = F.col("conviction")
    return beliefs.agg(
        F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"),
        F.count_if(c < 0.5).alias("low"),
    )


def vector_search(vectors: DataFrame, queries: Sequence[Sequence[float]], k: int = 10,
                  min_score: float | None = None, label: int | None = None) -> DataFrame:
    """Exact cosine top-k per query vector.

    Query vectors are arguments and become literals; each stored vector is read
    once, normalised once and scored against all of them. A vector or query of
    length zero has no direction and matches nothing. ``vectors``: id, embedding,
    label.
    """
    kept = vectors if label is None else vectors.filter(F.col("label") == label)

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    as_double = kept.select("id", F.transform("embedding", lambda x: x.cast("double")).alias("_v"))
    normed = as_double.withColumn("_n", F.sqrt(dot(F.col("_v"), F.col("_v"))))
    scored = []
    for i, query in enumerate(queries):
        size = sum(q * q for q in query) ** 0.5
        if not size:
            continue
        unit = F.array(*[F.lit(float(q) / size) for q in query])
        scored.append(F.struct(F.lit(i).alias("query"), F.try_divide(dot(F.col("_v"), unit), F.col("_n")).alias("score")))
    if not scored:
        scored.append(F.struct(F.lit(-1).alias("query"), F.lit(None).cast("double").alias("score")))
    flat = normed.select("id", F.inline(F.array(*scored))).withColumn("score", F.round("score", 6)).filter("score IS NOT NULL")
    if min_score is not None:
        flat = flat.filter(F.col("score") >= min_score)
    return top_k(flat, ["query"], [F.col("score").desc(), F.col("id")], k)


# ------------------------------------------------------------- belief graph


def belief_entities(beliefs: DataFrame, per_belief: int = 5) -> DataFrame:
    """Up to five key terms per belief, in text order."""
    words = F.split(F.lower("content"), r"(?U)\s+")
    long_words = F.filter(words, lambda w: (F.length(w) > 4) & ~w.isin(*STOP_WORDS))
    stripped = F.transform(F.slice(long_words, 1, per_belief), lambda w: F.btrim(w, F.lit(PUNCTUATION)))
    return beliefs.select("id", F.explode(F.filter(stripped, lambda w: w != "")).alias("entity"))


def _in_group(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def belief_pairs(beliefs: DataFrame) -> DataFrame:
    """How many other beliefs each belief is tied to, by tie.

    Two beliefs of one domain are tied by SAME_DOMAIN, otherwise two of one
    category by SAME_CATEGORY. Ties grow with the square of a group, so they
    are counted from group sizes; :func:`belief_ties` gives the members.
    """
    rows = beliefs.select("id", "domain", "category")
    by_domain = rows.filter(_in_group("domain")).groupBy("domain").agg(F.count("*").alias("_d"))
    by_category = rows.filter(_in_group("category")).groupBy("category").agg(F.count("*").alias("_c"))
    by_both = (
        rows.filter(_in_group("domain") & _in_group("category"))
        .groupBy("domain", "category").agg(F.count("*").alias("_dc"))
    )
    joined = rows.join(by_domain, "domain", "left").join(by_category, "category", "left").join(
        by_both, ["domain", "category"], "left"
    )
    own = F.when(_in_group("domain"), F.col("_dc")).otherwise(F.lit(1))
    return joined.select(
        "id",
        F.when(_in_group("domain"), F.col("_d") - 1).otherwise(F.lit(0)).cast("bigint").alias("same_domain"),
        F.when(_in_group("category"), F.col("_c") - own).otherwise(F.lit(0)).cast("bigint").alias("same_category"),
    )


def belief_ties(beliefs: DataFrame) -> DataFrame:
    """Membership of beliefs in domain and category hubs: the ties, factored.

    Members of one SAME_DOMAIN hub are tied pairwise; members of one
    SAME_CATEGORY hub are tied unless they share a domain.
    """
    def hub(column: str, tie: str) -> DataFrame:
        return beliefs.filter(_in_group(column)).select(
            F.col("id").alias("node"), F.concat(F.lit(f"{column}:"), F.col(column)).alias("hub"), F.lit(tie).alias("type")
        )

    return hub("domain", "SAME_DOMAIN").unionByName(hub("category", "SAME_CATEGORY"))


def ties_of(beliefs: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Explicit ties of a few named beliefs; linear in the beliefs."""
    few = F.broadcast(beliefs.filter(F.col("id").isin(*ids)).select(
        F.col("id").alias("id_a"), F.col("domain").alias("_da"), F.col("category").alias("_ca")))
    same_domain = beliefs.filter(_in_group("domain")).join(few, F.col("domain") == F.col("_da")).withColumn(
        "type", F.lit("SAME_DOMAIN"))
    same_category = beliefs.filter(_in_group("category")).join(
        few, (F.col("category") == F.col("_ca")) & ~F.coalesce((F.col("domain") == F.col("_da")) & _in_group("domain"), F.lit(False))
    ).withColumn("type", F.lit("SAME_CATEGORY"))
    return same_domain.unionByName(same_category).filter(F.col("id") != F.col("id_a")).select(
        "id_a", F.col("id").alias("id_b"), "type"
    )


def conviction_colour(conviction: Column) -> Column:
    return F.when(conviction >= 0.8, COLOURS["high"]).when(conviction >= 0.5, COLOURS["medium"]).otherwise(COLOURS["low"])


def short_label(text: Column, size: int = 50) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def belief_graph_nodes(beliefs: DataFrame) -> DataFrame:
    own = beliefs.select(
        "id", F.lit("belief").alias("type"), short_label(F.col("content")).alias("label"),
        conviction_colour(F.col("conviction")).alias("color"), (30 + F.col("conviction") * 20).alias("size"),
    )
    entities = belief_entities(beliefs).select("entity").distinct().select(
        F.concat(F.lit("entity-"), "entity").alias("id"), F.lit("entity").alias("type"),
        F.col("entity").alias("label"), F.lit(ENTITY_COLOUR).alias("color"), F.lit(15.0).alias("size"),
    )
    return own.unionByName(entities)


def belief_graph_edges(beliefs: DataFrame) -> DataFrame:
    """MENTIONS edges and the factored ties."""
    mentions = belief_entities(beliefs).select(
        F.col("id").alias("source"), F.concat(F.lit("entity-"), "entity").alias("target"), F.lit("MENTIONS").alias("type")
    )
    ties = belief_ties(beliefs).select(F.col("node").alias("source"), F.col("hub").alias("target"), "type")
    colour = F.when(F.col("type") == "MENTIONS", EDGE_COLOURS["MENTIONS"]).when(
        F.col("type") == "SAME_DOMAIN", EDGE_COLOURS["SAME_DOMAIN"]).otherwise(EDGE_COLOURS["SAME_CATEGORY"])
    return mentions.unionByName(ties).withColumn("color", colour)


def belief_graph_stats(beliefs: DataFrame) -> DataFrame:
    """Node and edge counts of the full graph, pairwise ties included."""
    mentions = belief_entities(beliefs).agg(
        F.count("*").alias("_mentions"), F.countDistinct("entity").alias("entity_count"))
    ties = belief_pairs(beliefs).agg(
        (F.coalesce(F.sum(F.col("same_domain") + F.col("same_category")), F.lit(0)) / 2).cast("bigint").alias("_ties"))
    own = beliefs.agg(F.count("*").alias("belief_count"), F.round(F.coalesce(F.avg("conviction"), F.lit(0.0)), 3).alias("avg_conviction"))
    # Three one-row results side by side, without a join.
    rows = own.unionByName(mentions, allowMissingColumns=True).unionByName(ties, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns]).select(
        (F.col("belief_count") + F.col("entity_count")).alias("node_count"),
        (F.col("_mentions") + F.col("_ties")).alias("edge_count"),
        "belief_count", "entity_count", "avg_conviction",
    )


def belief_links(beliefs: DataFrame) -> DataFrame:
    """Input of :func:`codeloom.operators.graph.shortest_path`."""
    mentions = belief_entities(beliefs).select(
        F.col("id").alias("node"), F.concat(F.lit("entity-"), "entity").alias("hub"), F.lit(False).alias("is_clique"))
    return mentions.unionByName(belief_ties(beliefs).select("node", "hub", F.lit(True).alias("is_clique")))


def entity_context(beliefs: DataFrame, entity: str | None = None) -> DataFrame:
    """Beliefs mentioning an entity, or every entity."""
    mentions = belief_entities(beliefs)
    if entity is not None:
        mentions = mentions.filter(F.col("entity") == entity)
    return mentions.distinct().join(beliefs.select("id", "conviction"), "id")


def entity_counts(beliefs: DataFrame) -> DataFrame:
    return belief_entities(beliefs).groupBy("entity").agg(F.count("*").alias("mentions"), F.countDistinct("id").alias("beliefs"))


def check_conflicts(texts: DataFrame, principles: DataFrame, min_conviction: float = 0.7) -> DataFrame:
    """Texts against principles that say never or avoid.

    ``texts``: id, content. Only two keywords are extracted from a principle,
    so a text conflicts with all principles holding a keyword it contains. One
    row per text and keyword, with the number of principles behind it; the
    principles are those of :func:`avoid_principles` with that keyword.
    """
    sizes = avoid_principles(principles, min_conviction).groupBy("keyword").agg(F.count("*").alias("n_principles"))
    lowered = F.lower("content")
    hits = texts.select("id", F.explode(F.filter(
        F.array(*[F.when(lowered.contains(k), F.lit(k)) for k in AVOID_KEYWORDS]), lambda k: k.isNotNull())).alias("keyword"))
    return hits.join(F.broadcast(sizes), "keyword").select("id", "keyword", "n_principles", F.lit(0.8).alias("confidence"))


def avoid_principles(principles: DataFrame, min_conviction: float = 0.7) -> DataFrame:
    lowered = F.lower("content")
    wanted = principles.filter((F.col("conviction") >= min_conviction) & (lowered.contains("never") | lowered.contains("avoid")))
    return wanted.select("id", F.explode(F.filter(
        F.array(*[F.when(lowered.contains(k), F.lit(k)) for k in AVOID_KEYWORDS]), lambda k: k.isNotNull())).alias("keyword"))


def validate_learning(items: DataFrame, max_chars: int = 2000) -> DataFrame:
    ok = (F.length("content") > 0) & (F.length("content") <= max_chars) & F.col("conviction").between(0, 1)
    return items.withColumn("is_valid", F.coalesce(ok, F.lit(False)))
