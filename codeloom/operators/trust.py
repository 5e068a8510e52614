"""Trust in extraction patterns, from verification logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.scaling import first_per_key, hash_rate, top_k

# Required properties per node type.
REQUIRED_PROPERTIES = {
    "ApiEndpoint": ["method", "path"],
    "Function": ["parameters", "return_type"],
    "Class": ["bases"],
    "Model": ["fields"],
}


def trust_level(accuracy: Column, total: Column, correction_rate: Column | None = None) -> Column:
    """Level by accuracy and sample size; the correction rate binds only if given."""
    strict = correction_rate <= 0.05 if correction_rate is not None else F.lit(True)
    loose = correction_rate <= 0.10 if correction_rate is not None else F.lit(True)
    return (
        F.when((accuracy >= 0.95) & strict & (total >= 100), "trusted")
        .when((accuracy >= 0.90) & loose & (total >= 50), "high")
        .when((accuracy >= 0.80) & (total >= 20), "medium")
        .otherwise("low")
    )


def sample_rate(level: Column) -> Column:
    return F.when(level == "trusted", 0.05).when(level == "high", 0.2).when(level == "medium", 0.5).otherwise(1.0)


def trust_scores(verifications: DataFrame) -> DataFrame:
    """Counters, rates, level and sample rate per (schema, pattern)."""
    def of(result: str) -> Column:
        return F.count_if(F.col("result") == result).alias(result)

    counted = verifications.groupBy("schema_id", "pattern_name").agg(
        F.count("*").alias("total"), of("verified"), of("corrected"), of("rejected")
    )
    rates = counted.select(
        "*",
        (F.col("verified") / F.col("total")).alias("accuracy"),
        (F.col("corrected") / F.col("total")).alias("correction_rate"),
        (F.col("rejected") / F.col("total")).alias("rejection_rate"),
    ).withColumn("trust_level", trust_level(F.col("accuracy"), F.col("total"), F.col("correction_rate")))
    return rates.withColumn("sample_rate", sample_rate(F.col("trust_level")))


def trust_summary(scores: DataFrame) -> DataFrame:
    levels = [F.count_if(F.col("trust_level") == v).alias(f"n_{v}") for v in ("low", "medium", "high", "trusted")]
    return scores.agg(
        F.count("*").alias("total_patterns"), *levels,
        F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("average_accuracy"),
        F.sum("total").alias("total_extractions"),
        F.sum("corrected").alias("total_corrections"),
        (F.sum("verified") / F.sum(F.col("verified") + F.col("corrected") + F.col("rejected"))).alias("run_accuracy"),
    )


def schema_trust(scores: DataFrame, versions: DataFrame) -> DataFrame:
    """Trust per schema over its active patterns."""
    active = versions.filter("is_active").select("schema_id", F.col("name").alias("pattern_name"))
    per = scores.join(active, ["schema_id", "pattern_name"], "left_semi").groupBy("schema_id").agg(
        F.avg("accuracy").alias("accuracy"), F.sum("total").alias("total")
    )
    level = trust_level(F.col("accuracy"), F.col("total"))
    return per.withColumn("trust_level", level).withColumn("sample_rate", sample_rate(F.col("trust_level")))


def patterns_needing_evolution(scores: DataFrame, versions: DataFrame, min_samples: int = 20,
                               max_corrections: float = 0.10, max_rejections: float = 0.05,
                               limit: int | None = None) -> DataFrame:
    active = versions.filter("is_active").select("schema_id", F.col("name").alias("pattern_name"))
    poor = scores.join(active, ["schema_id", "pattern_name"], "left_semi").filter(
        (F.col("total") >= min_samples)
        & ((F.col("correction_rate") > max_corrections) | (F.col("rejection_rate") > max_rejections))
    )
    return poor if limit is None else poor.orderBy("accuracy", "schema_id", "pattern_name").limit(limit)


def evolution_evidence(candidates: DataFrame, corrections: DataFrame) -> DataFrame:
    """All corrections of the candidate patterns, one row each; no lists."""
    keyed = candidates.select(F.concat_ws("/", "schema_id", "pattern_name").alias("pattern_id"), "accuracy")
    return corrections.join(keyed, "pattern_id")


def latest_corrections(corrections: DataFrame, n: int = 5) -> DataFrame:
    return top_k(corrections, ["pattern_id"], [F.col("created_at").desc(), F.col("id").desc()], n)


def top_trust(scores: DataFrame, n: int = 20) -> DataFrame:
    return scores.orderBy(F.col("accuracy").desc(), "schema_id", "pattern_name").limit(n)


def active_patterns(versions: DataFrame, limit: int | None = None) -> DataFrame:
    kept = versions.filter("is_active")
    return kept if limit is None else kept.orderBy("schema_id", "name").limit(limit)


def current_version(versions: DataFrame) -> DataFrame:
    return first_per_key(versions, ["schema_id", "name"], [-F.col("version")])


def evolve_patterns(versions: DataFrame, new_regexes: DataFrame) -> DataFrame:
    """Close the evolved versions and add their successors.

    ``new_regexes``: id, new_regex (one per id). A successor has version + 1,
    counters at zero, and points at what it came from.
    """
    joined = versions.join(new_regexes.select("id", "new_regex"), "id", "left")
    old = joined.select(
        "id", "schema_id", "name", "version", "regex",
        (F.col("is_active") & F.col("new_regex").isNull()).alias("is_active"),
        F.lit(None).cast("string").alias("evolved_from"),
    )
    new = joined.filter("new_regex IS NOT NULL").select(
        F.concat_ws("::", "schema_id", "name", F.concat(F.lit("v"), (F.col("version") + 1).cast("string"))).alias("id"),
        "schema_id", "name", (F.col("version") + 1).alias("version"), F.col("new_regex").alias("regex"),
        F.lit(True).alias("is_active"), F.col("id").alias("evolved_from"),
    )
    return old.unionByName(new)


def route_tier(matches: DataFrame, ai_enabled: bool = True) -> DataFrame:
    """Processing tier per file from its best schema match.

    ``matches``: path, score (null when nothing matched), trust, is_evolved.
    """
    trust, score = F.col("trust"), F.col("score")
    ai = F.lit(ai_enabled)
    tier = (
        F.when(score.isNull(), F.when(ai, 3).otherwise(1))
        .when((trust >= 0.9) & F.col("is_evolved") & (score >= 0.4), 1)
        .when((score >= 0.5) & (trust < 0.7) & ai, 2)
        .otherwise(1)
    )
    return matches.withColumn("tier", tier)


def enhancement_candidates(nodes: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Non-file nodes with low confidence or a required property missing."""
    def missing(name: str) -> Column:
        value = F.coalesce(F.col("properties")[name], F.lit(""))
        return (value == "") | (value == "unknown")

    lacking = F.lit(False)
    for node_type, names in REQUIRED_PROPERTIES.items():
        any_missing = missing(names[0])
        for name in names[1:]:
            any_missing = any_missing | missing(name)
        lacking = lacking | ((F.col("type") == node_type) & any_missing)
    low = F.col("confidence") < threshold
    return nodes.filter((F.col("type") != "File") & (low | lacking)).withColumn(
        "reason", F.when(low, "low_confidence").otherwise("missing_property")
    )


def verification_sample(extracted: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows to verify: all of unscored patterns, else the level's share by id hash.

    ``extracted``: id, schema_id, pattern_name.
    """
    rates = scores.select("schema_id", "pattern_name", "sample_rate")
    joined = extracted.join(rates, ["schema_id", "pattern_name"], "left")
    return joined.filter(
        F.col("sample_rate").isNull() | hash_rate(F.col("id"), F.col("sample_rate"))
    ).select(*extracted.columns)


def flat_sample(extracted: DataFrame, rate: float, cap: int | None = None) -> DataFrame:
    """One rate for all rows; ``cap`` bounds the budget by id hash order."""
    kept = extracted.filter(hash_rate(F.col("id"), rate))
    return kept if cap is None else kept.orderBy(F.xxhash64("id"), "id").limit(cap)


def extraction_outcomes(outcomes: DataFrame) -> DataFrame:
    """Success per language: no rejection, enough nodes, few corrections.

    ``outcomes``: language, n_nodes, expected_nodes, corrections, rejections.
    """
    success = (
        (F.col("rejections") == 0)
        & ~(F.coalesce(F.col("expected_nodes"), F.lit(0)).cast("boolean") & (F.col("n_nodes") * 10 < F.col("expected_nodes") * 8))
        & (F.col("corrections") * 10 < F.greatest(F.col("n_nodes"), F.lit(1)))
    )
    return outcomes.withColumn("success", success)


def success_rates(outcomes: DataFrame, key: str = "language") -> DataFrame:
    return extraction_outcomes(outcomes).groupBy(key).agg(
        F.count("*").alias("n"), F.count_if("success").alias("n_success"),
        (F.count_if("success") / F.count("*")).alias("success_rate"),
    )


def tier_mix(results: DataFrame) -> DataFrame:
    counts = results.groupBy("language").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("tier") == t).alias(f"tier{t}") for t in (1, 2, 3)]
    )
    return counts.withColumn("healthy", F.col("tier1") / F.col("total") > 0.7)


def schema_health(rates: DataFrame, low_trust: float = 0.7) -> DataFrame:
    accuracy = F.col("success_rate")
    return rates.select(
        "*",
        F.when(accuracy >= 0.8, "high").when(accuracy >= 0.6, "medium").otherwise("low").alias("trust_level"),
        (accuracy < low_trust).alias("needs_evolution"),
    )


def suggestion_counts(suggestions: DataFrame, min_total: int = 5, min_pattern: int = 3) -> DataFrame:
    """Patterns seen often enough in frameworks suggested often enough.

    ``suggestions``: framework, pattern.
    """
    per_pattern = suggestions.groupBy("framework", "pattern").agg(F.count("*").alias("n"))
    totals = per_pattern.groupBy("framework").agg(F.sum("n").alias("framework_total")).filter(
        F.col("framework_total") >= min_total
    )
    return per_pattern.filter(F.col("n") >= min_pattern).join(totals, "framework")


def discovery_cost(files: DataFrame, max_size: int = 50_000) -> DataFrame:
    """Files a costly discovery pass would take, and its token budget."""
    taken = F.col("size") <= max_size
    tokens = F.least(F.col("size") / 4, F.lit(8000.0)) + 2000
    return files.agg(
        F.count_if(taken).alias("processable"), F.count_if(~taken).alias("skipped"),
        F.coalesce(F.sum(F.when(taken, tokens)), F.lit(0.0)).alias("tokens"),
    )


def discovery_confidence(files: DataFrame, nodes: DataFrame, boosts: DataFrame | None = None) -> DataFrame:
    """Mean node confidence per file, 0 without nodes, plus a tenth of a boost."""
    mean = nodes.groupBy("file").agg(F.avg("confidence").alias("confidence"))
    joined = files.select("file").join(mean, "file", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    if boosts is None:
        return joined
    boosted = joined.join(boosts, "file", "left")
    return boosted.select(
        "file", F.least(F.lit(1.0), F.col("confidence") + F.coalesce("boost", F.lit(0.0)) * 0.1).alias("confidence")
    )
