"""Judging URLs by host and path rules.

Each URL is expanded into expressions, a suffix of its host followed by a prefix
of its path. They meet the rules on the first digits of a digest; the whole
digest confirms, and the longest confirmed rule decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.tables import ascii_lower

#: Fixed values, from the contract: verdict, host and path in one.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Hexadecimal digits of the digest on which expressions and rules meet.
SHORT = 8


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(action, rule) from pairs; a rule is a host and a path that begins with a slash."""
    return spark.createDataFrame([(a, r) for a, r in rules], "action string, rule string")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for each row of ``pages``.

    A rule fits its host, all subdomains, and paths that begin with its path. The
    longest fitting rule decides; of two as long the one with the longer host, then
    the later one by code point. Where none fits the verdict is ``otherwise``. A URL
    is expanded only to the numbers of labels and the path lengths that rules have.
    Null urls and those without ``://`` have an empty host and fit nothing.
    """
    host, path = F.substring_index("rule", "/", 1), F.expr("substring(rule, locate('/', rule))")
    known = rules.filter(F.locate("/", F.col("rule")) > 1).select(
        "action", "rule", F.length(host).alias("host_length"), F.size(F.split(host, "[.]")).alias("labels"),
        F.length(path).alias("path_length"), F.sha2(F.col("rule").cast("binary"), 256).alias("rule_digest"),
    )
    shape = known.agg(F.collect_set("labels").alias("labels"), F.collect_set("path_length").alias("lengths")).first()
    of = lambda numbers: F.array(*[F.lit(int(n)) for n in sorted(numbers)]).cast("array<int>")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).select(
        F.monotonically_increasing_id().alias("row"), "page_id", "host", "path",
        of(shape.labels).alias("labels"), of(shape.lengths).alias("lengths"),
    )
    expressions = F.expr(
        """flatten(transform(filter(labels, n -> n <= size(split(host, '[.]')) and host <> ''),
             n -> transform(filter(lengths, l -> l <= length(path)),
               l -> concat(substring_index(host, '.', -n), substring(path, 1, l)))))"""
    )
    looked = rows.select("row", "page_id", "host", "path", F.explode_outer(expressions).alias("expression")).withColumn(
        "digest", F.sha2(F.col("expression").cast("binary"), 256)
    ).withColumn("short", F.substring("digest", 1, SHORT))
    met = looked.join(known.withColumn("short", F.substring("rule_digest", 1, SHORT)), "short", "left")
    rank = F.struct(F.length("rule").alias("length"), "host_length", "rule", "action")
    best = met.groupBy("row", "page_id", "host", "path").agg(
        F.max(F.when(F.col("digest") == F.col("rule_digest"), rank)).alias("best")
    )
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(otherwise)).alias("verdict"))
