"""Mixing sources to target weights.

Words are summed per source, each source gets a target by its weight, and the
quotient of target and size is its repetition rate. A document comes out
floor(rate) times, plus once more if a hash of its id falls below the fraction.
The copies of a document depend on its id and its source's rate alone, so a
second run, or a task that is run again, gives the same mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.tables import stored, word_count

#: Weights of the sources in order, repeating. Fixed values, from the contract.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of every document; a null text has none."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def _ranked(sources: DataFrame) -> DataFrame:
    """Number the sources by code point, null last, from 0.

    Ranges of sources are numbered apart and shifted by the counts of the ranges
    before them, so no task holds all sources, however many there are.
    """
    spark = sources.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    cut = stored(sources.repartitionByRange(ranges, order).withColumn("block", F.spark_partition_id()), "sources")
    blocks = cut.groupBy("block").count()
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = blocks.select("block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    inside = F.row_number().over(Window.partitionBy("block").orderBy(order)) - 1
    return cut.withColumn("inside", inside).join(shifts, "block").select("source", "source_size", (F.col("inside") + F.col("shift")).alias("rank"))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """(source, source_size, target) from (source, size).

    The targets share ``share`` times all words by weight. None passes ``most``
    times its source's size; what is cut off goes to the others by weight. At the
    end each target is the smaller of that bound and weight times one common
    level, so every round needs two sums over the sources to raise the level,
    until no further source meets its bound. A source without words has target 0.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stored(_ranked(sources).select("source", "source_size", weight.alias("weight")), "weights")
    bound = F.col("source_size") * F.lit(float(most))
    total = ranked.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    level, held = 0.0, -1
    if total.words:
        level = share * total.words / total.weights
    while total.words:
        over = bound < F.col("weight") * F.lit(level)
        now = ranked.agg(
            F.count_if(over).alias("held"),
            F.sum(F.when(over, bound).otherwise(0.0)).alias("taken"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free"),
        ).first()
        if now.held == held or not now.free:
            break
        held, level = now.held, (share * total.words - now.taken) / now.free
    return ranked.select("source", "source_size", F.least(bound, F.col("weight") * F.lit(level)).alias("target"))


def _chance(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _copies(doc_id: Column, seed: int) -> Column:
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    return (F.floor(rate) + (_chance(doc_id, seed) < rate - F.floor(rate)).cast("long")).cast("long")


def mixed_sizes(docs: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every document.

    The texts are read once; the joins carry numbers only. Null sources form one
    source of their own. Rows with equal ids are mixed alike.
    """
    sizes = stored(document_sizes(docs), "sizes")
    targets = stored(source_targets(sizes), "targets")
    joined = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"]))
    copies = _copies(F.col("doc_id"), seed)
    return joined.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns and no others."""
    targets = stored(source_targets(stored(document_sizes(docs), "sizes")), "targets").withColumnRenamed("source", "of")
    rows = docs.select(F.struct("*").alias("doc")).join(targets, F.col("doc.source").eqNullSafe(F.col("of")))
    copies = _copies(F.col("doc.doc_id"), seed)
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select("doc.*")
