"""Order-dependent state as a composition of clamp maps.

One feedback event maps a conviction x to min(h, max(l, x + a)). Two such maps
compose to a third. The events are sorted by belief and time over ranges and
numbered within each range, and a long run is folded bottom-up over blocks of
numbers, then blocks of blocks. No block ever holds more than `BLOCK` children,
however hot its belief and however crowded an instant is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.scaling import first_per_key
from codeloom.session import cut_lineage
from codeloom.operators.memory import ADJUST_DELTAS, FEEDBACK_DELTAS, REVIEW_BELOW

#: Children of a block, a power of two.
BLOCK = 1024
#: Levels of blocks. Numbers have a range in their upper bits and a place in the lower 33.
RUNGS = ("block1", "block2", "block3", "block4", "block5")
_TOP = 1_000_000


def _clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(high, F.greatest(low, x))


def _then(first: Column, second: Column) -> Column:
    """The map that applies ``first`` and then ``second``."""
    return F.struct(
        (first["a"] + second["a"]).alias("a"),
        _clamp(first["l"] + second["a"], second["l"], second["h"]).alias("l"),
        _clamp(first["h"] + second["a"], second["l"], second["h"]).alias("h"),
    )


def _fold(maps: Column) -> Column:
    unit = F.struct(F.lit(0).alias("a"), F.lit(-_TOP).alias("l"), F.lit(_TOP).alias("h"))
    return F.aggregate(maps, unit, lambda acc, m: _then(acc, m["map"]))


def _apply(state: Column, mapping: Column) -> Column:
    return _clamp(state + mapping["a"], mapping["l"], mapping["h"])


def _events(events: DataFrame, deltas: dict[str, int], kind: str) -> DataFrame:
    """Events as maps on hundredths, with their block on every rung.

    The order is written down, since a range depends on the sample it was cut by.
    """
    delta = F.lit(0)
    for name, value in deltas.items():
        delta = F.when(F.col(kind) == name, value).otherwise(delta)
    one = F.struct(delta.alias("a"), F.lit(0).alias("l"), F.lit(100).alias("h"))
    order = ["belief_id", "ts", "event_id"]
    ordered = cut_lineage(
        events.select(*order, kind).repartitionByRange(*order).sortWithinPartitions(*order)
        .select(*order, F.col(kind).alias("what"), one.alias("map"), F.monotonically_increasing_id().alias("place")))
    bits = BLOCK.bit_length() - 1
    return ordered.select("*", *[F.shiftright("place", bits * (k + 1)).alias(f"_{r}") for k, r in enumerate(RUNGS)])


def _runs(mapped: DataFrame, key: str) -> list[DataFrame]:
    """Per rung: key, block, its ordered children; then the map of each key."""
    levels = []
    child, current = None, mapped
    for i, rung in enumerate([*RUNGS, None]):
        bucket = [f"_{r}" for r in RUNGS[i:]]
        members = F.struct("place", "event_id", "what", "map") if child is None else F.struct(child, "map")
        level = current.groupBy(key, *bucket).agg(F.array_sort(F.collect_list(members)).alias("children"))
        levels.append(level)
        current = level.select(key, *bucket, _fold(F.col("children")).alias("map"))
        child = f"_{rung}" if rung else None
    levels.append(current)
    return levels


def composed(events: DataFrame, deltas: dict[str, int], kind: str) -> DataFrame:
    """All events of each belief as one map."""
    return _runs(_events(events, deltas, kind), "belief_id")[-1]


def feedback_fold(beliefs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Conviction (hundredths) and usage of every belief after all feedback.

    ``beliefs``: id, conv_pct, usage_count. ``outcomes``: belief_id, event_id,
    ts, outcome.
    """
    total = composed(outcomes, FEEDBACK_DELTAS, "outcome").select(F.col("belief_id").alias("id"), "map")
    uses = outcomes.groupBy(F.col("belief_id").alias("id")).agg(F.count("*").alias("_uses"))
    return (
        beliefs.select("id", "conv_pct", "usage_count").join(total, "id", "left").join(uses, "id", "left")
        .select(
            "id",
            F.coalesce(_apply(F.col("conv_pct"), F.col("map")), F.col("conv_pct")).cast("int").alias("conv_pct"),
            (F.col("usage_count") + F.coalesce("_uses", F.lit(0))).cast("bigint").alias("usage_count"),
        )
    )


def apply_log(beliefs: DataFrame, log: DataFrame) -> DataFrame:
    """Beliefs after a log of maps (belief_id, map, uses, batch), in batch order."""
    # Batches are folded by the thousand first, so a long log makes no long list.
    thousand = F.floor(F.col("batch") / 1000)
    parts = log.groupBy(F.col("belief_id").alias("id"), thousand.alias("_part")).agg(
        F.array_sort(F.collect_list(F.struct("batch", "map"))).alias("_maps"), F.sum("uses").alias("_uses"))
    per = parts.select("id", "_part", _fold(F.col("_maps")).alias("map"), "_uses").groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("_part", "map"))).alias("_maps"), F.sum("_uses").alias("_uses"))
    after = beliefs.select("id", "conv_pct", "usage_count").join(per.select("id", _fold(F.col("_maps")).alias("map"), "_uses"), "id", "left")
    return after.select(
        "id", F.coalesce(_apply(F.col("conv_pct"), F.col("map")), F.col("conv_pct")).cast("int").alias("conv_pct"),
        (F.col("usage_count") + F.coalesce("_uses", F.lit(0))).cast("bigint").alias("usage_count"))


def feedback_states(beliefs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Conviction before and after every single event, and its outcome.

    Goes down the ladder again: the state entering a bucket is handed to its
    children, one rung at a time.
    """
    levels = _runs(_events(outcomes, FEEDBACK_DELTAS, "outcome"), "belief_id")[:-1]
    entering = beliefs.select(F.col("id").alias("belief_id"), F.col("conv_pct").alias("state"))
    for i in range(len(levels) - 1, -1, -1):
        bucket = [f"_{r}" for r in RUNGS[i:]]
        joined = levels[i].join(entering, ["belief_id", *bucket])
        start = F.struct(F.col("state").alias("state"), F.array().cast("array<int>").alias("seen"))
        seen = F.aggregate("children", start, lambda acc, m: F.struct(
            _apply(acc["state"], m["map"]).alias("state"), F.concat(acc["seen"], F.array(acc["state"])).alias("seen"),
        ))["seen"]
        stepped = joined.select("belief_id", *bucket, F.explode(F.arrays_zip(
            F.col("children").alias("child"), seen.alias("before"))).alias("_s"))
        if i == 0:
            return stepped.select(
                "belief_id", F.col("_s.child.event_id").alias("event_id"),
                F.col("_s.before").cast("int").alias("before_pct"),
                _apply(F.col("_s.before"), F.col("_s.child.map")).cast("int").alias("after_pct"), F.col("_s.child.what").alias("outcome"),
            )
        child = f"_{RUNGS[i - 1]}"
        entering = stepped.select("belief_id", *bucket, F.col(f"_s.child.{child}").alias(child), F.col("_s.before").alias("state"))
    raise AssertionError("the ladder has at least one rung")


def flag_reviews(beliefs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Events after which a belief needs review."""
    misleading = F.col("outcome") == "misleading"
    return feedback_states(beliefs, outcomes).filter(misleading | (F.col("after_pct") < REVIEW_BELOW)).select(
        "event_id", "belief_id", "after_pct", F.when(misleading, "misleading").otherwise("low_conviction").alias("review_type")
    )


def adjustment_status(beliefs: DataFrame, commands: DataFrame) -> DataFrame:
    """What each command did: updated, deleted or error.

    ``commands``: event_id, ts, belief_id, action, new_content. After the first
    delete of a belief every later command finds nothing.
    """
    gone = first_per_key(
        commands.filter(F.col("action") == "delete").select("belief_id", F.struct("ts", "event_id").alias("_gone")),
        ["belief_id"], [F.col("_gone")],
    )
    known = beliefs.select(F.col("id").alias("belief_id"), F.lit(True).alias("_known"))
    joined = commands.join(known, "belief_id", "left").join(gone, "belief_id", "left")
    late = F.coalesce(F.struct("ts", "event_id") > F.col("_gone"), F.lit(False))
    status = (
        F.when(F.col("_known").isNull() | late, "error")
        .when(F.col("action") == "delete", "deleted")
        .when(F.col("action").isin(*ADJUST_DELTAS), "updated")
        .when((F.col("action") == "modify") & (F.coalesce("new_content", F.lit("")) != ""), "updated")
        .otherwise("error")
    )
    return joined.withColumn("status", status).drop("_known", "_gone")


def adjust_beliefs(beliefs: DataFrame, commands: DataFrame) -> DataFrame:
    """Beliefs after all commands; deleted ones are gone."""
    done = adjustment_status(beliefs, commands)
    applied = done.filter(F.col("status") == "updated")
    total = composed(applied.filter(F.col("action").isin(*ADJUST_DELTAS)), ADJUST_DELTAS, "action").select(F.col("belief_id").alias("id"), "map")
    text = applied.filter(F.col("action") == "modify").groupBy(F.col("belief_id").alias("id")).agg(
        F.max_by("new_content", F.struct("ts", "event_id")).alias("_text"))
    deleted = done.filter(F.col("status") == "deleted").select(F.col("belief_id").alias("id"))
    return (
        beliefs.join(deleted, "id", "left_anti").join(total, "id", "left").join(text, "id", "left")
        .select(
            "id",
            F.coalesce(_apply(F.col("conv_pct"), F.col("map")), F.col("conv_pct")).cast("int").alias("conv_pct"),
            F.coalesce("_text", "content").alias("content"),
        )
    )
