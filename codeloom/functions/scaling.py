"""Building blocks that keep joins and rankings safe on hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Span levels cover files of up to 2**22 lines.
_TOP_LEVEL = 22


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per key.

    Written as a filter on ``row_number`` so that Spark trims every map task to
    ``k`` rows per key before the shuffle; a hot key ships at most
    ``k * map tasks`` rows.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= k).drop("_rn")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the least by ``order``, as a map-side combined aggregate."""
    values = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*values), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    salts: int = 16,
    spread: Column | None = None,
) -> DataFrame:
    """Equi join that splits each key of ``big`` over ``salts`` tasks.

    ``small`` is copied ``salts`` times, so it should hold few rows per key.
    The salt is a hash of the row, not a random number, so a retried task
    produces the same rows.
    """
    source = spread if spread is not None else F.struct(*big.columns)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(source), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def _level(lo: Column, hi: Column) -> Column:
    """Smallest level at which the span ``[lo, hi]`` touches at most two cells."""
    length = F.greatest(hi - lo + 1, F.lit(1))
    return F.least(F.ceil(F.log2(length.cast("double"))).cast("int"), F.lit(_TOP_LEVEL))


def overlap_join(
    spans: DataFrame,
    probes: DataFrame,
    keys: Sequence[str],
    span: tuple[str, str],
    probe: tuple[str, str],
) -> DataFrame:
    """Rows of ``spans`` and ``probes`` with equal keys and overlapping intervals.

    A plain range join would compare every pair inside a key. Here each span is
    filed under at most two cells of the level matching its length, and a probe
    looks into the cells it touches on every level that spans have, so the join is
    an equi join on (keys, level, cell) and a hot file spreads over many cells. Rows
    multiply before they meet, which estimates of sizes leave out; the hint keeps
    either side from being broadcast.
    """
    s_lo, s_hi = F.col(span[0]).cast("long"), F.col(span[1]).cast("long")
    p_lo, p_hi = F.col(probe[0]).cast("long"), F.col(probe[1]).cast("long")

    def cell(value: Column, level: Column) -> Column:
        return F.floor(value / F.pow(F.lit(2.0), level)).cast("long")

    levelled = spans.withColumn("_level", _level(s_lo, s_hi))
    levels = levelled.select("_level").filter("_level IS NOT NULL").distinct()
    filed = levelled.withColumn(
        "_cell",
        F.explode(F.sequence(cell(s_lo, F.col("_level")), cell(F.greatest(s_lo, s_hi), F.col("_level")))),
    )
    looking = probes.crossJoin(F.broadcast(levels)).withColumn(
        "_cell",
        F.explode(F.sequence(cell(p_lo, F.col("_level")), cell(F.greatest(p_lo, p_hi), F.col("_level")))),
    )
    # A pair can meet in two cells; it is kept in the first cell they share.
    first_shared = F.greatest(cell(s_lo, F.col("_level")), cell(p_lo, F.col("_level")))
    return (
        filed.hint("merge").join(looking, [*keys, "_level", "_cell"])
        .filter((s_lo <= p_hi) & (s_hi >= p_lo) & (F.col("_cell") == first_shared))
        .drop("_level", "_cell")
    )


def hash_rate(column: Column, rate: float | Column) -> Column:
    """Keep about ``rate`` of the rows, the same ones on every run and retry.

    The first eight digits of the MD5 sum of the text decide, which other engines
    have as well.
    """
    digits = F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, 8)
    share = F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)
    return share < (rate if isinstance(rate, Column) else F.lit(rate))


def any_of(column: Column, patterns: Sequence[str], ignore_case: bool = True) -> Column:
    """One alternation instead of one scan per pattern."""
    body = "|".join(f"(?:{p})" for p in patterns)
    return column.rlike(("(?i)" if ignore_case else "") + body)


def each_item(df: DataFrame, keep: Sequence[Column | str], items: Column, name: str) -> DataFrame:
    """One row per array element.

    A plain explode makes the optimizer test the array for emptiness first, which
    computes a costly array twice. The outer form has no such test; the null row
    of an empty array is dropped afterwards.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())
