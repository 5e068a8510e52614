"""Event log, model usage and extraction runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.mesh import listing

# Cents per million tokens (input, output), in lookup order.
PRICES = {
    "llama-3.3-70b-versatile": (0, 0),
    "llama-3.1-70b-versatile": (0, 0),
    "llama-3.1-8b-instant": (0, 0),
    "mixtral-8x7b-32768": (0, 0),
    "gemma2-9b-it": (0, 0),
    "claude-3-5-sonnet-20241022": (300, 1500),
    "claude-3-5-sonnet-latest": (300, 1500),
    "claude-3-5-haiku-20241022": (80, 40),
    "claude-3-5-haiku-latest": (80, 40),
    "claude-opus-4-20250514": (1500, 7500),
    "claude-opus-4-latest": (1500, 7500),
    "claude-sonnet-4-20250514": (300, 1500),
    "claude-sonnet-4-latest": (300, 1500),
    "gpt-4o": (250, 1000),
    "gpt-4o-mini": (15, 60),
    "gpt-4-turbo": (1000, 3000),
    "o1": (1500, 6000),
    "o1-mini": (300, 1200),
}
DEFAULT_PRICE = (300, 1500)
START, ENDS = "mcp.tool.called", ("mcp.tool.result", "mcp.tool.error")


def recent_events(events: DataFrame, event_types: Sequence[str] | None = None, prefix: str | None = None,
                  source: str | None = None, limit: int | None = 100) -> DataFrame:
    """Newest events; exact types, a type prefix and a source filter."""
    kept = events
    if event_types:
        kept = kept.filter(F.col("event_type").isin(*event_types))
    if prefix is not None:
        kept = kept.filter(F.col("event_type").startswith(prefix))
    if source is not None:
        kept = kept.filter(F.col("source") == source)
    return listing(kept, [F.col("ts").desc(), F.col("event_id").desc()], limit)


def bounded_history(events: DataFrame, size: int = 1000) -> DataFrame:
    return recent_events(events, limit=size)


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type", "source").agg(F.count("*").alias("n"))


def price(model: Column) -> Column:
    """(input, output) cents per million tokens: exact, then first partial, then default."""
    key = F.lower(model)

    def pair(p: tuple[int, int]) -> Column:
        return F.struct(F.lit(p[0]).alias("input_cents"), F.lit(p[1]).alias("output_cents"))

    found = pair(DEFAULT_PRICE)
    for name, cents in reversed(PRICES.items()):
        found = F.when(key.contains(name) | F.lit(name).contains(key), pair(cents)).otherwise(found)
    for name, cents in PRICES.items():
        found = F.when(key == name, pair(cents)).otherwise(found)
    return found


def cost_cents(prompt: Column, completion: Column, priced: Column) -> Column:
    return (prompt * priced["input_cents"] + completion * priced["output_cents"]) / 1_000_000


def price_usage(usage: DataFrame) -> DataFrame:
    """Usage rows with their price, a column of the model's name."""
    return usage.withColumn("_p", price(F.col("model_id"))).select(
        *usage.columns, F.col("_p.input_cents").alias("input_cents"), F.col("_p.output_cents").alias("output_cents"),
        F.round(cost_cents(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("_p")), 6).alias("cost_cents"),
    )


def usage_summary(usage: DataFrame, by: Sequence[str] = ("model_id", "provider")) -> DataFrame:
    """Calls, tokens and cost per model. Tokens are summed before pricing."""
    totals = usage.groupBy(*by).agg(
        F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    )
    cost = cost_cents(F.col("prompt_tokens"), F.col("completion_tokens"), price(F.col("model_id")))
    return totals.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")).withColumn(
        "cost_cents", F.round(cost, 6))


def session_usage(usage: DataFrame, session: str) -> DataFrame:
    per_model = usage_summary(usage, (session, "model_id"))
    return per_model.groupBy(session).agg(
        F.sum("calls").alias("calls"), F.sum("total_tokens").alias("total_tokens"),
        F.round(F.sum("cost_cents"), 6).alias("cost_cents"), F.count("*").alias("models"),
    )


def pair_events(events: DataFrame) -> DataFrame:
    """First start of each request and its earliest end from then on: duration, outcome, merged payload.

    A window and an aggregation keyed by request share one shuffle, and there is
    no self join. ``events``: request_id, event_type, ts, data (JSON object).
    """
    is_start, is_end = F.col("event_type") == START, F.col("event_type").isin(*ENDS)
    kept = events.filter(is_start | is_end)
    row = F.struct("ts", "event_type", "data")
    began = F.min(F.when(is_start, F.col("ts"))).over(Window.partitionBy("request_id"))
    ends = kept.withColumn("_began", began).groupBy("request_id").agg(
        F.min(F.when(is_start, row)).alias("s"), F.min(F.when(is_end & (F.col("ts") >= F.col("_began")), row)).alias("e")
    ).filter("s IS NOT NULL AND e IS NOT NULL")
    bag = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    start_bag, end_bag = bag(F.col("s.data")), bag(F.col("e.data"))
    kept_start = F.map_filter(start_bag, lambda k, _: ~F.map_contains_key(end_bag, k))
    millis = (F.unix_micros(F.col("e.ts").cast("timestamp")) - F.unix_micros(F.col("s.ts").cast("timestamp"))) / 1000
    return ends.select(
        "request_id", F.col("s.ts").alias("started_at"), millis.alias("duration_ms"),
        (F.col("e.event_type") == "mcp.tool.error").alias("is_error"), F.map_concat(kept_start, end_bag).alias("payload"),
    )


def unsettled(events: DataFrame) -> DataFrame:
    """Starts and ends that :func:`pair_events` may still need: all of a request without a pair, and ends before its first start."""
    is_start, is_end = F.col("event_type") == START, F.col("event_type").isin(*ENDS)
    request = Window.partitionBy("request_id")
    began = events.filter(is_start | is_end).withColumn("_began", F.min(F.when(is_start, F.col("ts"))).over(request))
    ended = F.max(is_end & F.coalesce(F.col("ts") >= F.col("_began"), F.lit(False))).over(request)
    return began.withColumn("_ended", ended).filter(~F.col("_ended") | (is_end & (F.col("ts") < F.col("_began")))).drop("_began", "_ended")


# ------------------------------------------------------------------- runs


def extraction_chain(runs: DataFrame) -> DataFrame:
    """Previous run of the same project and branch.

    Done per month first; the first run of a month then takes the last run of
    the month before it. A hot project is spread over its months instead of
    being sorted in one task.
    """
    runs = runs.withColumn("_month", F.date_trunc("month", "extracted_at"))
    keys = ["project_id", "branch"]
    inside = Window.partitionBy(*keys, "_month").orderBy("extracted_at", "id")
    lasts = runs.groupBy(*keys, "_month").agg(F.max_by("id", F.struct("extracted_at", "id")).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_month")
    before = lasts.select(*keys, "_month", F.lag("_last").over(across).alias("_before"))
    return (
        runs.withColumn("_inside", F.lag("id").over(inside)).join(before, [*keys, "_month"])
        .withColumn("previous_id", F.coalesce("_inside", "_before")).drop("_month", "_inside", "_before")
    )


def last_extraction(runs: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("id", "commit_sha", "extracted_at"), F.struct("extracted_at", "id"))
    return runs.groupBy("project_id", "branch").agg(newest.alias("_r")).select("project_id", "branch", "_r.*")


def extraction_history(runs: DataFrame, project_id=None, branch=None, commit=None, limit=None) -> DataFrame:
    """Runs newest first; ``commit`` may be a full or an abbreviated id."""
    kept = runs.withColumn("short_sha", F.substring("commit_sha", 1, 7))
    for column, value in (("project_id", project_id), ("branch", branch)):
        kept = kept.filter(F.col(column) == value) if value is not None else kept
    if commit is not None:
        kept = kept.filter((F.col("commit_sha") == commit) | (F.col("short_sha") == commit))
    return listing(kept, [F.col("extracted_at").desc(), "id"], limit)
