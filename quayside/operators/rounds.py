"""Folding monitoring messages into one record per training round, and pricing it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.pricing import STANDARD_COSTS, CostFunctions, bytes_to_mb, improvement, seconds_to_minutes
from quayside.operators.ordered import DEFAULT_SKEW, Scan, Skew, ordered_scan
from quayside.schemas import COST_COLUMNS, MESSAGE, ROUND_KEYS


def decode_messages(df: DataFrame, value: str = "value") -> DataFrame:
    """JSON text to message columns; a bad record gives a null message."""
    return df.withColumn("message", F.from_json(F.col(value).cast("string"), MESSAGE))


def flatten_messages(df: DataFrame, message: str = "message", keep: Sequence[str] = ()) -> DataFrame:
    """Nested messages to one flat row each, in the names the cost records use."""
    return df.select(
        *keep,
        F.col(f"{message}.metadata.application_name").alias("model_id"),
        F.col(f"{message}.metadata.run_id").alias("run_id"),
        F.col(f"{message}.metadata.functionality").alias("dataset_id"),
        F.col(f"{message}.metadata.name").alias("edge_id"),
        F.col(f"{message}.timestamp").alias("timestamp"),
        f"{message}.report.*",
    )


def running_peaks(
    messages: DataFrame,
    order: Sequence[str] = ("timestamp",),
    keys: Sequence[str] = tuple(ROUND_KEYS),
    skew: Skew | None = DEFAULT_SKEW,
) -> DataFrame:
    """Add what is known of a round at each message: peaks, first edge, latest time."""
    scans = {
        "peak_cpu": Scan("max", F.col("resource_monitor.cpu_percentage")),
        "peak_memory": Scan("max", F.col("resource_monitor.memory_usage")),
        "first_edge": Scan("first", F.col("edge_id")),
        "latest": Scan("max", F.col("timestamp")),
    }
    zero = F.lit(0.0)
    return (
        ordered_scan(messages, keys, order, scans, skew)
        .withColumn("peak_cpu", F.greatest(zero, F.coalesce("peak_cpu", zero)))
        .withColumn("peak_memory", F.greatest(zero, F.coalesce("peak_memory", zero)))
    )


def fold_rounds(
    messages: DataFrame,
    order: Sequence[str] = ("timestamp",),
    keys: Sequence[str] = tuple(ROUND_KEYS),
    skew: Skew | None = DEFAULT_SKEW,
) -> DataFrame:
    """One row per round.

    A round is closed by a quality message and keeps the resource peaks seen up to the
    last one; later samples only move its timestamp. The second grouping shares the
    partitioning of the running values, so a round costs one exchange.
    """
    scans = {
        "peak_cpu": Scan("max", F.col("resource_monitor.cpu_percentage")),
        "peak_memory": Scan("max", F.col("resource_monitor.memory_usage")),
    }
    seen = ordered_scan(messages, keys, order, scans, skew)
    position = F.struct(*order)
    zero = F.lit(0.0)
    closing = F.struct(
        F.greatest(zero, F.coalesce("peak_cpu", zero)).alias("peak_cpu"),
        F.greatest(zero, F.coalesce("peak_memory", zero)).alias("peak_memory"),
        F.col("quality_of_model.pre_train_performance").alias("pre"),
        F.col("quality_of_model.post_train_performance").alias("post"),
        F.col("quality_of_model.test_performance").alias("test"),
        F.col("quality_of_model.train_duration").alias("duration"),
    )
    folded = seen.groupBy(*keys).agg(
        F.max("timestamp").alias("timestamp"),
        F.min_by("edge_id", F.when(F.col("edge_id").isNotNull(), position)).alias("edge_id"),
        F.count(F.lit(1)).alias("msg_count"),
        F.max("resource_monitor.cpu_percentage").alias("max_cpu"),
        F.max("resource_monitor.memory_usage").alias("max_memory"),
        F.max_by(closing, F.when(F.col("quality_of_model").isNotNull(), position)).alias("closing"),
    )
    return folded.withColumn("done", F.col("closing").isNotNull())


def merge_folds(
    folds: DataFrame,
    part: str,
    keys: Sequence[str] = tuple(ROUND_KEYS),
    skew: Skew | None = DEFAULT_SKEW,
) -> DataFrame:
    """Folds of consecutive parts of the messages to the fold of all of them.

    The last part that closes a round decides it; its peaks also count what earlier parts saw.
    """
    scans = {
        "_cpu": Scan("max", F.col("max_cpu"), inclusive=False),
        "_memory": Scan("max", F.col("max_memory"), inclusive=False),
    }
    seen = ordered_scan(folds, keys, [part], scans, skew)
    closing = F.struct(
        F.greatest("_cpu", "closing.peak_cpu").alias("peak_cpu"),
        F.greatest("_memory", "closing.peak_memory").alias("peak_memory"),
        *[F.col(f"closing.{c}") for c in ("pre", "post", "test", "duration")],
    )
    merged = seen.groupBy(*keys).agg(
        F.max("timestamp").alias("timestamp"),
        F.min_by("edge_id", F.when(F.col("edge_id").isNotNull(), F.col(part))).alias("edge_id"),
        F.sum("msg_count").alias("msg_count"),
        F.max("max_cpu").alias("max_cpu"),
        F.max("max_memory").alias("max_memory"),
        F.max_by(closing, F.when(F.col("done"), F.col(part))).alias("closing"),
    )
    return merged.withColumn("done", F.col("closing").isNotNull())


def price_rounds(
    rounds: DataFrame,
    prices: DataFrame,
    costs: CostFunctions = STANDARD_COSTS,
    memory_unit: str = "bytes",
) -> DataFrame:
    """Join folded rounds with the price table (unique on model and dataset) and price them.

    Prices are constant per (model, dataset), so the join runs on rounds, not on messages.
    A round without a price row costs 0 and has ``price_found = false``; an unknown
    function name gives a null cost and ``price_found = false``.
    """
    zero = F.lit(0.0)
    memory = F.col("closing.peak_memory")
    arguments = {
        "pre": F.col("closing.pre"),
        "post": F.col("closing.post"),
        "minutes": seconds_to_minutes(F.col("closing.duration")),
        "cpu": F.col("closing.peak_cpu"),
        "memory_mb": bytes_to_mb(memory) if memory_unit == "bytes" else memory,
        "performance_price": F.col("qom_base_cost.performance"),
        "by_minute": F.col("resource_base_cost.by_minute"),
        "cpu_price": F.col("resource_base_cost.cpu"),
        "memory_price": F.col("resource_base_cost.memory"),
    }

    def cost(base: str, function: str) -> Column:
        return F.when(F.col(base).isNull(), zero).otherwise(costs.choose(F.col(function), arguments))

    priced = rounds.join(prices.withColumn("_listed", F.lit(True)), ["model_id", "dataset_id"], "left")
    known = F.col("qom_cost_function").isin(costs.names) & F.col("resource_cost_function").isin(costs.names)
    return priced.select(
        *ROUND_KEYS,
        "timestamp",
        "edge_id",
        cost("resource_base_cost", "resource_cost_function").alias("cost_resource"),
        cost("qom_base_cost", "qom_cost_function").alias("cost_qom"),
        F.coalesce("cost_quantity_quality", zero).alias("cost_qod"),
        F.coalesce("cost_context", zero).alias("cost_context"),
        improvement(F.col("closing.pre"), F.col("closing.post")).alias("improvement_diff"),
        F.col("closing.post").alias("performance_post"),
        F.col("closing.test").alias("performance_test"),
        "done",
        "msg_count",
        F.coalesce(F.col("_listed") & known, F.lit(False)).alias("price_found"),
    )


def closed_rounds(priced: DataFrame, columns: Sequence[str] = tuple(COST_COLUMNS)) -> DataFrame:
    """Keep the rounds that a quality message has closed, in the published column order."""
    return priced.filter("done").select(*columns)
