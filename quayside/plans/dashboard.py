"""Running cost totals for the dashboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.pricing import total_cost
from quayside.operators.ordered import DEFAULT_SKEW, Scan, Skew, ordered_scan

# fixed values: which cost fields accumulate and which are shown as they are
ACCUMULATED = ["cost_resource", "cost_qom"]
AS_IS = ["cost_qod", "cost_context"]
SERIES = ("measurement", "dataset_id", "run_id")


def running_totals(points: DataFrame, series: Sequence[str] = SERIES, skew: Skew | None = DEFAULT_SKEW) -> DataFrame:
    """Cumulative sum of every accumulating field along its series."""
    chosen = points.filter(F.col("field").isin(ACCUMULATED))
    scanned = ordered_scan(chosen, [*series, "field"], ["time", "task_id"], {"_sum": Scan("sum", F.col("value"))}, skew)
    return scanned.withColumn("value", F.col("_sum")).select(*points.columns)


def cost_dashboard(points: DataFrame, series: Sequence[str] = SERIES, skew: Skew | None = DEFAULT_SKEW) -> DataFrame:
    """Total cost over time: running totals next to plain fields, one row per point in time."""
    shown = running_totals(points, series, skew).unionByName(points.filter(F.col("field").isin(AS_IS)))
    keys = ["measurement", "dataset_id", "run_id", "task_id", "time"]
    wide = shown.groupBy(*keys).pivot("field", [*ACCUMULATED, *AS_IS]).agg(F.first("value"))
    parts = [F.col(c) for c in ("cost_context", "cost_qod", "cost_qom", "cost_resource")]
    return wide.select(*keys, total_cost(*parts).alias("total_cost"))
