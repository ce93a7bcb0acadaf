"""Resource readings: gating by training rounds, rates from cumulative counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.numeric import cpu_percentage
from quayside.operators.ordered import DEFAULT_SKEW, Scan, Skew, ordered_scan


def gate_by_round(
    samples: DataFrame,
    markers: DataFrame,
    key: str = "edge_id",
    order: Sequence[str] = ("timestamp",),
    skew: Skew | None = DEFAULT_SKEW,
) -> DataFrame:
    """Samples taken while their provider's round is open, with that round's number.

    Backward as-of join as one ordered pass: markers (status, train_round) and samples are
    stacked, and each sample takes the last marker before it.
    """
    marker = F.struct("status", "train_round")
    stacked = samples.withColumn("_marker", F.lit(None).cast("struct<status:string,train_round:int>")).unionByName(
        markers.select(key, *order, marker.cast("struct<status:string,train_round:int>").alias("_marker")),
        allowMissingColumns=True,
    ).withColumn("_is_marker", F.col("_marker").isNotNull())
    scans = {"_open": Scan("last", F.col("_marker"))}
    seen = ordered_scan(stacked, [key], order, scans, skew)
    return seen.filter(~F.col("_is_marker") & (F.col("_open.status") == "start")).select(
        *samples.columns, F.col("_open.train_round").alias("train_round")
    )


def counter_rates(
    readings: DataFrame,
    key: str,
    order: Sequence[str],
    usage: str,
    system: str,
    cpus: int,
    skew: Skew | None = DEFAULT_SKEW,
) -> DataFrame:
    """Add ``cpu_percentage`` from the step between consecutive cumulative readings."""
    before = F.struct(F.col(usage).alias("usage"), F.col(system).alias("system"))
    seen = ordered_scan(readings, [key], order, {"_before": Scan("last", before, inclusive=False)}, skew)
    rate = cpu_percentage(F.col(usage) - F.col("_before.usage"), F.col(system) - F.col("_before.system"), F.lit(cpus))
    return seen.withColumn("cpu_percentage", rate).select(*readings.columns, "cpu_percentage")
