"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.text import round_tag
from quayside.schemas import COST_FIELDS


def write_extract(df: DataFrame, root: str, dataset_id: str, request_id: str) -> str:
    """Extracted rows as CSV parts in a folder of their own; returns the folder."""
    path = f"{root.rstrip('/')}/{dataset_id}_{request_id}"
    df.write.mode("overwrite").csv(path, header=True)
    return path


def write_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """One folder per value (provider, split, condition, recording) in a single write."""
    df.write.mode("overwrite").partitionBy(*by).csv(path, header=True)


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text in ``value``, the form a message sink takes."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def append_batch(path: str):
    """A foreachBatch writer that may run twice for one batch: the batch number names its folder."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return write


def measurement_points(costs: DataFrame) -> DataFrame:
    """Cost records as tagged points: measurement, tags, field, value, time."""
    tags = [
        F.col("model_id").alias("measurement"),
        "dataset_id",
        "run_id",
        round_tag(F.col("train_round")).alias("task_id"),
        F.col("timestamp").alias("time"),
    ]
    wide = costs.select(*tags, *COST_FIELDS)
    ids = ["measurement", "dataset_id", "run_id", "task_id", "time"]
    return wide.unpivot(ids, COST_FIELDS, "field", "value")


def stream_sink(df: DataFrame, path: str, checkpoint: str, seconds: int = 10, mode: str = "update"):
    """Start a live stream that writes each batch once, every ten seconds by default."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(append_batch(path)).trigger(processingTime=f"{seconds} seconds").start()


def latest_batch_rows(df: DataFrame, keys: Sequence[str], batch: Column | str = "batch") -> DataFrame:
    """Read side of an update-mode sink: the newest version of each key."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), batch).alias("_newest"))
    return newest.select(*keys, "_newest.*")
