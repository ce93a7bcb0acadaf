"""Live provider health and round-gated resource samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quayside.functions.text import repair_quotes
from quayside.operators.monitor import gate_by_round
from quayside.operators.ordered import DEFAULT_SKEW, Skew
from quayside.schemas import HEARTBEAT
from quayside.sources.sinks import append_batch


def heartbeats(stream: DataFrame, value: str = "value", arrival: Column | None = None) -> DataFrame:
    """Health messages of edges, stamped with their arrival."""
    beat = F.from_json(repair_quotes(F.col(value).cast("string")), HEARTBEAT)
    arrived = F.current_timestamp() if arrival is None else arrival
    return (
        stream.select(beat.alias("_beat"), arrived.alias("arrived"))
        .filter(F.col("_beat.type") == "edge")
        .select("_beat.edge_id", "_beat.routing_key", "_beat.health", "_beat.docker_available", "arrived")
    )


def online_spells(beats: DataFrame, time: str = "arrived", edge: str = "edge_id", gap: str = "600 seconds", late: str = "600 seconds") -> DataFrame:
    """Spells in which an edge reported without a longer pause. Sessions merge partial results before the exchange."""
    session = F.session_window(time, gap)
    return (
        beats.withWatermark(time, late)
        .groupBy(edge, session)
        .agg(F.count(F.lit(1)).alias("beats"))
        .select(
            edge,
            F.col("session_window.start").alias("from"),
            F.col("session_window.end").alias("until"),
            "beats",
        )
    )


GATED = "edge_id string, timestamp timestamp, value double, train_round int"


def _gate(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Pass on the samples that arrive while the edge's last marker says ``start``."""
    status, number = state.get if state.exists else (None, None)
    # the exchange mixes what the input tasks of one batch deliver; markers come before samples of their time
    frame = pd.concat(list(frames))
    frame["_sample"] = frame["status"].isna()
    frame = frame.sort_values(["timestamp", "_sample"], kind="stable", ignore_index=True)
    if len(frame):
        marks = frame["status"].where(frame["status"].notna(), None).ffill()
        marks = marks.where(marks.notna(), status)
        rounds = frame["train_round"].where(frame["status"].notna()).ffill()
        rounds = rounds if number is None else rounds.fillna(number)
        passed = frame[frame["status"].isna() & (marks == "start")]
        yield pd.DataFrame(
            {
                "edge_id": key[0],
                "timestamp": passed["timestamp"],
                "value": passed["value"],
                "train_round": rounds[passed.index].astype("int32"),
            }
        )
        last = marks.iloc[-1]
        status = None if pd.isna(last) else last
        number = None if pd.isna(rounds.iloc[-1]) else int(rounds.iloc[-1])
    state.update((status, number))


def gate_writer(path: str, skew: Skew | None = DEFAULT_SKEW):
    """foreachBatch writer of the samples of open rounds, however many samples one edge sends.

    Each batch is gated as a whole, as batch data is; from batch to batch only the last marker of every edge is
    carried on. Input as for ``gated_samples``; ``stored_samples`` reads the result.
    """
    root = path.rstrip("/")
    write_samples, write_markers = append_batch(f"{root}/samples"), append_batch(f"{root}/markers")
    order = ["timestamp", "_sample"]

    def write(df: DataFrame, batch_id: int) -> None:
        own = df.select("edge_id", "timestamp", "value", "status", "train_round")
        markers = own.filter(F.col("status").isNotNull()).select("edge_id", "timestamp", "status", "train_round", F.lit(0).alias("_sample"))
        if batch_id:
            past = df.sparkSession.read.parquet(f"{root}/markers").filter(F.col("batch") == batch_id - 1)
            markers = past.select(*markers.columns).unionByName(markers)
        marker = F.struct("timestamp", "status", "train_round", "_sample")
        write_markers(markers.groupBy("edge_id").agg(F.max_by(marker, "timestamp").alias("m")).select("edge_id", "m.*"), batch_id)
        samples = own.filter(F.col("status").isNull()).select("edge_id", "timestamp", "value", F.lit(1).alias("_sample"))
        write_samples(gate_by_round(samples, markers, "edge_id", order, skew).drop("_sample"), batch_id)

    return write


def stored_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/samples").drop("batch")


def gated_samples(stream: DataFrame) -> DataFrame:
    """Samples of open rounds. Input: edge_id, timestamp, value, status, train_round (status null on samples).

    Keyed state: a task holds what one batch brings of an edge. ``gate_writer`` has no such task.
    """
    return (
        stream.select("edge_id", "timestamp", "value", "status", "train_round")
        .groupBy("edge_id")
        .applyInPandasWithState(_gate, GATED, "status string, train_round int", "append", GroupStateTimeout.NoTimeout)
    )
