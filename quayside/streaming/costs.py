"""The round fold as keyed stream state, priced against a static table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quayside.functions.pricing import STANDARD_COSTS, CostFunctions
from quayside.operators.ordered import DEFAULT_SKEW, Skew
from quayside.operators.rounds import closed_rounds, fold_rounds, merge_folds, price_rounds
from quayside.plans.dashboard import cost_dashboard
from quayside.schemas import ROUND_KEYS
from quayside.sources.sinks import append_batch, latest_batch_rows, measurement_points

TIMEOUT_MS = 5 * 60 * 1000

ROUND = (
    "model_id string, run_id string, dataset_id string, train_round int, timestamp timestamp, edge_id string, "
    "msg_count long, peak_cpu double, peak_memory double, closed boolean, closing_cpu double, closing_memory double, "
    "pre double, post double, test double, duration double"
)
STATE = ROUND.split("train_round int, ", 1)[1]


def _folder(timeout_ms: int):
    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Fold the messages of one round that a batch brings, in time order.

        The exchange mixes what the input tasks of a batch deliver, so all frames are put in order together: a task
        holds one batch's messages of a round. ``fold_writer`` has no such task.
        """
        if state.hasTimedOut:
            # a finished round is not sent again; later input opens a fresh one
            state.remove()
            return
        held = state.get if state.exists else (None, None, 0, 0.0, 0.0, False, *[None] * 6)
        when, edge, count, cpu, memory, closed, *closing = held
        frame = pd.concat(list(frames)).sort_values("timestamp", kind="stable", ignore_index=True)
        if len(frame):
            count += len(frame)
            newest = frame["timestamp"].max()
            when = newest if when is None or newest > when else when
            edges = frame["edge_id"].dropna()
            edge = edges.iloc[0] if edge is None and len(edges) else edge
            cpus = frame["cpu"].fillna(0.0).cummax().clip(lower=cpu)
            memories = frame["memory"].fillna(0.0).cummax().clip(lower=memory)
            reports = frame.index[frame["is_quality"]]
            if len(reports):
                at = reports[-1]
                closed = True
                closing = [cpus[at], memories[at], *(frame.at[at, c] for c in ("pre", "post", "test", "duration"))]
                closing = [None if pd.isna(v) else float(v) for v in closing]
            cpu, memory = float(cpus.iloc[-1]), float(memories.iloc[-1])
        state.update((when, edge, count, cpu, memory, closed, *closing))
        state.setTimeoutDuration(timeout_ms)
        columns = [part.split()[0] for part in ROUND.split(", ")]
        yield pd.DataFrame([(*key, when, edge, count, cpu, memory, closed, *closing)], columns=columns)

    return fold


def folded_stream(messages: DataFrame, timeout_ms: int = TIMEOUT_MS) -> DataFrame:
    """Current state of every round that a batch touches; ``messages`` are flat monitoring messages."""
    narrow = messages.select(
        *ROUND_KEYS,
        F.col("timestamp").cast("timestamp").alias("timestamp"),
        "edge_id",
        F.col("resource_monitor.cpu_percentage").alias("cpu"),
        F.col("resource_monitor.memory_usage").alias("memory"),
        F.col("quality_of_model").isNotNull().alias("is_quality"),
        F.col("quality_of_model.pre_train_performance").alias("pre"),
        F.col("quality_of_model.post_train_performance").alias("post"),
        F.col("quality_of_model.test_performance").alias("test"),
        F.col("quality_of_model.train_duration").alias("duration"),
    )
    folded = narrow.groupBy(*ROUND_KEYS).applyInPandasWithState(
        _folder(timeout_ms), ROUND, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout
    )
    closing = F.struct(
        F.col("closing_cpu").alias("peak_cpu"), F.col("closing_memory").alias("peak_memory"), "pre", "post", "test", "duration"
    )
    return folded.select(
        *ROUND_KEYS,
        "timestamp",
        "edge_id",
        "msg_count",
        F.when(F.col("closed"), closing).alias("closing"),
        F.col("closed").alias("done"),
    )


def round_cost_stream(
    messages: DataFrame,
    prices: DataFrame,
    costs: CostFunctions = STANDARD_COSTS,
    memory_unit: str = "bytes",
    timeout_ms: int = TIMEOUT_MS,
) -> DataFrame:
    """Cost records of the closed rounds a batch touches; run it in update mode and upsert on the round key."""
    return closed_rounds(price_rounds(folded_stream(messages, timeout_ms), prices, costs, memory_unit))


def drain(stream: DataFrame, write, checkpoint: str, mode: str = "update", empty_batches: bool = False) -> None:
    """Process everything available with a foreachBatch writer, and stop.

    A timeout in processing time keeps asking for empty batches, which would keep such a run from ending,
    so they are off for it; a live stream needs them, and so do timers in event time.
    """
    conf = stream.sparkSession.conf
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(setting)
    conf.set(setting, str(empty_batches).lower())
    try:
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .foreachBatch(write)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        conf.set(setting, before)


def stored_rounds(written: DataFrame) -> DataFrame:
    """The newest version of each round from the written batches."""
    return latest_batch_rows(written, ROUND_KEYS).drop("batch")


def fold_writer(path: str, order: Sequence[str] = ("timestamp",), skew: Skew | None = DEFAULT_SKEW, compact_every: int = 0):
    """foreachBatch writer for streams with very busy rounds: stores the fold of each batch.

    A batch is folded without Python and spread over tasks even where one round holds most of it.
    Nothing is kept between batches; ``stored_folds`` merges what was written. Use this instead of
    the keyed state when throughput matters more than publishing every round at once. With ``compact_every`` the
    folds of all batches before are merged into one base whenever so many are new; see ``compact``.
    """
    write = append_batch(path)

    def fold(df: DataFrame, batch_id: int) -> None:
        # all batches before this one are complete
        if compact_every and batch_id and batch_id % compact_every == 0:
            compact(df.sparkSession, path, batch_id - 1)
        write(fold_rounds(df, order, skew=skew), batch_id)

    return fold


def _base(path: str) -> str:
    return f"{path.rstrip('/')}-base"


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def compacted_through(spark: SparkSession, path: str) -> int:
    """The last batch that a finished base holds; -1 without one."""
    done = _written(spark, f"{_base(path)}/done")
    return -1 if done is None else int(done.agg(F.coalesce(F.max("through"), F.lit(-1))).first()[0])


def current_folds(spark: SparkSession, path: str, through: int | None = None) -> DataFrame | None:
    """The base and the folds of newer batches, as parts numbered by batch; None if nothing is written.

    Only folders of newer batches are read, however many there were before.
    """
    base = compacted_through(spark, path)
    parts = [] if base < 0 else [spark.read.parquet(f"{_base(path)}/folds/through={base}").withColumn("batch", F.lit(base))]
    newer = _written(spark, path)
    if newer is not None:
        own = newer.filter(F.col("batch") > base)
        parts.append(own if through is None else own.filter(F.col("batch") <= through))
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else None


def compact(spark: SparkSession, path: str, through: int) -> None:
    """Merge the base and the folds of the batches up to ``through``, all of them complete, into a new base.

    A base is used only once a row in ``done`` names it, which is written last; so an interrupted run leaves the
    older base in use, and a repeated one writes the same again. Batch folders are left where they are.
    """
    if compacted_through(spark, path) >= through:
        return
    folds = current_folds(spark, path, through)
    if folds is not None:
        merge_folds(folds, "batch").write.mode("overwrite").parquet(f"{_base(path)}/folds/through={through}")
        spark.range(1).select(F.lit("folds").alias("what")).write.mode("overwrite").parquet(f"{_base(path)}/done/through={through}")


def stored_folds(written: DataFrame) -> DataFrame:
    """Current state of every round from the folds of all batches, or from ``current_folds``."""
    return merge_folds(written, "batch")


def folded_costs(
    messages: DataFrame,
    prices: DataFrame,
    path: str,
    checkpoint: str,
    order: Sequence[str] = ("timestamp",),
    costs: CostFunctions = STANDARD_COSTS,
    memory_unit: str = "bytes",
) -> DataFrame:
    """Cost records of all closed rounds after draining ``messages`` through stored folds.

    Neither the order of rows within a batch nor the size of a round matters.
    """
    drain(messages, fold_writer(path, order), checkpoint, "append")
    return closed_rounds(price_rounds(stored_folds(messages.sparkSession.read.parquet(path)), prices, costs, memory_unit))


def dashboard_writer(path: str):
    """foreachBatch writer that keeps the cost points; ``stored_dashboard`` reads them back."""
    write = append_batch(path)
    return lambda df, batch_id: write(measurement_points(df), batch_id)


def stored_dashboard(written: DataFrame) -> DataFrame:
    """The dashboard over all points written so far, the newest version of each point."""
    keys = ["measurement", "dataset_id", "run_id", "task_id", "field"]
    newest = latest_batch_rows(written, keys).drop("batch")
    return cost_dashboard(newest.select("measurement", "dataset_id", "run_id", "task_id", "time", "field", "value"))
