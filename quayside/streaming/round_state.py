"""The round fold as a stateful processor: arbitrary arrival order, timers, time to live, and an initial state.

A round's value state holds what is known up to its last quality message. Samples behind that message, in event order,
may still count for a later one; of them a list state keeps only those that raise a peak. So messages may come in any
order, within a batch and between batches, and the state is that of ``fold_rounds`` over all of them. The frames of
a batch are folded one after the other and never put together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quayside.functions.pricing import STANDARD_COSTS, CostFunctions
from quayside.operators.rounds import closed_rounds, price_rounds
from quayside.schemas import ROUND_KEYS
from quayside.streaming.costs import TIMEOUT_MS, stored_rounds

#: Before every message: where the samples of an initial state stand.
BEFORE = -(1 << 62)

_CLOSING = "closed boolean, close_at long, close_seq long, close_cpu double, close_memory double, pre double, post double, test double, duration double"
STATE = f"count long, latest long, edge string, edge_at long, edge_seq long, {_CLOSING}"
STEP = "at long, seq long, cpu double, memory double"
OUT = (
    "model_id string, run_id string, dataset_id string, train_round int, latest long, edge_id string, msg_count long, closed boolean, "
    "peak_cpu double, peak_memory double, pre double, post double, test double, duration double"
)
_METRICS = ("pre", "post", "test", "duration")


class Held(NamedTuple):
    """The value state. Positions are (microseconds, sequence)."""

    count: int = 0
    latest: int | None = None
    edge: str | None = None
    edge_at: int | None = None
    edge_seq: int | None = None
    closed: bool = False
    close_at: int | None = None
    close_seq: int | None = None
    close_cpu: float = 0.0
    close_memory: float = 0.0
    pre: float | None = None
    post: float | None = None
    test: float | None = None
    duration: float | None = None


def _number(value: object) -> float | None:
    return None if pd.isna(value) else float(value)


def folded(held: Held, steps: list[tuple], frame: pd.DataFrame) -> tuple[Held, list[tuple]]:
    """State and steps after more messages (at, seq, edge_id, cpu, memory, is_quality and the metrics).

    Steps are samples behind the last quality message in event order, each with the peaks up to it.
    """
    if not len(frame):
        return held, steps
    at, seq = frame["at"].to_numpy(np.int64), frame["seq"].to_numpy(np.int64)
    newest = int(at.max())
    held = held._replace(count=held.count + len(frame), latest=newest if held.latest is None else max(held.latest, newest))
    named = np.flatnonzero(frame["edge_id"].notna().to_numpy())
    if len(named):
        i = named[np.lexsort((seq[named], at[named]))[0]]
        if held.edge is None or (at[i], seq[i]) < (held.edge_at, held.edge_seq):
            held = held._replace(edge=frame["edge_id"].iloc[i], edge_at=int(at[i]), edge_seq=int(seq[i]))
    reports = np.flatnonzero(frame["is_quality"].to_numpy(bool))
    if len(reports):
        i = reports[np.lexsort((seq[reports], at[reports]))[-1]]
        if not held.closed or (at[i], seq[i]) > (held.close_at, held.close_seq):
            metrics = {c: _number(frame[c].iloc[i]) for c in _METRICS}
            held = held._replace(closed=True, close_at=int(at[i]), close_seq=int(seq[i]), **metrics)
    old = np.array([s[:2] for s in steps], np.int64).reshape(-1, 2)
    peaks = np.array([s[2:] for s in steps], "float64").reshape(-1, 2)
    at, seq = np.concatenate([old[:, 0], at]), np.concatenate([old[:, 1], seq])
    own = np.nan_to_num(frame[["cpu", "memory"]].to_numpy("float64"), nan=0.0)
    peaks = np.concatenate([peaks, own])
    if held.closed:
        inside = (at < held.close_at) | ((at == held.close_at) & (seq <= held.close_seq))
        cpu, memory = np.maximum([held.close_cpu, held.close_memory], peaks[inside].max(axis=0, initial=0.0)).tolist()
        held = held._replace(close_cpu=cpu, close_memory=memory)
        at, seq, peaks = at[~inside], seq[~inside], peaks[~inside]
    order = np.lexsort((seq, at))
    running = np.maximum.accumulate(np.concatenate([[[held.close_cpu, held.close_memory]], peaks[order]]), axis=0)
    rises = (running[1:] > running[:-1]).any(axis=1)
    kept = [(int(a), int(s), float(c), float(m)) for a, s, (c, m) in zip(at[order][rises], seq[order][rises], running[1:][rises], strict=True)]
    return held, kept


class RoundProcessor(StatefulProcessor):
    """One training round for each key. A round without input for ``timeout_ms`` is forgotten; later input opens a fresh one."""

    def __init__(self, timeout_ms: int = TIMEOUT_MS) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.round = handle.getValueState("round", STATE)
        # what a timer does not remove, because a node went down in between, ends by its age
        self.steps = handle.getListState("steps", STEP, ttlDurationMs=10 * self.timeout_ms)

    def _load(self) -> tuple[Held, list[tuple]]:
        held = self.round.get() if self.round.exists() else None
        return (Held() if held is None else Held(*held)), [tuple(s) for s in self.steps.get()]

    def _save(self, held: Held, steps: list[tuple], now: int) -> None:
        self.round.update(tuple(held))
        if steps:
            self.steps.put(steps)
        else:
            self.steps.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.timeout_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, steps = self._load()
        for frame in rows:
            held, steps = folded(held, steps, frame)
        self._save(held, steps, timerValues.getCurrentProcessingTimeInMs())
        closing = (held.close_cpu, held.close_memory, *held[-4:]) if held.closed else (None,) * 6
        columns = [part.split()[0] for part in OUT.split(", ")]
        yield pd.DataFrame([(*key, held.latest, held.edge, held.count, held.closed, *closing)], columns=columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.round.clear()
        self.steps.clear()
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """A stored fold: all its messages come before those of the stream."""
        one = initialState.iloc[0]
        held = Held(int(one["msg_count"]), int(one["latest"]), None if pd.isna(one["edge_id"]) else one["edge_id"], BEFORE, BEFORE)
        if held.edge is None:
            held = held._replace(edge_at=None, edge_seq=None)
        if bool(one["done"]):
            metrics = {c: _number(one[c]) for c in _METRICS}
            held = held._replace(closed=True, close_at=BEFORE, close_seq=BEFORE, close_cpu=float(one["close_cpu"]), close_memory=float(one["close_memory"]), **metrics)
        peaks = [_number(one[c]) or 0.0 for c in ("max_cpu", "max_memory")]
        rises = peaks[0] > held.close_cpu or peaks[1] > held.close_memory
        steps = [(BEFORE, BEFORE + 1, max(peaks[0], held.close_cpu), max(peaks[1], held.close_memory))] if rises else []
        self._save(held, steps, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def initial_rounds(folds: DataFrame) -> DataFrame:
    """Folds of ``fold_rounds`` or ``stored_folds`` in the form the processor starts from."""
    closing = [F.col(f"closing.{c}").alias(c) for c in _METRICS]
    return folds.select(
        *ROUND_KEYS, F.unix_micros(F.col("timestamp").cast("timestamp")).alias("latest"), "edge_id", "msg_count", "max_cpu", "max_memory", "done",
        F.col("closing.peak_cpu").alias("close_cpu"), F.col("closing.peak_memory").alias("close_memory"), *closing,
    )


def keyed_rounds(messages: DataFrame, order: Sequence[str] = ("timestamp",), timeout_ms: int = TIMEOUT_MS, initial: DataFrame | None = None) -> DataFrame:
    """Current state of every round that a batch touches, for streams in update mode.

    ``messages``: flat monitoring messages; ``order``: their time and, if given, a whole number that orders messages of one
    time. ``initial``: folds of messages before the stream. Messages of a round with a null key are one round. The state store
    has to be the one of ``STREAM_SETTINGS``.
    """
    time, seq = order[0], F.col(order[1]).cast("long") if len(order) > 1 else F.lit(0).cast("long")
    narrow = messages.select(
        *ROUND_KEYS,
        F.unix_micros(F.col(time).cast("timestamp")).alias("at"),
        seq.alias("seq"),
        "edge_id",
        F.col("resource_monitor.cpu_percentage").alias("cpu"),
        F.col("resource_monitor.memory_usage").alias("memory"),
        F.col("quality_of_model").isNotNull().alias("is_quality"),
        F.col("quality_of_model.pre_train_performance").alias("pre"),
        F.col("quality_of_model.post_train_performance").alias("post"),
        F.col("quality_of_model.test_performance").alias("test"),
        F.col("quality_of_model.train_duration").alias("duration"),
    )
    start = None if initial is None else initial_rounds(initial).groupBy(*ROUND_KEYS)
    states = narrow.groupBy(*ROUND_KEYS).transformWithStateInPandas(RoundProcessor(timeout_ms), OUT, "Update", "ProcessingTime", start)
    closing = F.struct("peak_cpu", "peak_memory", *_METRICS)
    return states.select(
        *ROUND_KEYS, F.timestamp_micros("latest").alias("timestamp"), "edge_id", "msg_count",
        F.when(F.col("closed"), closing).alias("closing"), F.col("closed").alias("done"),
    )


def resumed_rounds(written: DataFrame, folds: DataFrame) -> DataFrame:
    """All rounds after a run that began from ``folds``: the newest state of those it touched, the fold of the others."""
    touched = stored_rounds(written)
    same = reduce(and_, [touched[k].eqNullSafe(folds[k]) for k in ROUND_KEYS])
    columns = [c for c in touched.columns if c != "batch"]
    untouched = folds.join(touched, same, "left_anti").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return touched.select(*columns).unionByName(untouched.select(*columns))


def keyed_round_costs(
    messages: DataFrame,
    prices: DataFrame,
    order: Sequence[str] = ("timestamp",),
    costs: CostFunctions = STANDARD_COSTS,
    memory_unit: str = "bytes",
    timeout_ms: int = TIMEOUT_MS,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Cost records of the closed rounds a batch touches, from keyed state; run it in update mode and upsert on the round key."""
    return closed_rounds(price_rounds(keyed_rounds(messages, order, timeout_ms, initial), prices, costs, memory_unit))
