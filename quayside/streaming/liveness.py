"""When edges come online and go offline, told by timers as event time passes.

The spells of an edge are kept as intervals that late heartbeats may still join. Once the watermark has passed the start
or the end of a spell, no heartbeat can move it any more, and the transition is sent. An edge has one timer, at the
earliest transition that is not sent; when it expires, all that the watermark has passed are sent and the timer moves on.
Nothing waits for a further heartbeat of the edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Silence after which an edge counts as offline.
SILENCE_MS = 600_000
#: All spells of an edge as one value: starts, ends and 1 where the start was told, each as 64-bit integers in order.
SPELLS = "packed binary"


def joined(starts: np.ndarray, stops: np.ndarray, told: np.ndarray, beats: np.ndarray, silence: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First beats, last beats and whether the start was told, of spells in order, with more beats; beats ``silence`` apart or nearer are one spell."""
    starts, stops = np.concatenate([starts, beats]), np.concatenate([stops, beats])
    told = np.concatenate([told, np.zeros(len(beats), bool)])
    if not len(starts):
        return starts, stops, told
    order = np.argsort(starts, kind="stable")
    starts, stops, told = starts[order], stops[order], told[order]
    reach = np.maximum.accumulate(stops)
    at = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1] + silence]))
    return starts[at], reach[np.append(at[1:], len(starts)) - 1], np.logical_or.reduceat(told, at)


def merged(spells: list[tuple[int, int, bool]], beats: np.ndarray, silence: int) -> list[tuple[int, int, bool]]:
    """``joined`` for spells as tuples (first beat, last beat, start told)."""
    columns = (np.array([s[i] for s in spells], kind) for i, kind in enumerate((np.int64, np.int64, bool)))
    return list(zip(*(c.tolist() for c in joined(*columns, beats, silence)), strict=True))


class LivenessProcessor(StatefulProcessor):
    def __init__(self, silence_ms: int = SILENCE_MS) -> None:
        self.silence = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spells = handle.getValueState("spells", SPELLS)

    def _held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        held = self.spells.get()
        starts, stops, told = np.frombuffer(held[0] if held else b"", np.int64).reshape(3, -1)
        return starts, stops, told.astype(bool)

    def _save(self, starts: np.ndarray, stops: np.ndarray, told: np.ndarray) -> None:
        # a spell's end comes after its start, and spells are in order: the first has the earliest transition left
        wanted = {int(stops[0]) + self.silence if told[0] else int(starts[0])} if len(starts) else set()
        now = set(self.handle.listTimers())
        for timer in now - wanted:
            self.handle.deleteTimer(timer)
        for timer in wanted - now:
            self.handle.registerTimer(timer)
        if len(starts):
            self.spells.update((np.array([starts, stops, told], np.int64).tobytes(),))
        else:
            self.spells.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spells = self._held()
        watermark = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            beats = frame["at_ms"].to_numpy(np.int64)
            # heartbeats behind the watermark cannot take back what was told
            spells = joined(*spells, beats[beats > watermark], self.silence)
        self._save(*spells)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Send what the watermark has passed, and forget ended spells."""
        starts, stops, told = self._held()
        watermark = timerValues.getCurrentWatermarkInMs()
        online, offline = ~told & (starts <= watermark), stops + self.silence <= watermark
        self._save(starts[~offline], stops[~offline], (told | online)[~offline])
        at = np.concatenate([starts[online], stops[offline] + self.silence])
        if len(at):
            status = np.repeat(["online", "offline"], [online.sum(), offline.sum()])
            yield pd.DataFrame({"edge": pd.Series([key[0]] * len(at), dtype=object), "status": status, "at_ms": at})

    def close(self) -> None:
        pass


def transitions(beats: DataFrame, time: str = "arrived", edge: str = "edge_id", silence_ms: int = SILENCE_MS, late: str = "600 seconds") -> DataFrame:
    """edge, status ("online" or "offline") and the time of each transition, once the watermark has passed it.

    An edge is online from its first heartbeat until ``silence_ms`` after the last one before a longer pause. A
    heartbeat may come ``late``; a later one counts for nothing. Rows with a null time are left out. Append mode.
    """
    kind = beats.schema[edge].dataType
    schema = T.StructType([T.StructField("edge", kind), T.StructField("status", T.StringType()), T.StructField("at_ms", T.LongType())])
    timed = beats.filter(F.col(time).isNotNull()).withWatermark(time, late).select(F.col(edge).alias("edge"), F.unix_millis(time).alias("at_ms"), time)
    found = timed.groupBy("edge").transformWithStateInPandas(LivenessProcessor(silence_ms), schema, "Append", "EventTime")
    return found.select(F.col("edge").alias(edge), "status", F.timestamp_millis("at_ms").alias("at"))
