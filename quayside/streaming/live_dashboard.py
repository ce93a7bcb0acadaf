"""The cost dashboard kept up to date point by point.

The running totals of a series are keyed state. A point behind all others of its series adds to the carried totals and
costs the same whatever the history is. A point that comes late, or again with other values, shifts the totals from
its time on: only those of its own series are computed anew and sent again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quayside.functions.pricing import total_cost
from quayside.functions.text import round_tag
from quayside.plans.dashboard import ACCUMULATED, AS_IS, SERIES
from quayside.sources.sinks import latest_batch_rows

_VALUES = [*ACCUMULATED, *AS_IS]
_POINT = "at long, version long, " + ", ".join(f"{c} double" for c in _VALUES)
_LAST = "at long, task_id string, " + ", ".join(f"{c} double" for c in ACCUMULATED)
OUT = "measurement string, dataset_id string, run_id string, task_id string, at long, " + ", ".join(f"{c} double" for c in _VALUES)


def totals(points: list[tuple[str, tuple]], start: list[float]) -> list[tuple]:
    """Rows (task_id, at, accumulated .., as they are ..) of points in order; an absent value shows as absent and adds nothing."""
    sums, out = list(start), []
    for task, (at, _, *values) in points:
        n = len(sums)
        sums = [s if v is None else s + v for s, v in zip(sums, values[:n], strict=True)]
        out.append((task, at, *[None if v is None else s for s, v in zip(sums, values[:n], strict=True)], *values[n:]))
    return out


class SeriesProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getMapState("points", "task_id string", _POINT)
        self.last = handle.getValueState("last", _LAST)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        last, sums = (None, [0.0] * len(ACCUMULATED)) if held is None else ((held[0], held[1]), list(held[2:]))
        first_change, late, fresh = None, False, []
        for frame in rows:
            frame = frame.sort_values(["at", "task_id", "version"], kind="stable")
            for task, at, version, *values in frame[["task_id", "at", "version", *_VALUES]].itertuples(index=False, name=None):
                point = (int(at), int(version), *[None if v is None or np.isnan(v) else float(v) for v in values])
                before = self.points.getValue((task,)) if self.points.containsKey((task,)) else None
                if before is not None and (before[1] > point[1] or tuple(before) == point):
                    continue
                self.points.updateValue((task,), point)
                changed = [(point[0], task)] + ([] if before is None else [(before[0], task)])
                first_change = min(changed if first_change is None else [first_change, *changed])
                if before is None and not late and (last is None or (point[0], task) > last):
                    row = totals([(task, point)], sums)[0]
                    sums = [s + (v or 0.0) for s, v in zip(sums, point[2:], strict=False)]
                    last = (point[0], task)
                    fresh.append(row)
                else:
                    late = True
        if late:
            ordered = sorted(((k[0], tuple(v)) for k, v in self.points.iterator()), key=lambda p: (p[1][0], p[0]))
            fresh = [row for row in totals(ordered, [0.0] * len(ACCUMULATED)) if (row[1], row[0]) >= first_change]
            for _, point in ordered[-1:]:
                last = (point[0], ordered[-1][0])
            sums = [sum(p[2 + i] or 0.0 for _, p in ordered) for i in range(len(ACCUMULATED))]
        if fresh:
            self.last.update((*last, *sums))
            yield pd.DataFrame([(*key, *row) for row in fresh], columns=[part.split()[0] for part in OUT.split(", ")])

    def close(self) -> None:
        pass


def live_dashboard(costs: DataFrame, version: str = "version") -> DataFrame:
    """Dashboard rows that a batch of cost records changes, for update mode: series, task_id, time, total_cost.

    ``costs``: cost records with ``version``, a whole number that grows when a record is published again (a batch number);
    an older version coming later is left out. Records without any cost show no row. Times are kept to the microsecond.
    """
    timed = costs.select(
        F.col("model_id").alias("measurement"), "dataset_id", "run_id", round_tag(F.col("train_round")).alias("task_id"),
        F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"), F.col(version).cast("long").alias("version"), *_VALUES,
    )
    shown = timed.groupBy(*SERIES).transformWithStateInPandas(SeriesProcessor(), OUT, "Update", "None")
    any_cost = F.coalesce(*_VALUES).isNotNull()
    parts = [F.col(c) for c in ("cost_context", "cost_qod", "cost_qom", "cost_resource")]
    return shown.filter(any_cost).select(*SERIES, "task_id", F.timestamp_micros("at").alias("time"), total_cost(*parts).alias("total_cost"))


def shown_dashboard(written: DataFrame) -> DataFrame:
    """The dashboard from the batches written so far: the newest version of each point."""
    return latest_batch_rows(written, [*SERIES, "task_id"]).drop("batch")
