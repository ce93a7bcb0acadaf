"""Stateful processors against batch results: arrival order, timers, initial states, late points, compaction."""

from __future__ import annotations

import datetime as dt
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quayside.catalog import views
from quayside.operators.rounds import fold_rounds
from quayside.plans.dashboard import cost_dashboard
from quayside.schemas import ROUND_KEYS
from quayside.sources.sinks import append_batch, measurement_points
from quayside.streaming.costs import compact, compacted_through, current_folds, drain, fold_writer, stored_folds
from quayside.streaming.live_dashboard import live_dashboard, shown_dashboard, totals
from quayside.streaming.liveness import LivenessProcessor, merged, transitions
from quayside.streaming.round_state import Held, folded, keyed_rounds, resumed_rounds
from quayside.streaming.sources import configure_streams, table_stream

START = dt.datetime(2024, 1, 1)


def messages(seed: int, n: int) -> pd.DataFrame:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        quality = rng.random() < 0.1
        rows.append(
            {
                "at": rng.randrange(50), "seq": i, "edge_id": rng.choice([None, "a", "b"]), "is_quality": quality,
                "cpu": None if quality else rng.choice([None, rng.randrange(100)]), "memory": None if quality else rng.randrange(100),
                **{c: rng.random() if quality else None for c in ("pre", "post", "test", "duration")},
            }
        )
    return pd.DataFrame(rows).astype({c: float for c in ("cpu", "memory", "pre", "post", "test", "duration")})


def whole(frame: pd.DataFrame) -> tuple:
    """Count, latest, first edge, and peaks up to the last quality message with its metrics."""
    ordered = frame.sort_values(["at", "seq"], ignore_index=True)
    edges, reports = ordered["edge_id"].dropna(), ordered.index[ordered["is_quality"]]
    closing = None
    if len(reports):
        head = ordered.loc[: reports[-1]]
        closing = (max(0.0, head["cpu"].max()), max(0.0, head["memory"].max()), *ordered.loc[reports[-1], ["pre", "post", "test", "duration"]])
    return len(frame), int(frame["at"].max()), edges.iloc[0] if len(edges) else None, closing


@pytest.mark.parametrize("seed", range(8))
def test_any_arrival_order_gives_the_same_round(seed):
    frame = messages(seed, 60)
    mixed = frame.sample(frac=1, random_state=seed)
    held, steps = Held(), []
    for part in np.array_split(np.arange(len(mixed)), 7):
        held, steps = folded(held, steps, mixed.iloc[part])
    closing = (held.close_cpu, held.close_memory, held.pre, held.post, held.test, held.duration) if held.closed else None
    count, latest, edge, want = whole(frame)
    assert (held.count, held.latest, held.edge) == (count, latest, edge)
    assert (closing is None) == (want is None) and (want is None or closing == pytest.approx(np.nan_to_num(want)))
    # only rising peaks behind the last quality message are kept
    assert steps == sorted(steps) and all(b[2] > a[2] or b[3] > a[3] for a, b in zip(steps, steps[1:]))


def test_empty_frames_change_nothing():
    assert folded(Held(), [], messages(1, 3).iloc[:0]) == (Held(), [])


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """The messages as four files, dealt without regard to time."""
    configure_streams(spark)
    folder = str(tmp_path_factory.mktemp("messages"))
    rows = views.messages(spark, "/root/testdata/sf0.001").withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumn("train_round", F.col("train_round") % 4)
    for part in range(4):
        rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == part).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)
    return folder, rows


COLUMNS = [*ROUND_KEYS, "unix_micros(cast(timestamp as timestamp))", "edge_id", "msg_count", "closing", "done"]


def as_rows(df, columns):
    return sorted(map(tuple, df.selectExpr(*columns).collect()), key=repr)


def test_keyed_state_equals_fold_whatever_the_order(spark, files, tmp_path):
    folder, rows = files
    stream = table_stream(spark, folder, rows.schema, files_per_batch=1)
    drain(keyed_rounds(stream, views.MESSAGE_ORDER), append_batch(str(tmp_path / "out")), str(tmp_path / "log"))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.select("batch").distinct().count() == 4
    want = fold_rounds(rows, views.MESSAGE_ORDER)
    assert as_rows(resumed_rounds(written, want.limit(0)), COLUMNS) == as_rows(want, COLUMNS)


def test_initial_state_goes_on_from_stored_folds(spark, files, tmp_path):
    folder, rows = files
    middle = F.lit(rows.agg(F.percentile_approx("timestamp", 0.7)).first()[0])
    folds = fold_rounds(rows.filter(F.col("timestamp") < middle), views.MESSAGE_ORDER)
    stream = table_stream(spark, folder, rows.schema, files_per_batch=2).filter(F.col("timestamp") >= middle)
    drain(keyed_rounds(stream, views.MESSAGE_ORDER, initial=folds), append_batch(str(tmp_path / "out")), str(tmp_path / "log"))
    got = resumed_rounds(spark.read.parquet(str(tmp_path / "out")), folds)
    assert as_rows(got, COLUMNS) == as_rows(fold_rounds(rows, views.MESSAGE_ORDER), COLUMNS)


def test_a_silent_round_is_forgotten_by_its_timer(spark, files, tmp_path):
    _, rows = files
    one = rows.filter("quality_of_model IS NULL").limit(1).cache()
    one.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = table_stream(spark, str(tmp_path / "in"), rows.schema)
    query = (
        keyed_rounds(stream, views.MESSAGE_ORDER, timeout_ms=1000).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "log"))
        .foreachBatch(append_batch(str(tmp_path / "out"))).trigger(processingTime="300 milliseconds").start()
    )

    def counts():
        try:
            return sorted(r.msg_count for r in spark.read.parquet(str(tmp_path / "out")).collect())
        except Exception:  # noqa: BLE001
            return []

    try:
        for _ in range(100):
            if counts():
                break
            time.sleep(0.3)
        time.sleep(6)
        one.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(100):
            if len(counts()) > 1:
                break
            time.sleep(0.3)
    finally:
        query.stop()
    # the second message does not continue the first
    assert counts() == [1, 1]


def test_spells_merge_in_any_order():
    rng = random.Random(4)
    for _ in range(50):
        beats = [rng.randrange(500) for _ in range(rng.randrange(1, 30))]
        ordered, want = sorted(beats), []
        for b in ordered:
            if want and b <= want[-1][1] + 10:
                want[-1] = (want[-1][0], b, False)
            else:
                want.append((b, b, False))
        spells = []
        for part in (beats[::3], beats[1::3], beats[2::3]):
            spells = merged(spells, np.array(part, np.int64), 10)
        assert spells == want
    assert merged([(0, 5, True), (40, 50, False)], np.array([12, 20, 30]), 10) == [(0, 50, True)]


def beat_files(spark, folder, batches):
    for batch in batches:
        rows = [(edge, START + dt.timedelta(seconds=s)) for edge, s in batch]
        spark.createDataFrame(rows, "edge_id string, arrived timestamp").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    return table_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)


def test_a_silent_edge_goes_offline_without_another_beat_of_its_own(spark, tmp_path):
    configure_streams(spark)
    batches = [
        [("silent", 0), ("busy", 0), ("busy", 500)],
        [("busy", 1000), ("late", 1000)],
        [("busy", 1500), ("late", 500)],  # joins the spell, which was not told yet
        [("busy", 2000), ("late", 1700)],  # 700 after the last: the edge was offline in between
        [("busy", 2500), ("silent", 10)],  # behind the watermark: nothing is taken back
        [("busy", 3000), (None, 2990)],
    ]
    stream = beat_files(spark, str(tmp_path / "in"), batches)
    drain(transitions(stream, late="600 seconds"), append_batch(str(tmp_path / "out")), str(tmp_path / "log"), "append", empty_batches=True)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    told = sorted((r.edge_id, (r.at - START).total_seconds(), r.status) for r in rows)
    # the watermark ends at 2400
    assert told == [
        ("busy", 0, "online"), ("late", 500, "online"), ("late", 1600, "offline"), ("late", 1700, "online"), ("late", 2300, "offline"),
        ("silent", 0, "online"), ("silent", 600, "offline"),
    ]


class OneEdge:
    """State and timers of one edge, as a processor's handle gives them; counts the timers registered."""

    def __init__(self):
        self.value, self.timers, self.registered = None, set(), 0

    def getValueState(self, *_):
        return self

    getListState = getValueState

    def get(self):
        return [] if self.value is None else self.value

    def put(self, value):
        self.value = value

    update = put

    def clear(self):
        self.value = None

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.registered += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_an_edge_has_one_timer_however_many_spells():
    handle, processor = OneEdge(), LivenessProcessor(10)
    processor.init(handle)
    list(processor.handleInputRows((1,), iter([pd.DataFrame({"at_ms": np.arange(200) * 100})]), Watermark(-1)))
    assert handle.registered == 1 and handle.timers == {0}
    handle.timers.clear()  # it expired
    told = pd.concat(processor.handleExpiredTimer((1,), Watermark(10_000), None))
    want = [("online", s * 100) for s in range(101)] + [("offline", s * 100 + 10) for s in range(100)]
    assert list(zip(told["status"], told["at_ms"], strict=True)) == want and set(told["edge"]) == {1}
    assert handle.registered == 2 and handle.timers == {10_010}


def test_totals_of_absent_values():
    points = [("a", (1, 0, 1.0, None, 5.0, 6.0)), ("b", (2, 0, 2.0, 3.0, None, 7.0))]
    assert totals(points, [10.0, 20.0]) == [("a", 1, 11.0, None, 5.0, 6.0), ("b", 2, 13.0, 23.0, None, 7.0)]


def test_dashboard_with_late_and_repeated_points_equals_batch(spark, tmp_path):
    configure_streams(spark)
    rng = random.Random(6)
    versions = [[] for _ in range(4)]
    for series in range(3):
        for task in range(12):
            for batch in sorted(rng.sample(range(4), rng.choice([1, 1, 2]))):
                costs = [rng.choice([None, 1.0, 2.5]), rng.random(), 1.0, rng.choice([None, 3.0])]
                versions[batch].append((f"m{series}", "1", "d", task, START + dt.timedelta(seconds=rng.randrange(100)), "e", *costs, None, None, None, batch))
    fields = "cost_resource double, cost_qom double, cost_qod double, cost_context double, improvement_diff double, performance_post double, performance_pre double"
    schema = f"model_id string, run_id string, dataset_id string, train_round int, timestamp timestamp, edge_id string, {fields}, version int"
    folder = str(tmp_path / "in")
    for rows in versions:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    stream = table_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
    drain(live_dashboard(stream), append_batch(str(tmp_path / "out")), str(tmp_path / "log"))
    board = shown_dashboard(spark.read.parquet(str(tmp_path / "out")))
    newest = {}
    for rows in versions:
        newest |= {r[:4]: r for r in rows}
    frame = spark.createDataFrame(list(newest.values()), schema)
    points = measurement_points(frame.select("*", *[F.lit(None).cast("double").alias(c) for c in ("performance_test", "improvement") if c not in frame.columns]))
    want = cost_dashboard(points.filter("value IS NOT NULL"))
    columns = ["measurement", "dataset_id", "run_id", "task_id", "time", "round(total_cost, 9)"]
    assert as_rows(board, columns) == as_rows(want, columns)


def test_compaction_repeated_and_interrupted(spark, files, tmp_path):
    _, rows = files
    rows = rows.withColumn("n", F.percent_rank().over(Window.orderBy("timestamp", "event_id"))).cache()
    path = str(tmp_path / "folds")
    write = fold_writer(path, views.MESSAGE_ORDER, compact_every=4)
    for batch in range(14):
        part = rows.filter((F.col("n") >= batch / 14) & ((F.col("n") < (batch + 1) / 14) | F.lit(batch == 13))).drop("n")
        write(part, batch)
        if batch in (4, 9):
            write(part, batch)  # the batch runs again
    want = as_rows(fold_rounds(rows, views.MESSAGE_ORDER), COLUMNS)
    assert compacted_through(spark, path) == 11
    assert current_folds(spark, path).select("batch").distinct().count() == 3
    assert as_rows(stored_folds(current_folds(spark, path)), COLUMNS) == want
    # a base that was not finished is not used, and is written anew later
    spark.range(1).withColumn("broken", F.lit(1)).write.parquet(f"{path}-base/folds/through=12")
    assert as_rows(stored_folds(current_folds(spark, path)), COLUMNS) == want
    compact(spark, path, 12)
    compact(spark, path, 12)
    compact(spark, path, 5)
    assert compacted_through(spark, path) == 12
    assert as_rows(stored_folds(current_folds(spark, path)), COLUMNS) == want
    assert current_folds(spark, str(tmp_path / "nothing")) is None
