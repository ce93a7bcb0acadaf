import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from quayside.catalog import views
from quayside.operators.ordered import Skew
from quayside.operators.rounds import closed_rounds, decode_messages, flatten_messages, price_rounds
from quayside.plans.dashboard import cost_dashboard
from quayside.plans.round_cost import round_cost
from quayside.schemas import COST_COLUMNS
from quayside.sources.sinks import append_batch, as_json, measurement_points, stream_sink
from quayside.streaming.costs import (
    dashboard_writer,
    drain,
    fold_writer,
    folded_stream,
    round_cost_stream,
    stored_dashboard,
    stored_folds,
    stored_rounds,
)
from quayside.streaming.monitoring import gated_samples, heartbeats, online_spells
from quayside.streaming.sources import ProgressLog, configure_streams, kafka_options, replay_stream, table_stream


@pytest.fixture(scope="module")
def ordered_files(spark, tmp_path_factory):
    """The messages as eight files in time order, so that arrival order is event order."""
    folder = str(tmp_path_factory.mktemp("messages"))
    configure_streams(spark)
    rows = views.messages(spark, "/root/testdata/sf0.001").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    for part in range(8):
        rows.filter(F.floor(F.col("event_id") / 125) == part).orderBy("timestamp", "event_id").coalesce(1).write.mode(
            "append"
        ).parquet(folder)
        time.sleep(0.02)
    return folder, rows


def as_rows(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_stream_equals_batch_over_many_small_batches(spark, ordered_files, tmp_path):
    folder, rows = ordered_files
    prices = views.prices(spark, "/root/testdata/sf0.001")
    stream = table_stream(spark, folder, rows.schema, files_per_batch=1)
    drain(round_cost_stream(stream, prices), append_batch(str(tmp_path / "out")), str(tmp_path / "log"))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.select("batch").distinct().count() == 8
    batch = round_cost(rows, prices, views.MESSAGE_ORDER)
    assert as_rows(stored_rounds(written), COST_COLUMNS) == as_rows(batch, COST_COLUMNS)


@pytest.mark.parametrize("skew", [None, Skew(0.01, 3, 5)])
def test_batch_folds_merge_to_the_whole(spark, ordered_files, tmp_path, skew):
    folder, rows = ordered_files
    # few rounds, so that a round spans batches and holds a large share of one
    schema = rows.schema
    stream = table_stream(spark, folder, schema, files_per_batch=3).withColumn("train_round", F.lit(1))
    drain(stream, fold_writer(str(tmp_path / "out"), views.MESSAGE_ORDER, skew), str(tmp_path / "log"), "append")
    prices = views.prices(spark, "/root/testdata/sf0.001")
    got = closed_rounds(price_rounds(stored_folds(spark.read.parquet(str(tmp_path / "out"))), prices))
    want = round_cost(rows.withColumn("train_round", F.lit(1)), prices, views.MESSAGE_ORDER)
    assert as_rows(got, COST_COLUMNS) == as_rows(want, COST_COLUMNS)


def test_dashboard_stream_equals_batch(spark, ordered_files, tmp_path):
    folder, rows = ordered_files
    prices = views.prices(spark, "/root/testdata/sf0.001")
    stream = table_stream(spark, folder, rows.schema, files_per_batch=4)
    drain(round_cost_stream(stream, prices), dashboard_writer(str(tmp_path / "out")), str(tmp_path / "log"))
    board = stored_dashboard(spark.read.parquet(str(tmp_path / "out")))
    want = cost_dashboard(measurement_points(round_cost(rows, prices, views.MESSAGE_ORDER)))
    columns = ["measurement", "dataset_id", "task_id", F.round("total_cost", 6)]
    assert as_rows(board, columns) == as_rows(want, columns)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    write = append_batch(str(tmp_path / "out"))
    write(spark.range(3), 0)
    write(spark.range(3), 0)
    write(spark.range(2), 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def message(second, post=None, cpu=None):
    report = {"train_round": 1}
    if post is not None:
        report["quality_of_model"] = {"post_train_performance": post, "pre_train_performance": 0.5, "train_duration": 60.0}
    else:
        report["resource_monitor"] = {"cpu_percentage": cpu, "memory_usage": 1.0}
    meta = {"name": "e", "run_id": "1", "functionality": "d", "application_name": "m"}
    return json.dumps({"metadata": meta, "timestamp": f"2024-01-01 00:00:{second:02d}", "report": report})


def test_replayed_text_messages_and_timeout(spark, tmp_path):
    """After a silence the state is gone: a late sample opens a new, unfinished round."""
    configure_streams(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("\n".join([message(1, cpu=10.0), message(2, post=0.6), message(3, cpu=99.0)]))
    stream = flatten_messages(decode_messages(replay_stream(spark, str(tmp_path / "in"))))
    query = (
        folded_stream(stream, timeout_ms=1500)
        .writeStream.outputMode("update")
        .option("checkpointLocation", str(tmp_path / "log"))
        .foreachBatch(append_batch(str(tmp_path / "out")))
        .trigger(processingTime="300 milliseconds")
        .start()
    )

    def batches(done):
        try:
            return spark.read.parquet(str(tmp_path / "out")).filter(F.col("done") == done).collect()
        except Exception:  # noqa: BLE001
            return []

    def wait(done):
        for _ in range(100):
            if batches(done):
                return batches(done)
            time.sleep(0.3)
        raise AssertionError("no output")

    try:
        first = wait(True)
        assert len(first) == 1 and first[0]["closing"]["peak_cpu"] == 10.0 and first[0]["msg_count"] == 3
        time.sleep(5)
        assert len(batches(True)) == 1
        (tmp_path / "in" / "2.txt").write_text(message(9, cpu=5.0))
        late = wait(False)
        assert late[0]["msg_count"] == 1
    finally:
        query.stop()


def test_live_sink_listener_and_json(spark, ordered_files, tmp_path):
    folder, rows = ordered_files
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        stream = as_json(table_stream(spark, folder, rows.schema).select("event_id", "edge_id"))
        query = stream_sink(stream, str(tmp_path / "out"), str(tmp_path / "log"), seconds=10, mode="append")
        query.processAllAvailable()
        for _ in range(50):
            if log.progress.get(str(query.id)):
                break
            time.sleep(0.2)
        query.stop()
    finally:
        spark.streams.removeListener(log)
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == rows.count() and written.columns[0] == "value"
    assert log.progress[str(query.id)]["numInputRows"] >= 0


def test_kafka_options():
    got = kafka_options("host:9092", "topic", maxOffsetsPerTrigger="1000")
    assert got["startingOffsets"] == "latest" and got["failOnDataLoss"] == "false"
    assert got["subscribe"] == "topic" and got["maxOffsetsPerTrigger"] == "1000"


def test_gated_samples_keep_their_round_across_batches(spark, tmp_path):
    configure_streams(spark)
    rows = [
        [("e", 1, 1.0, None, None), ("e", 2, None, "start", 7)],
        [("e", 3, 2.0, None, None), ("f", 3, 9.0, None, None)],
        [("e", 4, None, "end", 7), ("e", 5, 3.0, None, None), ("e", 6, None, "start", 8), ("e", 7, 4.0, None, None)],
    ]
    schema = "edge_id string, timestamp timestamp, value double, status string, train_round int"
    for part in rows:
        df = spark.createDataFrame([(e, dt.datetime(2024, 1, 1, 0, 0, t), v, s, r) for e, t, v, s, r in part], schema)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    stream = table_stream(spark, str(tmp_path / "in"), df.schema, files_per_batch=1)
    drain(gated_samples(stream), append_batch(str(tmp_path / "out")), str(tmp_path / "log"), "append")
    got = spark.read.parquet(str(tmp_path / "out")).select("edge_id", "value", "train_round").collect()
    assert sorted(map(tuple, got)) == [("e", 2.0, 7), ("e", 4.0, 8)]


def test_heartbeats_and_spells(spark, tmp_path):
    beats = [("e1", 0), ("e1", 300), ("e1", 2000), ("e2", 100)]
    text = [json.dumps({"edge_id": e, "type": "edge", "health": {"mem": 1, "cpu": 2, "gpu": -1}, "timestamp": float(t)}).replace('"', "'") for e, t in beats]
    text.append("{'type': 'service', 'request_id': 'r'}")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(text))
    raw = spark.readStream.text(str(tmp_path / "in"))
    sent = F.timestamp_seconds(F.get_json_object(F.translate("value", "'", '"'), "$.timestamp").cast("double"))
    drain(online_spells(heartbeats(raw, arrival=sent)), append_batch(str(tmp_path / "out")), str(tmp_path / "log"), "complete")
    got = spark.read.parquet(str(tmp_path / "out")).select("edge_id", F.unix_seconds("from"), F.unix_seconds("until"), "beats")
    assert sorted(map(tuple, got.collect())) == [("e1", 0, 900, 2), ("e1", 2000, 2600, 1), ("e2", 100, 700, 1)]
    assert "arrived" in heartbeats(spark.read.text(str(tmp_path / "in"))).columns
