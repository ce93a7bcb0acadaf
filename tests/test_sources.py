import json
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.plans.extraction import Extractor, TableExtractor, serve, summarise
from quayside.plans.round_cost import round_cost
from quayside.schemas import SENSOR_SECONDS
from quayside.sources.readers import STANDARD_READERS, normalise_messages, read_csv, read_prices, read_prices_csv
from quayside.sources.signals import read_signals
from quayside.sources.sinks import as_json, measurement_points, write_extract, write_partitions

PRICE = {
    "model_id": "m",
    "data_source_id": "d1",
    "qom_cost_function": "qom_cost_by_train_performance",
    "qom_base_cost": {"performance": 23.5},
    "resource_cost_function": "resource_cost_by_cpu_mem",
    "resource_base_cost": {"by_minute": 0.02, "cpu": 0.02, "memory": 0.003},
    "cost_quantity_quality": 11.75,
    "cost_context": 3.25,
}


def test_csv_with_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Sample,Value\n0.5,1.25\n30.1,2\n")
    rows = read_csv(spark, str(tmp_path / "a.csv"), SENSOR_SECONDS).collect()
    assert [tuple(r) for r in rows] == [(0.5, 1.25), (30.1, 2.0)]
    assert read_csv(spark, str(tmp_path / "a.csv")).dtypes == [("Sample", "string"), ("Value", "string")]


def test_price_json(spark, tmp_path):
    second = {**PRICE, "data_source_id": "d2", "resource_base_cost": {"by_minute": 0.02}}
    (tmp_path / "p.json").write_text(json.dumps([PRICE, second], indent=1))
    rows = {r["dataset_id"]: r for r in read_prices(spark, str(tmp_path / "p.json")).collect()}
    assert rows["d1"]["resource_base_cost"]["memory"] == 0.003 and rows["d1"]["cost_quantity_quality"] == 11.75
    assert rows["d2"]["resource_base_cost"]["cpu"] is None


def test_price_csv_with_a_malformed_number(spark, tmp_path):
    quoted = '"{\\"performance\\":23.5}",resource_cost_by_cpu_mem,"{\\"by_minute\\":0.02, \\"cpu\\": 0.02}"'
    head = ",".join(PRICE)
    (tmp_path / "p.csv").write_text(f"{head}\nm,d1,qom,{quoted},11.75,3.25\nm,d2,qom,{quoted},8.41.,3.25\n")
    rows = {r["dataset_id"]: r for r in read_prices_csv(spark, str(tmp_path / "p.csv")).collect()}
    assert rows["d1"]["qom_base_cost"]["performance"] == 23.5 and rows["d1"]["cost_quantity_quality"] == 11.75
    assert rows["d2"]["cost_quantity_quality"] is None and rows["d2"]["resource_base_cost"]["cpu"] == 0.02


@pytest.mark.parametrize("slice_samples", [7, 16384])
def test_raw_signals(spark, tmp_path, slice_samples):
    first = [0, 1 << 30, -(1 << 31), (1 << 31) - 1, *range(16)]
    (tmp_path / "BR_CC_ND_N_H1.raw").write_bytes(struct.pack(f"<{len(first)}i", *first) + b"xx")
    (tmp_path / "N_H1.v2.raw").write_bytes(struct.pack("<3i", 8, 16, 32))
    rows = read_signals(spark, str(tmp_path), samples=10, slice_samples=slice_samples).collect()
    got = {}
    for r in rows:
        got.setdefault(r["file_id"], {})[r["pos"]] = r["value"]
    assert got["BR_CC_ND_N_H1"] == {i: v / 2**31 for i, v in enumerate(first[:10])}
    assert got["N_H1"] == {0: 8 / 2**31, 1: 16 / 2**31, 2: 32 / 2**31}


def test_signals_as_one_folder_per_recording(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.raw").write_bytes(struct.pack("<2i", 1, 2))
    write_partitions(read_signals(spark, str(tmp_path / "in")).select("file_id", "value"), str(tmp_path / "out"), ["file_id"])
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["file_id=a", "file_id=b"]


def test_messages_are_normalised(spark):
    df = spark.createDataFrame([("{'name': 'e1', 'timestamp': 1704067261.7}",)], "value string")
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("timestamp", T.DoubleType())])
    got = json.loads(normalise_messages(df, schema).first()["value"])
    assert got == {"name": "e1", "timestamp": "2024-01-01 00:01:01"}


def test_readers_by_name(spark, tmp_path):
    readers = STANDARD_READERS.register("numbers", lambda s, conf: s.range(conf["n"]))
    assert readers.read(spark, "numbers", {"n": 4}).count() == 4
    with pytest.raises(KeyError):
        STANDARD_READERS.read(spark, "numbers", {})


REQUEST = {
    "owner_id": "o",
    "dataset_id": "d",
    "features": [{"name": "pressure", "index": 1}, {"name": "flow", "index": 0}],
    "label": {"name": "faulty", "index": 2},
    "filters": {"operator": "and", "constraints": [{"feature_name": "flow", "from": 10, "to": "*"}]},
    "sample_limit": {"number": 3, "method": "random"},
}


def test_a_request_end_to_end(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,flow,pressure,faulty\n" + "".join(f"{i},{i},{i * 10},{i % 2}\n" for i in range(40)))
    conf = {
        "owner_id": "o",
        "dataset_id": "d",
        "dest_path": str(tmp_path / "out"),
        "schema": "id int, flow double, pressure int, faulty int",
    }
    request = {**REQUEST, "access_info": {"type": "file", "location": str(tmp_path / "in.csv")}}
    response = serve(spark, request, conf, ["id"], request_id="r1")
    assert response["data_summary"] == {"columns": 3, "rows": 3}
    assert response["read_info"]["location"].endswith("d_r1")
    written = spark.read.csv(response["read_info"]["location"], header=True, inferSchema=True)
    assert written.columns == ["flow", "pressure", "faulty"] and written.filter("flow < 10").count() == 0
    with pytest.raises(PermissionError):
        serve(spark, {**request, "owner_id": "other"}, conf, ["id"])


def test_extractor_without_limits_returns_everything(spark):
    source = spark.range(5).withColumn("v", F.col("id"))
    extractor = TableExtractor(source, ["id"])
    assert isinstance(extractor, Extractor)
    assert extractor.extract([], None).columns == ["id", "v"]
    assert extractor.extract([], None, sample_limit={"number": 9, "method": "random"}).count() == 5
    assert summarise(source).first().asDict() == {"rows": 5, "columns": 2}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, provider string")
    write_partitions(df, str(tmp_path / "by"), ["provider"])
    assert sorted(p.name for p in (tmp_path / "by").iterdir() if p.is_dir()) == ["provider=a", "provider=b"]
    path = write_extract(df, str(tmp_path), "d", "r")
    write_extract(df, str(tmp_path), "d", "r")
    assert spark.read.csv(path, header=True).count() == 2
    assert json.loads(as_json(df.filter("x = 1")).first()["value"]) == {"x": 1, "provider": "a"}


def test_points(spark, sf_dir):
    from quayside.catalog import views

    costs = round_cost(views.messages(spark, sf_dir), views.prices(spark, sf_dir), views.MESSAGE_ORDER)
    points = measurement_points(costs)
    assert points.columns == ["measurement", "dataset_id", "run_id", "task_id", "time", "field", "value"]
    assert points.count() == 7 * costs.count()
    assert all(len(r["task_id"]) == 3 for r in points.select("task_id").distinct().collect())
