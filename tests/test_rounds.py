import datetime as dt

import pytest
from pyspark.sql import functions as F

from quayside.functions.pricing import STANDARD_COSTS, quality_cost, resource_cost, static_quality_price
from quayside.operators.rounds import decode_messages, flatten_messages, fold_rounds, price_rounds
from quayside.plans.round_cost import round_cost
from quayside.schemas import COST_COLUMNS

T0 = dt.datetime(2024, 1, 1)
MESSAGE = (
    "seq int, model_id string, run_id string, dataset_id string, train_round int, edge_id string, timestamp timestamp, "
    "quality_of_model struct<pre_train_performance:double,post_train_performance:double,test_performance:double,"
    "train_duration:double>, resource_monitor struct<cpu_percentage:double,memory_usage:double>"
)
PRICE = (
    "model_id string, dataset_id string, qom_cost_function string, qom_base_cost struct<performance:double,loss:double>, "
    "resource_cost_function string, resource_base_cost struct<by_minute:double,cpu:double,memory:double>, "
    "cost_quantity_quality double, cost_context double"
)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_cost_functions(spark):
    lit = F.lit
    assert value(spark, quality_cost(lit(19.9), lit(0.5), lit(0.6))) == pytest.approx(0.995)
    assert value(spark, quality_cost(lit(19.9), lit(0.6), lit(0.5))) == 0.0
    args = [lit(0.01), lit(2.0), lit(0.01), lit(200.0), lit(0.001), lit(512.0)]
    assert value(spark, resource_cost(*args)) == pytest.approx(0.05024)
    args[4] = lit(None).cast("double")
    assert value(spark, resource_cost(*args)) == pytest.approx(0.04)


def test_unknown_function_name_gives_null(spark):
    arguments = {k: F.lit(1.0) for k in ("performance_price", "pre", "post", "by_minute", "minutes", "cpu_price", "cpu", "memory_price", "memory_mb")}
    assert value(spark, STANDARD_COSTS.choose(F.lit("nothing"), arguments)) is None
    assert value(spark, STANDARD_COSTS.choose(F.lit(None).cast("string"), arguments)) is None


# logged metric values of two datasets, and the prices they give
@pytest.mark.parametrize(
    "metrics,price",
    [
        ([0.9528, 0.9798, 0.3272, 0.8547, 0.9048, 0.7676], 14.22),
        ([0.963, 0.9867, 0.34, 0.8578, 0.9051, 0.7794], 14.35),
    ],
)
def test_static_price(spark, metrics, price):
    assert value(spark, static_quality_price(F.lit(sum(metrics)))) == price


def messages(spark, *rows):
    full = []
    for seq, (quality, usage) in enumerate(rows):
        full.append((seq, "m", "1", "d", 1, "e", T0 + dt.timedelta(seconds=seq), quality, usage))
    return spark.createDataFrame(full, MESSAGE)


def test_samples_after_the_report_move_only_the_time(spark):
    quality = (0.5, 0.6, 0.55, 120.0)
    got = fold_rounds(messages(spark, (None, (10.0, 5.0)), (quality, None), (None, (99.0, 99.0))), ["timestamp", "seq"])
    row = got.first()
    assert row["done"] and row["closing"]["peak_cpu"] == 10.0 and row["closing"]["peak_memory"] == 5.0
    assert row["timestamp"] == T0 + dt.timedelta(seconds=2) and row["msg_count"] == 3


def test_a_second_report_sees_the_later_samples(spark):
    q1, q2 = (0.5, 0.6, 0.55, 120.0), (0.6, 0.7, 0.65, 60.0)
    got = fold_rounds(messages(spark, (q1, None), (None, (99.0, 9.0)), (q2, None)), ["timestamp", "seq"]).first()
    assert got["closing"]["peak_cpu"] == 99.0 and got["closing"]["post"] == 0.7


def test_an_open_round_is_not_published(spark):
    prices = spark.createDataFrame([], PRICE)
    assert round_cost(messages(spark, (None, (1.0, 1.0))), prices, ["timestamp", "seq"]).count() == 0


def test_unmatched_rounds_cost_nothing(spark):
    prices = spark.createDataFrame([], PRICE)
    folded = fold_rounds(messages(spark, ((0.5, 0.6, 0.5, 60.0), None)), ["timestamp", "seq"])
    row = price_rounds(folded, prices).first()
    assert (row["model_id"], row["cost_resource"], row["cost_qom"], row["cost_qod"], row["price_found"]) == ("m", 0.0, 0.0, 0.0, False)


def test_memory_unit(spark):
    prices = spark.createDataFrame(
        [("m", "d", "qom_cost_by_train_performance", (1.0, None), "resource_cost_by_cpu_mem", (1.0, 0.0, 1.0), 1.0, 2.0)], PRICE
    )
    rows = messages(spark, (None, (0.0, 1048576.0)), ((0.5, 0.6, 0.5, 60.0), None))
    by_bytes = round_cost(rows, prices, ["timestamp", "seq"]).first()
    by_mb = round_cost(rows, prices, ["timestamp", "seq"], memory_unit="mb").first()
    assert by_bytes["cost_resource"] == 1.0 and by_mb["cost_resource"] == 1048576.0
    assert list(by_bytes.asDict()) == COST_COLUMNS


def test_bad_json_is_a_null_message(spark):
    good = '{"metadata":{"name":"e","run_id":"1","functionality":"d","application_name":"m"},"timestamp":"2024-01-01 00:00:00","report":{"train_round":3,"quality_of_model":{"post_train_performance":0.9,"evaluate_on_test":1}}}'
    df = decode_messages(spark.createDataFrame([(good,), ("{oops",)], "value string"))
    rows = flatten_messages(df).collect()
    assert rows[0]["model_id"] == "m" and rows[0]["train_round"] == 3
    assert rows[0]["quality_of_model"]["post_train_performance"] == 0.9 and rows[0]["resource_monitor"] is None
    assert rows[1]["model_id"] is None
