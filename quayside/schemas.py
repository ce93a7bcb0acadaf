"""Schemas of the data that crosses the system boundary."""

from __future__ import annotations

from pyspark.sql import types as T


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


# fixed values: field names of the wire formats
MODEL_QUALITY = _doubles(
    "post_train_performance",
    "pre_train_performance",
    "pre_loss_value",
    "post_loss_value",
    "train_duration",
    "test_performance",
    "test_loss",
)
RESOURCE_USE = _doubles("cpu_percentage", "memory_usage")

MESSAGE = T.StructType(
    [
        T.StructField(
            "metadata",
            T.StructType(
                [T.StructField(n, T.StringType()) for n in ("name", "run_id", "functionality", "application_name")]
            ),
        ),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField(
            "report",
            T.StructType(
                [
                    T.StructField("train_round", T.IntegerType()),
                    T.StructField("quality_of_model", MODEL_QUALITY),
                    T.StructField("resource_monitor", RESOURCE_USE),
                ]
            ),
        ),
    ]
)

QUALITY_PRICE = _doubles("performance", "loss")
RESOURCE_PRICE = _doubles("by_minute", "cpu", "memory", "gpu", "network", "storage")

PRICE_FILE = T.StructType(
    [
        T.StructField("model_id", T.StringType()),
        T.StructField("data_source_id", T.StringType()),
        T.StructField("qom_cost_function", T.StringType()),
        T.StructField("qom_base_cost", QUALITY_PRICE),
        T.StructField("resource_cost_function", T.StringType()),
        T.StructField("resource_base_cost", RESOURCE_PRICE),
        T.StructField("cost_quantity_quality", T.StringType()),
        T.StructField("cost_context", T.StringType()),
    ]
)
# the CSV form keeps the two price objects as JSON text
PRICE_TEXT = T.StructType([T.StructField(f.name, T.StringType()) for f in PRICE_FILE.fields])

ROUND_KEYS = ["model_id", "run_id", "dataset_id", "train_round"]
COST_COLUMNS = [
    *ROUND_KEYS,
    "timestamp",
    "edge_id",
    "cost_resource",
    "cost_qom",
    "cost_qod",
    "cost_context",
    "improvement_diff",
    "performance_post",
    "performance_test",
]
COST_FIELDS = [
    "cost_resource",
    "cost_qom",
    "cost_qod",
    "cost_context",
    "improvement_diff",
    "performance_post",
    "performance_test",
]
ROUND_COST = T.StructType(
    [
        T.StructField("model_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("dataset_id", T.StringType()),
        T.StructField("train_round", T.IntegerType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("edge_id", T.StringType()),
        *[T.StructField(n, T.DoubleType()) for n in COST_FIELDS],
    ]
)

SENSOR_SECONDS = T.StructType([T.StructField("Sample", T.DoubleType()), T.StructField("Value", T.DoubleType())])
SIGNAL_CHUNK = "file_id string, pos long, value double"

HEARTBEAT = T.StructType(
    [
        T.StructField("edge_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("routing_key", T.StringType()),
        T.StructField(
            "health",
            T.StructType(
                [
                    T.StructField("mem", T.LongType()),
                    T.StructField("cpu", T.IntegerType()),
                    T.StructField("gpu", T.IntegerType()),
                ]
            ),
        ),
        T.StructField("docker_available", T.MapType(T.StringType(), T.StringType())),
        T.StructField("timestamp", T.DoubleType()),
    ]
)
