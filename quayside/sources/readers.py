"""Batch readers, and the registry of provider-supplied ones."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quayside.functions.numeric import try_double
from quayside.functions.text import epoch_text, repair_quotes
from quayside.schemas import PRICE_FILE, PRICE_TEXT, QUALITY_PRICE, RESOURCE_PRICE


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header. Without a schema every column is text; nothing is inferred from the data."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def _price_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "model_id",
        F.col("data_source_id").alias("dataset_id"),
        "qom_cost_function",
        "qom_base_cost",
        "resource_cost_function",
        "resource_base_cost",
        try_double(F.col("cost_quantity_quality")).alias("cost_quantity_quality"),
        try_double(F.col("cost_context")).alias("cost_context"),
    )


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Price table from a JSON array."""
    return _price_columns(spark.read.schema(PRICE_FILE).option("multiLine", True).json(path))


def read_prices_csv(spark: SparkSession, path: str) -> DataFrame:
    """Price table from CSV, where the two price objects are JSON text; a malformed number gives null."""
    text = (
        spark.read.schema(PRICE_TEXT).option("header", True).option("quote", '"').option("escape", "\\").csv(path)
    )
    return _price_columns(
        text.withColumn("qom_base_cost", F.from_json("qom_base_cost", QUALITY_PRICE)).withColumn(
            "resource_base_cost", F.from_json("resource_base_cost", RESOURCE_PRICE)
        )
    )


def normalise_messages(df: DataFrame, schema: StructType, value: str = "value") -> DataFrame:
    """Queue messages to stream messages: quotes repaired, epoch time written as text, JSON out.

    ``schema`` describes the raw message with ``timestamp`` as a number.
    """
    raw = F.from_json(repair_quotes(F.col(value).cast("string")), schema)
    fields = [
        epoch_text(F.col("_raw.timestamp")).alias("timestamp") if n == "timestamp" else F.col(f"_raw.{n}").alias(n)
        for n in schema.fieldNames()
    ]
    return df.withColumn("_raw", raw).withColumn(value, F.to_json(F.struct(*fields))).drop("_raw")


Reader = Callable[[SparkSession, Mapping], DataFrame]


class Readers:
    """Provider-supplied readers by name; a reader turns its configuration into a DataFrame."""

    def __init__(self, readers: Mapping[str, Reader] | None = None):
        self._readers = dict(readers or {})

    def register(self, name: str, reader: Reader) -> Readers:
        return Readers({**self._readers, name: reader})

    def read(self, spark: SparkSession, name: str, conf: Mapping) -> DataFrame:
        if name not in self._readers:
            raise KeyError(f"no reader named {name!r}")
        return self._readers[name](spark, conf)


STANDARD_READERS = Readers(
    {
        "csv": lambda spark, conf: read_csv(spark, conf["location"], conf.get("schema")),
        "parquet": lambda spark, conf: spark.read.parquet(conf["location"]),
        "json": lambda spark, conf: spark.read.schema(conf["schema"]).json(conf["location"]),
    }
)
