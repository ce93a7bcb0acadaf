"""Message streams and stream settings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType

# fixed values: how the live topic is read
KAFKA_OPTIONS = {"startingOffsets": "latest", "failOnDataLoss": "false"}

STREAM_SETTINGS = {
    "spark.sql.streaming.metricsEnabled": "true",
    # state larger than memory stays on local disk and is backed up with the checkpoint
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
# belongs to the cluster's configuration, as it is read at start-up only
STARTUP_SETTINGS = {"spark.streaming.stopGracefullyOnShutdown": "true"}


def configure_streams(spark: SparkSession) -> SparkSession:
    for key, value in STREAM_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def kafka_options(servers: str, topic: str, **overrides: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, **KAFKA_OPTIONS, **overrides}


def kafka_stream(spark: SparkSession, servers: str, topic: str, **overrides: str) -> DataFrame:
    """Messages of a topic as text: key, value. Needs the Kafka connector on the cluster."""
    stream = spark.readStream.format("kafka").options(**kafka_options(servers, topic, **overrides)).load()
    return stream.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def replay_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Recorded messages, one per line, released a few files at a time."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)


def table_stream(
    spark: SparkSession, folder: str, schema: StructType, file_format: str = "parquet", files_per_batch: int | None = None, pattern: str | None = None
) -> DataFrame:
    """Rows of files as they appear in a folder."""
    reader = spark.readStream.schema(schema).format(file_format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder)


class ProgressLog(StreamingQueryListener):
    """Keeps the latest progress of every query: rows in, rate, state size."""

    def __init__(self):
        self.progress: dict[str, dict] = {}
        self.ended: list[str] = []

    def onQueryStarted(self, event):
        self.progress[str(event.id)] = {}

    def onQueryProgress(self, event):
        self.progress[str(event.progress.id)] = json.loads(event.progress.json)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended.append(str(event.id))
