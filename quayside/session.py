"""Session settings and the shared scratch area."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a skewed join is split even when the grouping after it then needs its own exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # bounds what a Python task and its JVM side hold of long texts; 10 000 rows otherwise
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session: Python tasks import its modules there.

    The archive lies in the driver's folder of files that Spark hands out.
    """
    context = spark.sparkContext
    if getattr(context, "_quayside_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(SparkFiles.getRootDirectory(), f"quayside-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._quayside_shipped = True


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the operators are written for, and make the package known to the executors."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    if os.path.isdir(os.path.dirname(os.path.abspath(__file__))):
        ship(spark)
    return spark


def build(app: str = "quayside", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None and named:
        context.setCheckpointDir(named)
    if context.getCheckpointDir():
        return named or context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="quayside-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and cut its lineage.

    Used where a result feeds several later branches, so that losing an executor
    neither repeats the work before it nor changes what the branches see.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
