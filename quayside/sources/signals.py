"""Raw acoustic recordings: PCM, 32 bit little endian, one channel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quayside.operators.windows import fixed_rate_second

# fixed values: recording format
SAMPLE_RATE = 8000
SAMPLE_BYTES = 4
FIRST_SAMPLES = 240000
FULL_SCALE = 2.0**31


@F.pandas_udf(ArrayType(DoubleType()))
def _decode(content: pd.Series) -> pd.Series:
    return content.map(lambda b: np.frombuffer(b, "<i4", count=len(b) // SAMPLE_BYTES) / FULL_SCALE)


def read_signals(
    spark: SparkSession, path: str, samples: int = FIRST_SAMPLES, slice_samples: int = 16384
) -> DataFrame:
    """The first samples of every file: file_id, pos, second, value in [-1, 1).

    Files are cut into slices before decoding, so that a worker holds one slice at a time.
    """
    slices = -(-samples // slice_samples)
    width = slice_samples * SAMPLE_BYTES
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").load(path)
    cut = files.select(
        F.split(name, r"\.")[0].alias("file_id"),
        F.expr(f"posexplode(transform(sequence(0, {slices - 1}), i -> substring(content, i * {width} + 1, {width})))")
        .alias("slice", "bytes"),
    ).filter(F.length("bytes") >= SAMPLE_BYTES)
    decoded = cut.select("file_id", "slice", F.posexplode(_decode("bytes")).alias("step", "value"))
    position = F.col("slice").cast("long") * slice_samples + F.col("step")
    return decoded.select(
        "file_id", position.alias("pos"), fixed_rate_second(position, SAMPLE_RATE).cast("int").alias("second"), "value"
    ).filter(F.col("pos") < samples)
