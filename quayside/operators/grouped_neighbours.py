"""Nearest neighbours within each of many datasets.

A dataset of up to ``most`` rows is searched in one task, which builds a ball tree of it; a task takes many small
datasets one after the other. Larger ones, of which there can only be few, are searched together by the
distributed form, in which a further coordinate keeps them apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.operators.neighbours import nearest_neighbours, usable_vector
from quayside.operators.runs import whole_runs
from quayside.operators.vectors import all_nearest
from quayside.session import settle

#: Rows of a dataset that one task searches.
MOST_ROWS = 20_000


def _in_tasks(rows: DataFrame) -> DataFrame:
    schema = T.StructType(
        [rows.schema["by"], T.StructField("id", T.LongType()), T.StructField("neighbour", T.LongType()), T.StructField("distance", T.DoubleType())]
    )

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in whole_runs(frames, ["by"]):
            # elements that are too large to be squared are made smaller by a power of two
            x, ids = np.stack(own["x"].to_numpy()).astype("float64"), own["id"].to_numpy()
            top = np.abs(x).max(initial=0.0)
            scale = 2.0 ** -math.frexp(top)[1] if top > 1e140 else 1.0
            squares, names = all_nearest(x * scale, ids)
            found = names >= 0
            yield pd.DataFrame({"by": own["by"][found], "id": ids[found], "neighbour": names[found], "distance": np.sqrt(squares[found]) / scale})

    ordered = rows.repartition("by").sortWithinPartitions("by", "id")
    return ordered.select("by", "id", "x").mapInPandas(search, schema)


def _together(rows: DataFrame, names: DataFrame) -> DataFrame:
    """All of the datasets in ``names`` (of, n) at once: datasets are farther apart than any two vectors are."""
    top, width = rows.agg(F.max(F.array_max(F.transform("x", lambda v: F.abs(v)))), F.max(F.size("x"))).first()
    step = 4 * (top or 0.0) * math.sqrt(width or 1) + 1
    apart = rows.join(names, F.col("by").eqNullSafe(F.col("of"))).select("by", "id", F.concat("x", F.array(F.col("n") * F.lit(step))).alias("x"))
    # numbered in the order of the ids, so that ties go to the lowest id
    ordered = apart.repartitionByRange("by", "id").sortWithinPartitions("by", "id").withColumn("row", F.monotonically_increasing_id())
    ordered = settle(ordered)
    near = nearest_neighbours(ordered, "row", "x").select(F.col("id").alias("row"), F.col("neighbour").alias("other"), "distance")
    named = near.join(ordered.select("row", "by", "id"), "row")
    return named.join(ordered.select(F.col("row").alias("other"), F.col("id").alias("neighbour")), "other").select("by", "id", "neighbour", "distance")


def nearest_neighbours_by(df: DataFrame, by: str, ident: str, vector: str, most: int = MOST_ROWS) -> DataFrame:
    """by, id, neighbour, distance: the nearest other row of the same dataset, exact, ties to the lowest id.

    Ids are unique within a dataset. A null name is a dataset of its own, and a dataset of one row has no neighbours. A
    vector with a null, NaN or infinite element is an error.
    """
    rows = df.select(F.col(by).alias("by"), F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    bad = rows.agg(F.count_if(~F.coalesce(usable_vector("x"), F.lit(False)))).first()[0]
    if bad:
        raise ValueError(f"{bad} vectors have null, NaN or infinite elements")
    sizes = rows.groupBy("by").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > most)
    # at most one name for every ``most`` rows
    names = [r["by"] for r in sizes.select("by").sort("by").collect()]
    if not names:
        return _in_tasks(rows)
    schema = T.StructType([T.StructField("of", rows.schema["by"].dataType), T.StructField("n", T.DoubleType())])
    large = df.sparkSession.createDataFrame([(name, float(i)) for i, name in enumerate(names)], schema)
    is_large = F.col("by").eqNullSafe(F.col("of"))
    return _in_tasks(rows.join(large, is_large, "left_anti")).unionByName(_together(rows.join(large, is_large, "left_semi"), large))
