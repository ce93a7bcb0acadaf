"""Pearson correlations of all feature pairs within each of many datasets.

A task accumulates the moments of all pairs of one dataset as packed matrices, a batch of rows at a time, and
finishes datasets that it holds whole. A dataset with many rows is dealt over several tasks by the hash of its
rows; their moments are sent packed, one row for each task, and merged.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.operators.runs import runs
from quayside.session import settle

#: Rows of a dataset that one task accumulates.
LANE_ROWS = 100_000


class Moments:
    """Of every pair of columns, over the rows where both are present: n, mean of the first, centred squares of the
    first, centred products. The same of the second stands at the transposed place."""

    def __init__(self, size: int, packed: bytes | None = None) -> None:
        shape = (4, size, size)
        self.parts = np.zeros(shape) if packed is None else np.frombuffer(packed, "<f8").reshape(shape).copy()

    @classmethod
    def of(cls, cells: np.ndarray) -> Moments:
        """Moments of rows with NaN where a cell is absent."""
        there = ~np.isnan(cells)
        counts = there.sum(axis=0)
        # any shift would do; the columns' means keep the sums small
        shift = np.where(there, cells, 0.0).sum(axis=0) / np.maximum(counts, 1)
        x, w = np.where(there, cells - shift, 0.0), there.astype("float64")
        n, sums = w.T @ w, x.T @ w
        safe = np.maximum(n, 1)
        made = cls(cells.shape[1])
        made.parts[:] = n, (shift[:, None] + sums / safe) * (n > 0), np.maximum((x * x).T @ w - sums * sums / safe, 0), x.T @ x - sums * sums.T / safe
        return made

    def add(self, other: Moments) -> None:
        (n, mean, square, product), (m, mean2, square2, product2) = self.parts, other.parts
        total = np.maximum(n + m, 1)
        step = mean2 - mean
        weight = n * m / total
        self.parts[:] = (
            n + m,
            np.where(n == 0, mean2, mean + step * m / total),
            square + square2 + step * step * weight,
            product + product2 + step * step.T * weight,
        )

    def packed(self) -> bytes:
        return self.parts.astype("<f8").tobytes()

    def correlations(self) -> np.ndarray:
        """r of the pairs (0, 1), (0, 2) and so on; NaN where a column is constant, but for rounding, or has no rows."""
        n, mean, square, product = self.parts
        varies = square > n * (1e-13 * mean) ** 2
        both = varies & varies.T & (n > 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where(both, product / (np.sqrt(square) * np.sqrt(square.T)), np.nan)
        return np.clip(r, -1, 1)[np.triu_indices(len(n), 1)]


def correlations_by(df: DataFrame, features: Sequence[str], by: Sequence[str], lane_rows: int = LANE_ROWS) -> DataFrame:
    """The columns of ``by``, rows, and r: an array of the correlations of the feature pairs (0, 1), (0, 2), .. (1, 2), ..

    A pair is taken over the rows where neither cell is null or NaN; r is null if one of both is constant there. Null is
    a name like any other. Infinite cells are an error; see ``filled``.
    """
    by, size = list(by), len(features)
    cells = F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in features])
    rows = df.select(*by, cells.alias("_x"))
    infinite = F.exists("_x", lambda v: F.coalesce(F.abs(v) == float("inf"), F.lit(False)))
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.count_if(infinite).alias("_bad"))
    stats = counts.agg(F.max("_n").alias("most"), F.sum("_bad").alias("bad")).first()
    if stats["bad"]:
        raise ValueError("infinite cells have no correlation; see filled")
    split = (stats["most"] or 0) > lane_rows
    if split:
        # at most one name for every ``lane_rows`` rows
        crowded = counts.filter(F.col("_n") > lane_rows).select(*[F.col(c).alias(f"_of_{i}") for i, c in enumerate(by)], F.ceil(F.col("_n") / lane_rows).alias("_lanes"))
        same = F.lit(True)
        for i, c in enumerate(by):
            same = same & F.col(c).eqNullSafe(F.col(f"_of_{i}"))
        dealt = rows.join(settle(crowded), same, "left").select(*by, "_x", F.coalesce("_lanes", F.lit(1)).alias("_lanes"))
    else:
        dealt = rows.withColumn("_lanes", F.lit(1).cast("long"))
    # dealt by place: equal rows would share a lane otherwise
    lane = F.when(F.col("_lanes") > 1, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_lanes"))).otherwise(0)
    dealt = dealt.withColumn("_lane", lane)
    names = [df.schema[c] for c in by]
    schema = T.StructType([*names, T.StructField("rows", T.LongType()), T.StructField("r", T.ArrayType(T.DoubleType())), T.StructField("packed", T.BinaryType())])

    def row(key: pd.DataFrame, count: int, moments: Moments, whole: bool) -> pd.DataFrame:
        r = [None if np.isnan(v) else v for v in moments.correlations().tolist()] if whole else None
        return key.assign(rows=count, r=[r], packed=[None if whole else moments.packed()])

    def accumulate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None
        for new, part in runs(frames, [*by, "_lane"]):
            if new and held:
                yield row(*held)
                held = None
            own = Moments.of(np.array([np.array(x, "float64") for x in part["_x"]]).reshape(len(part), size))
            if held is None:
                held = (part[by].iloc[:1].reset_index(drop=True), len(part), own, part["_lanes"].iloc[0] == 1)
            else:
                held[2].add(own)
                held = (held[0], held[1] + len(part), *held[2:])
        if held:
            yield row(*held)

    ordered = dealt.repartition(*by, "_lane").sortWithinPartitions(*by, "_lane")
    found = ordered.select(*by, "_x", "_lane", "_lanes").mapInPandas(accumulate, schema)
    if not split:
        return found.drop("packed")

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        total = Moments(size)
        for packed in frame["packed"]:
            total.add(Moments(size, packed))
        return row(frame[by].iloc[:1].reset_index(drop=True), int(frame["rows"].sum()), total, True)

    found = settle(found)
    merged = found.filter("packed IS NOT NULL").groupBy(*by).applyInPandas(merge, schema)
    return found.filter("packed IS NULL").unionByName(merged).drop("packed")
