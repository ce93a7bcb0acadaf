"""Approximate nearest neighbours in several hashed orders of all rows.

A hash of a row has a bit for each of a few random directions: on which side of the median it lies. In every order
rows are sorted by their hash as a Gray code, so that rows next to each other differ in few and late bits, like the
leaves of a random projection tree walked from end to end. Each row is compared with the block of rows around
it. Blocks have a fixed number of rows, whatever the hash: there are no crowded buckets, nothing is capped
away, and every order exchanges each row once. The share of true neighbours found is measured on a sample of rows
against all others, and further orders are added until it is reached.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.operators.positions import uniform_hash
from quayside.operators.vectors import nearest_of, windows
from quayside.session import settle

FOUND = "id long, neighbour long, square double"
#: Rows of an order that a task compares.
ROWS_A_TASK = 50_000
#: Rows the medians are taken from.
MEDIAN_ROWS = 10_000


@dataclass(frozen=True)
class Hashing:
    """``orders`` are made at a time, until a share ``recall`` of ``queries`` sampled rows has its true neighbour, or ``most_orders`` are made.

    Each row meets at least ``block / 2`` others in an order.
    """

    orders: int = 8
    block: int = 512
    recall: float = 0.95
    queries: int = 256
    most_orders: int = 64
    seed: int = 17


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype("float64", copy=False)


def _drawn(points: DataFrame, rows: int, seed: int) -> pd.DataFrame:
    """So many rows at most, chosen by a hash of the id."""
    return points.select("id", "x").orderBy(uniform_hash("id", seed=seed), "id").limit(rows).toPandas()


def _order(points: DataFrame, rows: int, directions: np.ndarray, medians: np.ndarray, block: int) -> DataFrame:
    """What every row finds in the orders given by ``directions`` (order, bit, axis)."""
    orders, bits, _ = directions.shape
    places = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)

    @F.pandas_udf("array<long>")
    def codes(vectors: pd.Series) -> pd.Series:
        side = np.einsum("nd,obd->nob", _matrix(vectors), directions) > medians
        gray = np.bitwise_xor.accumulate(side.astype(np.int64), axis=2) @ places
        return pd.Series(list(gray))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            # the end of the rows before is looked at again together with what follows
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            for _, part in frame.groupby("order", sort=False):
                x, ids = _matrix(part["x"]), part["id"].to_numpy()
                ask = part["second"].isna().to_numpy()
                for window in windows(len(part), block):
                    asking = ask[window]
                    squares, names = nearest_of(x[window][asking], ids[window][asking], x[window], ids[window])
                    found = names >= 0
                    yield pd.DataFrame({"id": ids[window][asking][found], "neighbour": names[found], "square": squares[found]})
            held = frame.iloc[-(block // 2) :]

    named = points.withColumn("codes", codes("x")).select("id", "x", "second", F.posexplode("codes").alias("order", "code"))
    # rows at the ends of a partition have one side only, so partitions hold many blocks
    parts = max(orders, -(-rows * orders // max(ROWS_A_TASK, 8 * block)))
    ranged = named.repartitionByRange(parts, "order", "code", uniform_hash("id")).sortWithinPartitions("order", "code", uniform_hash("id"))
    return ranged.select("id", "x", "second", "order").mapInPandas(compare, FOUND)


def exact_of(queries: pd.DataFrame, points: DataFrame) -> pd.DataFrame:
    """id and square of the distance to the nearest other point, for a bounded number of queries, in one pass over the points."""
    sent = points.sparkSession.sparkContext.broadcast((_matrix(queries["x"]), queries["id"].to_numpy()))

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, ids = sent.value
        best = np.full(len(ids), np.inf)
        for frame in frames:
            if len(frame):
                best = np.minimum(best, nearest_of(x, ids, _matrix(frame["x"]), frame["id"].to_numpy())[0])
        yield pd.DataFrame({"id": ids, "square": best})

    return points.select("id", "x").mapInPandas(look, "id long, square double").groupBy("id").agg(F.min("square").alias("square")).toPandas()


def _best_of(found: DataFrame) -> DataFrame:
    return found.groupBy("id").agg(F.min(F.struct("square", "neighbour")).alias("b")).select("id", "b.neighbour", "b.square")


def recall_of(found: DataFrame, exact: pd.DataFrame) -> float:
    """Share of the exact rows whose neighbour found is as near; ``found``: id, square. 1 if there is nothing to find."""
    wanted = exact[np.isfinite(exact["square"])]
    if not len(wanted):
        return 1.0
    own = found.join(F.broadcast(found.sparkSession.createDataFrame(wanted[["id"]])), "id").select("id", "square").toPandas()  # as many rows as queries
    both = wanted.merge(own, "left", "id", suffixes=("", "_found"))
    return float((both["square_found"] <= both["square"] * (1 + 1e-9)).mean())


def hashed_search(points: DataFrame, rows: int, hashing: Hashing = Hashing()) -> DataFrame:
    """id, neighbour, distance of ``rows`` distinct vectors (id, x, second); those with a copy (second) are only looked at."""
    drawn = _matrix(_drawn(points, MEDIAN_ROWS, 5)["x"])
    bits = min(40, max(1, math.ceil(math.log2(max(2, rows) / max(1, hashing.block)))) + 4)
    asked = _drawn(points.filter("second IS NULL"), hashing.queries, 11)
    exact = exact_of(asked, points) if len(asked) else None
    random, made, found = np.random.default_rng(hashing.seed), 0, None
    while True:
        orders = min(hashing.orders, hashing.most_orders - made) if rows > hashing.block else 1
        directions = random.standard_normal((orders, bits, drawn.shape[1]))
        medians = np.median(np.einsum("nd,obd->nob", drawn, directions), axis=0)
        more = _order(points, rows, directions, medians, hashing.block)
        found = settle(_best_of(more if found is None else found.unionByName(more)))
        made += orders
        reached = 1.0 if exact is None else recall_of(found, exact)
        if reached >= hashing.recall or rows <= hashing.block:
            break
        if made >= hashing.most_orders:
            warnings.warn(f"{made} orders found {reached:.3f} of the nearest neighbours, less than {hashing.recall}", stacklevel=2)
            break
    return found.select("id", "neighbour", F.sqrt("square").alias("distance"))
