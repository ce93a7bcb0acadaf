"""Nearest neighbour of every row, exact or in hashed orders, and the mutual pairs built on it.

For the exact form the search space is divided around pivot rows. A row first looks for a neighbour in its own
block, which bounds the distance; two blocks then meet only if the triangle inequality cannot rule out that a row of
one has its neighbour in the other. Blocks hold a limited number of rows and a task holds two at a time, so no task
grows with the data. The pivots influence the speed only, never the result.
Equal rows are folded into one before the search, so a mass of copies costs nothing. With many dimensions nothing can
be ruled out and the exact form compares all pairs, each once for both of its rows; its time then grows with the
square of the rows, and for millions of them ``method="hashed"`` is meant.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.operators.hashed_neighbours import Hashing, hashed_search
from quayside.operators.ordered import DEFAULT_SKEW, Skew, lookup
from quayside.operators.positions import uniform_hash
from quayside.operators.vectors import nearest_between, nearest_of
from quayside.session import settle

PIVOT_BYTES = 32 << 20
RINGS = 64
VISITS_AT_ONCE = 2_000_000
#: Rows of a block: a share of all, so that many tasks have work, within these limits.
BLOCKS, LEAST_BLOCK, MOST_BLOCK = 24, 2048, 16384
# a table of that many small rows may be broadcast
FEW_PAIRS = 1_000_000
#: Tasks among which the pairs of blocks are dealt at most.
MOST_TASKS = 4000
#: Pairs of blocks that a task meets one after the other, once there are that many tasks: a task has a fixed price.
PAIRS_A_TASK, LEAST_TASKS = 4, 96


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype("float64", copy=False)


def _meeting_tasks(pairs: int) -> int:
    return max(1, min(pairs, MOST_TASKS, max(LEAST_TASKS, pairs // PAIRS_A_TASK)))


def _packed(vectors: pd.Series, kind: str) -> pd.Series:
    """Each vector as bytes: a row that is sent to many blocks is one value then, not one for each element."""
    return pd.Series([row.tobytes() for row in _matrix(vectors).astype(kind)], dtype=object)


def _unpacked(vectors: pd.Series, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), width).astype("float64")


def _pivot_distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    total = np.zeros((len(points), len(pivots)))
    for axis in range(points.shape[1]):
        step = points[:, axis, None] - pivots[None, :, axis]
        total += step * step
    return np.sqrt(total)


def _best(visitor_ids, visitors, member_ids, members):
    """Nearest member per visitor other than itself; ties go to the lowest id."""
    squares, names = nearest_of(visitors, visitor_ids, members, member_ids)
    found = names >= 0
    return pd.DataFrame({"id": visitor_ids[found], "neighbour": names[found], "square": squares[found]})


FOUND = "id long, neighbour long, square double"


def _folded(df: DataFrame) -> DataFrame:
    """One row per distinct vector with its lowest and second lowest id.

    The rank limit is applied before the exchange too, so at most two rows per vector and task move.
    """
    lowest = Window.partitionBy("x").orderBy("id")
    two = df.withColumn("_place", F.row_number().over(lowest)).filter("_place <= 2")
    return two.groupBy("x").agg(
        F.min("id").alias("id"), F.when(F.count(F.lit(1)) == 2, F.max("id")).alias("second")
    )


def _search(points: DataFrame, rows: int, block: int | None) -> DataFrame:
    """Nearest other point per point; ``points`` holds distinct vectors (id, x, second)."""
    block = block or min(MOST_BLOCK, max(LEAST_BLOCK, rows // BLOCKS))
    width = len(points.select("x").first()["x"])
    # two blocks a pivot: each block is sent to all others that it may reach
    wanted = max(1, min(1024, rows // (2 * block), PIVOT_BYTES // (8 * width)))
    pivots = np.array(
        [r["x"] for r in points.orderBy(uniform_hash("id"), "id").limit(wanted).select("x").collect()], "float64"
    )

    @F.pandas_udf("cell int, radius double")
    def locate(vectors: pd.Series) -> pd.DataFrame:
        distances = _pivot_distances(_matrix(vectors), pivots)
        cell = distances.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "radius": distances[np.arange(len(cell)), cell]})

    placed = settle(points.withColumn("_at", locate("x")).select("id", "x", "second", "_at.*"))

    # large cells are cut into rings of equal size around their pivot
    steps = [i / RINGS for i in range(1, RINGS)]
    crowded = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("radius", F.array(*map(F.lit, steps))).alias("cuts")
    )
    cuts = {r["cell"]: r["cuts"][:: max(1, RINGS // -(-r["n"] // block))] if r["n"] > block else [] for r in crowded.collect()}

    @F.pandas_udf("int")
    def ring_of(cell: pd.Series, radius: pd.Series) -> pd.Series:
        rings = np.zeros(len(cell), "int32")
        for one in cell.unique():
            inside = (cell == one).to_numpy()
            rings[inside] = np.searchsorted(np.asarray(cuts[one], "float64"), radius[inside].to_numpy(), "right")
        return pd.Series(rings)

    ringed = placed.withColumn("ring", ring_of("cell", "radius"))
    # at most pivots x rings rows: the bound on what the driver and the tasks hold
    sizes = ringed.groupBy("cell", "ring").agg(
        F.count(F.lit(1)).alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high")
    )
    areas = sizes.toPandas().sort_values(["cell", "ring"], ignore_index=True)
    number = {(c, r): i for i, (c, r) in enumerate(zip(areas["cell"], areas["ring"]))}
    cells, low, high = (areas[c].to_numpy() for c in ("cell", "low", "high"))
    shards = (-(-areas["n"] // block)).to_numpy()
    first = np.cumsum(shards) - shards
    slots = int(shards.sum())

    @F.pandas_udf("int")
    def slot_of(cell: pd.Series, ring: pd.Series, hashed: pd.Series) -> pd.Series:
        area = np.array([number[key] for key in zip(cell, ring)], "int64")
        return pd.Series((first[area] + hashed.to_numpy() % shards[area]).astype("int32"))

    members = settle(
        ringed.select("id", "x", "second", slot_of("cell", "ring", uniform_hash("id", seed=7)).alias("slot"))
    )

    def inside(frame: pd.DataFrame) -> pd.DataFrame:
        ids, vectors = frame["id"].to_numpy(), _matrix(frame["x"])
        ask = frame["second"].isna().to_numpy()
        return _best(ids[ask], vectors[ask], ids, vectors)

    # a point with a copy knows its neighbour already and is only looked at, never asks
    own = settle(members.repartition(max(1, min(MOST_TASKS, slots)), "slot").groupBy("slot").applyInPandas(inside, FOUND))
    known = settle(members.join(own.select("id", "square"), "id", "left"))
    # of the areas, by slot: what is needed to rule out rows of another slot
    area_of = np.repeat(np.arange(len(areas)), shards)

    def reachable(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(one, other) of slots where a row of one may have something at least as near in the other; one is the lower."""
        portion, met = max(1, VISITS_AT_ONCE // slots), {}
        for frame in frames:
            frame = frame[frame["second"].isna().to_numpy()]
            for start in range(0, len(frame), portion):
                part = frame.iloc[start : start + portion]
                distances = _pivot_distances(_matrix(part["x"]), pivots)[:, cells]
                least = np.maximum(0.0, np.maximum(low[None, :] - distances, distances - high[None, :]))
                limit = np.sqrt(part["square"].fillna(np.inf).to_numpy())
                may = least <= limit[:, None] * (1 + 1e-9) + 1e-12
                for slot, at in part.groupby("slot").indices.items():
                    met[slot] = met.get(slot, False) | may[at].any(axis=0)[area_of]
        for slot, other in met.items():
            other = np.flatnonzero(other)
            other = other[other != slot].astype("int32")
            yield pd.DataFrame({"one": np.minimum(other, slot).astype("int32"), "other": np.maximum(other, slot).astype("int32")})

    pairs = settle(known.select("x", "second", "square", "slot").mapInPandas(reachable, "one int, other int").distinct())
    many = pairs.count()
    both = pairs.select("one", "other", F.explode(F.array("one", "other")).alias("slot"))
    both = F.broadcast(both) if many <= FEW_PAIRS else both
    # elements that came as single floats are sent as such
    single = points.agg(F.bool_and(F.forall("x", lambda v: v == v.cast("float").cast("double")))).first()[0]
    kind = "<f4" if single else "<f8"

    @F.pandas_udf("binary")
    def packed(vectors: pd.Series) -> pd.Series:
        return _packed(vectors, kind)

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for slot in (frame["one"].iat[0], frame["other"].iat[0]):
            own = frame[(frame["slot"] == slot).to_numpy()]
            squares = own["square"].fillna(np.inf).to_numpy()
            sides.append((slot, own["id"].to_numpy(), _unpacked(own["x"], kind, width), own["second"].isna().to_numpy(), squares))
        asks = []
        for (_, _, x, ask, squares), (slot, *_) in (sides, sides[::-1]):
            area = area_of[slot]
            distance = _pivot_distances(x, pivots[cells[area]][None, :])[:, 0]
            least = np.maximum(0.0, np.maximum(low[area] - distance, distance - high[area]))
            asks.append(ask & (least <= np.sqrt(squares) * (1 + 1e-9) + 1e-12))
        (_, ids, x, _, squares), (_, other_ids, other, _, other_squares) = sides
        found = nearest_between(x, ids, asks[0], squares, other, other_ids, asks[1], other_squares)
        return pd.DataFrame(dict(zip(("id", "neighbour", "square"), found, strict=True)))

    meeting = known.select("id", packed("x").alias("x"), "second", "square", "slot").join(both, "slot")
    spread = meeting.repartition(_meeting_tasks(many), "one", "other")
    elsewhere = spread.groupBy("one", "other").applyInPandas(meet, FOUND)
    nearest = own.unionByName(elsewhere).groupBy("id").agg(F.min(F.struct("square", "neighbour")).alias("_best"))
    return nearest.select("id", "_best.neighbour", F.sqrt("_best.square").alias("distance"))


def usable_vector(vector: str) -> Column:
    """Whether all elements are numbers; null for a null vector."""
    return F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def nearest_neighbours(
    df: DataFrame,
    ident: str,
    vector: str,
    block: int | None = None,
    skew: Skew = DEFAULT_SKEW,
    method: str = "exact",
    hashing: Hashing = Hashing(),
) -> DataFrame:
    """(id, neighbour, distance) for every row: Euclidean, ties to the lowest id.

    ``method="hashed"`` finds the nearest neighbour of a share of the rows, measured against ``hashing.recall``, and a near
    one of the others; copies are always found. It exchanges each row once an order, the exact form up to all pairs.

    A vector with a null, NaN or infinite element has no distances and is an error. Very large elements
    are scaled by a power of two first, so that no square overflows; a single row has no neighbour.
    """
    if method not in ("exact", "hashed"):
        raise ValueError(f"there is no method {method}")
    rows = df.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    usable = usable_vector("x")
    largest = F.array_max(F.transform("x", lambda v: F.abs(v)))
    checked = rows.agg(F.count_if(~F.coalesce(usable, F.lit(False))).alias("bad"), F.max(F.when(usable, largest)).alias("top")).first()
    if checked["bad"]:
        raise ValueError(f"{checked['bad']} vectors have null, NaN or infinite elements")
    if (checked["top"] or 0.0) > 1e140:
        scale = 2.0 ** -(math.frexp(checked["top"])[1])
        found = nearest_neighbours(
            rows.select("id", F.transform("x", lambda v: v * F.lit(scale)).alias("x")), "id", "x", block, skew, method, hashing
        )
        return found.withColumn("distance", F.col("distance") / F.lit(scale))
    points = settle(_folded(rows))
    count = points.count()
    if count == 0:
        return rows.select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("distance"))
    pairs = points.filter(F.col("second").isNotNull())
    copies = lookup(rows, pairs.withColumnRenamed("id", "lowest"), ["x"], "inner", skew).select(
        "id",
        F.when(F.col("id") == F.col("lowest"), F.col("second")).otherwise(F.col("lowest")).alias("neighbour"),
        F.lit(0.0).alias("distance"),
    )
    if count == 1:
        return copies
    searched = hashed_search(points, count, hashing) if method == "hashed" else _search(points, count, block)
    return copies.unionByName(searched)


def mutual_pairs(neighbours: DataFrame) -> DataFrame:
    """Pairs (low, high) that are each other's nearest neighbour.

    Both directions of a pair meet under the same key, so a key has at most two rows and a point
    that is the neighbour of very many others is no hot key.
    """
    keyed = neighbours.select(
        F.least("id", "neighbour").alias("low"), F.greatest("id", "neighbour").alias("high"), "distance"
    )
    both = keyed.groupBy("low", "high").agg(F.count(F.lit(1)).alias("_sides"), F.max("distance").alias("distance"))
    return both.filter("_sides = 2").drop("_sides")


def tomek_links(
    df: DataFrame, ident: str, vector: str, label: str, neighbours: DataFrame | None = None, method: str = "exact"
) -> DataFrame:
    """Mutual nearest neighbours with different labels: low, high, low_label, high_label."""
    near = nearest_neighbours(df, ident, vector, method=method) if neighbours is None else neighbours
    # long form: one row per member, so that each label is looked up by a unique id
    members = mutual_pairs(near).select("low", "high", F.explode(F.array("low", "high")).alias("id"))
    labels = df.select(F.col(ident).cast("long").alias("id"), F.col(label).alias("_label"))
    return (
        members.join(labels, "id")
        .groupBy("low", "high")
        .agg(
            F.max(F.when(F.col("id") == F.col("low"), F.col("_label"))).alias("low_label"),
            F.max(F.when(F.col("id") == F.col("high"), F.col("_label"))).alias("high_label"),
        )
        .filter("low_label <> high_label")
    )


def link_members(links: DataFrame) -> DataFrame:
    """One row per member of a link: id, label."""
    low = F.struct(F.col("low").alias("id"), F.col("low_label").alias("label"))
    high = F.struct(F.col("high").alias("id"), F.col("high_label").alias("label"))
    return links.select(F.explode(F.array(low, high)).alias("m")).select("m.*")
