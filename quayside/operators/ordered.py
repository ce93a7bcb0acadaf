"""Ordered computations per key that stay parallel when one key holds much of the data.

A window function sends every row of a key to one task. That is fine until a key
holds a large share of the rows. The functions here first look at the row count per
key. Only if some key is too large, the rows of such keys are cut along the order
column into pieces, each piece is summarised, the summaries are accumulated over the
(few) pieces of a key, and the rows then see "summary of the earlier pieces" plus
"window inside my own piece".

A key is hot by the number of rows a task may get. The keys are counted before they are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Skew:
    """A key with more than ``min_rows`` rows, what one task may get, is hot, whatever the size of the table.

    Hot keys are marked by a broadcast while there are at most ``1 / share`` of them, and by a plain join
    beyond. ``pieces``: into how many pieces at most hot rows are cut.
    """

    share: float = 1e-5
    min_rows: int = 2_000_000
    pieces: int = 16_384


DEFAULT_SKEW = Skew()


@dataclass(frozen=True)
class Scan:
    """One running value: ``kind`` is count, sum, max, min, first or last.

    ``first`` and ``last`` skip nulls. With ``inclusive=False`` the current row
    does not take part.
    """

    kind: str
    column: Column | None = None
    inclusive: bool = True


@dataclass(frozen=True)
class Hot:
    """The hot keys, whether they are few enough to be broadcast, and the number of all rows."""

    keys: DataFrame
    rows: int
    few: bool = True


def hot_keys(df: DataFrame, keys: Sequence[str], skew: Skew = DEFAULT_SKEW) -> Hot | None:
    """Keys above the limit, or None when there are none."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    is_hot = F.col("_rows") > skew.min_rows
    number, total = counts.agg(F.count_if(is_hot), F.sum("_rows")).first()
    if not number:
        return None
    return Hot(counts.filter(is_hot).select(*keys), total, number * skew.share <= 1)


def _mark_hot(df: DataFrame, keys: Sequence[str], hot: Hot) -> DataFrame:
    """Add the boolean ``_hot``."""
    marks = hot.keys.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.lit(True).alias("_hot"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys], F.lit(True))
    return (
        df.join(F.broadcast(marks) if hot.few else marks, same, "left")
        .drop(*[f"_h_{k}" for k in keys])
        .withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    )


def lookup(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """Join ``df`` with a table that is unique on ``keys``.

    Without hot keys this is a plain equi-join whose strategy Spark picks from sizes.
    Rows of hot keys are joined in place against the few matching table rows instead
    of being sent to one task each. If more than ``1 / share`` keys are hot, only those with more than that share of
    all rows are, of which there cannot be more; Spark splits what else is skewed in the equi-join.
    """
    hot = hot_keys(df, keys, skew)
    if hot is not None and not hot.few:
        hot = hot_keys(df, keys, replace(skew, min_rows=max(skew.min_rows, int(hot.rows * skew.share))))
    if hot is None:
        return df.join(table, list(keys), how)
    marked = _mark_hot(df, keys, hot)
    few = table.join(F.broadcast(hot.keys), list(keys), "left_semi")
    cold_rows = marked.filter(~F.col("_hot")).drop("_hot").join(table, list(keys), how)
    hot_rows = marked.filter("_hot").drop("_hot").join(F.broadcast(few), list(keys), how)
    return cold_rows.unionByName(hot_rows)


def _as_number(df: DataFrame, name: str) -> Column | None:
    """A number that orders like the column, for numbers and times."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("double")
    return F.col(name).cast("double") if isinstance(kind, T.NumericType) else None


def _quantiles(df: DataFrame, axis: str, pieces: int) -> list[float]:
    steps = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    return df.agg(F.percentile_approx(axis, steps, F.lit(10 * pieces))).first()[0] or []


def _slotted(df: DataFrame, axis: str, bounds: Sequence[float], slot: str) -> DataFrame:
    splits = [float("-inf"), *sorted(set(bounds)), float("inf")]
    return Bucketizer(splits=splits, inputCol=axis, outputCol=slot, handleInvalid="keep").transform(df)


def _cut_by_quantile(df: DataFrame, keys: Sequence[str], order: Sequence[str], skew: Skew, hot: Hot) -> DataFrame | None:
    """Give hot rows a piece number that grows along the order; other rows get 0.

    There are as many pieces as keep one near ``min_rows`` rows. A value of the first order column
    that fills more than a piece by itself gets its own, which the second column cuts further.
    None when the first order column is neither a number nor a time.
    """
    first = _as_number(df, order[0])
    second = _as_number(df, order[1]) if len(order) > 1 else None
    if first is None:
        return None
    pieces = max(2, min(skew.pieces, hot.rows // skew.min_rows))
    marked = _mark_hot(df, keys, hot).withColumn("_axis", first)
    bounds = _quantiles(marked.filter("_hot"), "_axis", pieces)
    heavy = sorted({a for a, b in zip(bounds, bounds[1:]) if a == b}) if second is not None else []
    cut = _slotted(marked, "_axis", [*bounds, *(math.nextafter(v, math.inf) for v in heavy)], "_slot")
    piece = F.col("_slot").cast("long") + 1
    if heavy:
        alone = F.coalesce(F.col("_axis").isin(heavy), F.lit(False))
        cut = cut.withColumn("_axis2", F.when(alone, second))
        cut = _slotted(cut, "_axis2", _quantiles(cut.filter("_hot"), "_axis2", pieces), "_slot2")
        # nulls of the second column come first as well
        piece = piece * (2 * pieces) + F.when(F.col("_axis2").isNotNull(), F.col("_slot2").cast("long") + 1).otherwise(0)
    # nulls sort first, so they stay in piece 0
    piece = F.when(F.col("_hot") & F.col("_axis").isNotNull(), piece).otherwise(0)
    return cut.withColumn("_piece", piece).drop("_axis", "_slot", "_axis2", "_slot2")


def _running(scan: Scan, keys: Sequence[str], order: Sequence[str]) -> Column:
    spec = Window.partitionBy(*keys).orderBy(*order)
    frame = spec.rowsBetween(Window.unboundedPreceding, 0 if scan.inclusive else -1)
    column = F.lit(1) if scan.column is None else scan.column
    if scan.kind == "count":
        return F.count(column).over(frame)
    if scan.kind in ("first", "last"):
        return getattr(F, scan.kind)(column, ignorenulls=True).over(frame)
    return getattr(F, scan.kind)(column).over(frame)


def _summary(scan: Scan, order: Sequence[str]) -> Column:
    column = F.lit(1) if scan.column is None else scan.column
    if scan.kind in ("first", "last"):
        position = F.when(column.isNotNull(), F.struct(*order))
        pick = F.min_by if scan.kind == "first" else F.max_by
        return pick(column, position)
    return getattr(F, scan.kind)(column)


def _merge(scan: Scan, before: Column, inside: Column) -> Column:
    if scan.kind == "count":
        return F.coalesce(before, F.lit(0)) + inside
    if scan.kind == "sum":
        return F.coalesce(before + inside, before, inside)
    if scan.kind == "max":
        return F.greatest(before, inside)
    if scan.kind == "min":
        return F.least(before, inside)
    return F.coalesce(before, inside) if scan.kind == "first" else F.coalesce(inside, before)


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    scans: Mapping[str, Scan],
    skew: Skew | None = DEFAULT_SKEW,
    piece: Column | None = None,
) -> DataFrame:
    """Add running values per key in the given (total) order.

    ``skew=None`` states that groups are small by construction and skips the check.
    ``piece`` is an integer expression that never falls along the order; with it the
    rows are always cut that way, which also allows an empty key list.
    """
    keys, order = list(keys), list(order)
    if piece is None:
        hot = hot_keys(df, keys, skew) if skew is not None else None
        cut = None if hot is None else _cut_by_quantile(df, keys, order, skew, hot)
        if cut is None:
            return df.select("*", *[_running(s, keys, order).alias(n) for n, s in scans.items()])
        to_sum = cut.filter("_hot")
        cut = cut.drop("_hot")
    else:
        cut = to_sum = df.withColumn("_piece", piece)

    parts = to_sum.groupBy(*keys, "_piece").agg(*[_summary(s, order).alias(f"_s_{n}") for n, s in scans.items()])
    earlier = {n: replace(s, column=F.col(f"_s_{n}"), inclusive=False) for n, s in scans.items()}
    # a count of rows accumulates as a sum of piece counts
    earlier = {n: replace(s, kind="sum") if s.kind == "count" else s for n, s in earlier.items()}
    carry = parts.select(
        *[F.col(k).alias(f"_c_{k}") for k in keys],
        F.col("_piece").alias("_c_piece"),
        *[_running(s, keys, ["_piece"]).alias(f"_b_{n}") for n, s in earlier.items()],
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col("_piece") == F.col("_c_piece"), *[F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys]],
    )
    joined = cut.join(carry, same, "left")
    inside = {n: _running(s, [*keys, "_piece"], order) for n, s in scans.items()}
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[_merge(s, F.col(f"_b_{n}"), inside[n]).alias(n) for n, s in scans.items()],
    )


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "rank",
    skew: Skew | None = DEFAULT_SKEW,
) -> DataFrame:
    """1-based position per key."""
    return ordered_scan(df, keys, order, {name: Scan("count")}, skew)
