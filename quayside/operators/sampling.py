"""Sampling rows and assigning them to folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.operators.positions import passed, rows_at, uniform_hash


def sample_with_replacement(
    df: DataFrame,
    number: int,
    key: Sequence[str],
    seed: int = 42,
    row_hash: Column | None = None,
    draw_hash: Column | None = None,
    total: int | None = None,
) -> DataFrame:
    """Exactly ``number`` rows drawn with replacement, or all rows when there are no more than that.

    Every row has a position by its seeded hash. The draws are positions too, and a row comes out
    as often as it was drawn. ``draw_hash`` is an expression over the draw number ``id``, in
    [0, 2^32). ``total`` saves the count where it is known.
    """
    rows = df.count() if total is None else total
    if number >= rows:
        return df
    hashed = df.withColumn("_hash", row_hash if row_hash is not None else uniform_hash(*key, seed=seed))
    drawn = draw_hash if draw_hash is not None else uniform_hash("id", seed=seed + 1)
    draws = (
        df.sparkSession.range(number)
        .select((F.pmod(drawn, F.lit(rows)) + 1).alias("rank"))
        .groupBy("rank")
        .agg(F.count(F.lit(1)).cast("int").alias("_times"))
    )
    picked = rows_at(hashed, [], "_hash", key, draws, rows, number)
    copies = picked.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return copies.select(*df.columns)


def leading(df: DataFrame, position: str, count: int) -> DataFrame:
    """Rows at the first positions of each series; a filter, not a sort."""
    return df.filter(F.col(position) < count)


def shuffled(df: DataFrame, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Rows in a seeded random order."""
    return df.orderBy(uniform_hash(*key, seed=seed), *key)


def contiguous_folds(
    df: DataFrame,
    key: Sequence[str],
    folds: int = 5,
    seed: int = 42,
    row_hash: Column | None = None,
    total: int | None = None,
) -> DataFrame:
    """Add ``fold``: runs of ``n // folds`` rows along a seeded permutation, the last run takes the rest.

    Only the first row of each fold is looked up; every other row compares itself with those few.
    """
    rows = df.count() if total is None else total
    size = rows // folds
    if size == 0:
        raise ValueError(f"{rows} rows cannot be cut into {folds} folds")
    hashed = df.withColumn("_hash", row_hash if row_hash is not None else uniform_hash(*key, seed=seed))
    firsts = df.sparkSession.range(1, rows // size).select((F.col("id") * size + 1).alias("rank"))
    cuts = rows_at(hashed.select("_hash", *key), [], "_hash", key, firsts, rows, rows // size).collect()
    return hashed.withColumn("fold", passed(["_hash", *key], hashed, cuts)).select(*df.columns, "fold")
