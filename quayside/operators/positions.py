"""Positions in a seeded random order, found without ordering all rows.

Rows are ordered by a uniform hash, ties by the key. Counting rows per slice of the hash range
tells in which slice a wanted position lies; only rows of those slices are exchanged and ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quayside.operators.ordered import Scan, ordered_scan

HASH_SPAN = 1 << 32
ROWS_PER_SLICE = 500_000
MOST_SLICES = 1_000_000
#: Slices that are broadcast at most; a row is its key and a number.
MOST_SENT = 1_000_000


def uniform_hash(*columns: str, seed: int = 42) -> Column:
    """Seeded hash of the given columns in [0, 2^32)."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]), F.lit(HASH_SPAN))


def rows_at(
    df: DataFrame, keys: Sequence[str], hashed: str, ties: Sequence[str], wanted: DataFrame, rows: int, asked: int
) -> DataFrame:
    """The rows of ``df`` at the wanted positions, with the columns of ``wanted``.

    ``wanted`` has the keys and a 1-based ``rank`` within the key, each pair once; without keys the
    rank runs over all rows. ``rows`` and ``asked``, the sizes of ``df`` and ``wanted``, set the number
    of slices: slices are small, and most of them are not asked for.
    """
    keys, ties = list(keys), list(ties)
    fine = max(1024, rows // ROWS_PER_SLICE, 32 * asked)
    slices = max(1, min(MOST_SLICES, fine, rows // 8))
    where = [*keys, "_slice"]
    sliced = df.withColumn("_slice", F.floor(F.col(hashed) * F.lit(slices) / F.lit(HASH_SPAN)).cast("int"))
    # at most `slices` rows per key
    counts = sliced.groupBy(*where).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    starts = counts.select(
        *keys, (start + 1).alias("rank"), F.struct(F.col("_slice"), start.alias("_start")).alias("_in")
    ).withColumn("_asked", F.lit(0))
    questions = wanted.withColumns({"rank": F.col("rank").cast("long"), "_asked": F.lit(1)})
    located = (
        ordered_scan(
            starts.unionByName(questions, allowMissingColumns=True),
            keys,
            ["rank", "_asked"],
            {"_at": Scan("last", F.col("_in"))},
            None,
            # few enough slices and questions are one small window
            None if slices + asked <= MOST_SLICES else F.floor(F.col("rank") * 256 / F.lit(rows + 1)).cast("int"),
        )
        .filter("_asked = 1")
        .select(*wanted.columns, "_at._slice", (F.col("rank") - F.col("_at._start")).alias("_place"))
    )
    # no more than one row per wanted row
    needed = located.select(*where).distinct()
    if asked <= MOST_SENT:
        needed = F.broadcast(needed)
    inside = Window.partitionBy(*where).orderBy(hashed, *ties)
    numbered = sliced.join(needed, where, "left_semi").withColumn("_place", F.row_number().over(inside).cast("long"))
    return numbered.join(located, [*where, "_place"]).drop("_slice", "_place")


def reached(columns: Sequence[str], df: DataFrame, row: Row) -> Column:
    """Whether a row's columns, compared one after the other, are at or after those of a given row."""
    here = F.struct(*[F.col(c).alias(c) for c in columns])
    there = F.struct(*[F.lit(row[c]).cast(df.schema[c].dataType).alias(c) for c in columns])
    return here >= there


def passed(columns: Sequence[str], df: DataFrame, rows: Sequence[Row]) -> Column:
    """How many of the given rows a row is at or after."""
    return sum((reached(columns, df, row).cast("int") for row in rows), F.lit(0))
