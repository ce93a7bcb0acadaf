"""Train/test and per-provider partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quayside.operators.ordered import DEFAULT_SKEW, Scan, Skew, lookup, ordered_scan
from quayside.operators.positions import passed, reached, rows_at, uniform_hash


def chronological_split(
    df: DataFrame,
    group: Sequence[str],
    time: str,
    ties: Sequence[str],
    test_fraction: float,
    keep_ties_together: bool = False,
    skew: Skew | None = DEFAULT_SKEW,
) -> DataFrame:
    """Add ``split``: ``train`` for the earlier rows of each group, ``test`` for the rest.

    The cut is at ``int(n / (1 + fraction))`` and moves to the end of a run of equal times.
    The last row of that run (by the tie columns) goes to test unless ties are kept together.
    Rows are never ranked: counts per time value locate the cut, then each row compares its
    own time with it.
    """
    group, ties = list(group), list(ties)
    runs = df.groupBy(*group, time).agg(
        F.count(F.lit(1)).alias("_rows"), F.max(F.struct(*ties)).alias("_last")
    )
    scanned = ordered_scan(runs, group, [time], {"_end": Scan("sum", F.col("_rows"))}, skew)
    if group:
        totals = scanned.groupBy(*group).agg(F.max("_end").alias("_total"))
        located = lookup(scanned, totals, group, "inner", skew or DEFAULT_SKEW)
    else:
        located = scanned.withColumn("_total", F.lit(df.count()))
    cut = F.floor(F.col("_total") / F.lit(1.0 + test_fraction))
    at_cut = located.filter((cut < F.col("_end")) & (cut >= F.col("_end") - F.col("_rows"))).select(
        *group, F.col(time).alias("_cut_time"), F.col("_last").alias("_cut_last")
    )
    if group:
        marked = lookup(df, at_cut, group, "left", skew or DEFAULT_SKEW)
    else:
        row = at_cut.first()
        if row is None:
            return df.withColumn("split", F.lit("train"))
        marked = df.withColumns(
            {"_cut_time": F.lit(row["_cut_time"]), "_cut_last": F.struct(*[F.lit(row["_cut_last"][t]).alias(t) for t in ties])}
        )
    in_run = F.col(time) == F.col("_cut_time")
    if not keep_ties_together:
        in_run = in_run & ~F.struct(*ties).eqNullSafe(F.col("_cut_last"))
    train = F.col("_cut_time").isNull() | (F.col(time) < F.col("_cut_time")) | in_run
    return marked.withColumn("split", F.when(train, "train").otherwise("test")).select(*df.columns, "split")


def _chunk_starts(total: int, chunks: int) -> list[int]:
    """0-based first positions of the second and later chunks when rows are cut into nearly equal chunks."""
    base, longer = divmod(total, chunks)
    return [c * base + min(c, longer) for c in range(1, chunks)]


def provider_partitions(
    df: DataFrame,
    label: str,
    key: Sequence[str],
    providers: int,
    uniform_fraction: float,
    seed: int = 42,
    first_hash: Column | None = None,
    second_hash: Column | None = None,
) -> DataFrame:
    """Add ``pool`` and ``provider`` (1..k): a label-skewed share plus an evenly shuffled share per provider.

    Per non-zero label the first ``int(m * (1 - fraction))`` shuffled rows form the skewed pool,
    kept in label order; the rest and all rows of label 0 form the shuffled pool. Each pool is
    cut into k contiguous chunks.

    Label counts give the positions at which pools and chunks begin. The rows at those few
    positions are looked up, and every row finds its place by comparing itself with them, so the
    data itself is neither sorted nor exchanged.
    """
    key = list(key)
    hashed = df.withColumns(
        {
            "_h1": first_hash if first_hash is not None else uniform_hash(*key, seed=seed),
            "_h2": second_hash if second_hash is not None else uniform_hash(*key, seed=seed + 1),
        }
    )
    # one entry per class
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label).collect()}
    kept = {y: int(n * (1 - uniform_fraction)) if y != 0 else 0 for y, n in counts.items()}
    rows, skewed_rows = sum(counts.values()), sum(kept.values())

    begins = {}
    offset = 0
    wanted = []
    for y, n in kept.items():
        begins[y] = (offset, offset + n)
        offset += n
        if 0 < n < counts[y]:
            wanted.append((y, n + 1, "pool"))
    for start in _chunk_starts(skewed_rows, providers):
        for y, (low, high) in begins.items():
            if low <= start < high:
                wanted.append((y, start - low + 1, "chunk"))
    asked = _collected(df, hashed, [label], "_h1", key, wanted, rows)

    order = [label, "_h1", *key]
    rest = F.lit(False)
    for y in counts:
        first_even = [r for r in asked if r["use"] == "pool" and r[label] == y]
        if first_even:
            rest = rest | ((F.col(label) == y) & reached(["_h1", *key], hashed, first_even[0]))
        elif kept[y] == 0:
            rest = rest | (F.col(label) == y)
    pooled = hashed.withColumn("pool", F.when(rest, "even").otherwise("skewed"))

    even = pooled.filter("pool = 'even'")
    starts = [(p + 1, "chunk") for p in _chunk_starts(rows - skewed_rows, providers) if p < rows - skewed_rows]
    even_cuts = _collected(df, even, [], "_h2", key, starts, rows)
    skewed_cuts = [r for r in asked if r["use"] == "chunk"]
    # chunks that begin beyond the last row stay empty and need no row to compare with
    provider = F.when(rest, passed(["_h2", *key], hashed, even_cuts)).otherwise(passed(order, hashed, skewed_cuts)) + 1
    return pooled.withColumn("provider", provider.cast("int")).select(*df.columns, "pool", "provider")


def _collected(
    df: DataFrame, rows_of: DataFrame, keys: list[str], hashed: str, key: list[str], wanted: list[tuple], rows: int
) -> list[Row]:
    """The few rows at wanted (keys, rank, use), each use of a row once."""
    if not wanted:
        return []
    uses: dict[tuple, list[str]] = {}
    for *place, use in wanted:
        uses.setdefault(tuple(place), []).append(use)
    entries = [
        F.struct(
            *[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, place)],
            F.lit(place[-1]).cast("long").alias("rank"),
            F.array(*map(F.lit, names)).alias("uses"),
        )
        for place, names in uses.items()
    ]
    ranks = df.sparkSession.range(0, 1, 1, 1).select(F.inline(F.array(*entries)))
    narrow = rows_of.select(*dict.fromkeys([*keys, hashed, *key]))
    found = rows_at(narrow, keys, hashed, key, ranks, rows, len(wanted))
    return found.select(*narrow.columns, F.explode("uses").alias("use")).collect()
