"""Overlapping count-based windows over sensor series, and the wide feature table built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.text import FLOWS, HYDROPHONES, LABELS, TOPOLOGIES, condition_flags, label_code, topology_code
from quayside.operators.ordered import DEFAULT_SKEW, Skew, lookup


def truncate_recording(df: DataFrame, seconds: str = "second", last: int = 29) -> DataFrame:
    """Keep the readings of the first ``last + 1`` whole seconds."""
    return df.filter(F.col(seconds).cast("int") <= last)


def series_widths(df: DataFrame, series: Sequence[str], second: str, seconds: int) -> DataFrame:
    """Window width per series: readings in second 0, times the wanted seconds."""
    return df.groupBy(*series).agg((F.count_if(F.col(second) == 0) * seconds).alias("width"))


def with_windows(df: DataFrame, position: str, width: int | str, overlap: int | str) -> DataFrame:
    """One row per (reading, window it falls in): adds ``window_id`` and the place in the window ``offset``.

    A reading at position p lies in the windows from ceil((p - width + 1) / step) to p div step, so windows
    need no sort and no look at neighbouring rows.
    """

    def number(value: int | str) -> Column:
        return (F.col(value) if isinstance(value, str) else F.lit(value)).cast("long")

    spread = df.withColumns(
        {"_p": F.col(position).cast("long"), "_w": number(width), "_s": number(width) - number(overlap)}
    ).filter((F.col("_w") > 0) & (F.col("_s") > 0))
    ids = F.expr("sequence(greatest(0L, (_p - _w + _s) div _s), _p div _s)")
    return (
        spread.withColumn("window_id", F.explode(ids))
        .withColumn("offset", F.col("_p") - F.col("window_id") * F.col("_s"))
        .withColumn("window_width", F.col("_w"))
        .drop("_p", "_w", "_s")
    )


def bucket_of(offset: str, width: str, buckets: int) -> Column:
    """Bucket of a place in a window cut into nearly equal buckets, the longer ones first."""
    base, longer = f"({width} div {buckets})", f"({width} % {buckets})"
    edge = f"({longer} * ({base} + 1))"
    return F.expr(
        f"CASE WHEN {offset} < {edge} THEN {offset} div ({base} + 1)"
        f" ELSE {longer} + ({offset} - {edge}) div greatest({base}, 1) END"
    )


def window_features(
    df: DataFrame,
    series: Sequence[str],
    position: str,
    value: str,
    width: int | str,
    overlap: int | str,
    buckets: int,
    second: str,
) -> DataFrame:
    """Bucket means ``b0..``, ``mean``, sample ``std`` and first second ``time`` of every complete window.

    A window is complete when it holds ``width`` readings, so the series length is not needed
    and a series shorter than one window yields nothing (see ``short_series``). All values come
    from one grouping with map-side partial aggregates; no pivot.
    """
    placed = with_windows(df, position, width, overlap).withColumn(
        "_bucket", bucket_of("offset", "window_width", buckets)
    )
    means = [F.avg(F.when(F.col("_bucket") == b, F.col(value))).alias(f"b{b}") for b in range(buckets)]
    grouped = placed.groupBy(*series, "window_id").agg(
        *means,
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min_by(second, position).alias("time"),
        F.count(F.lit(1)).alias("_readings"),
        F.first("window_width").alias("_width"),
    )
    return grouped.filter(F.col("_readings") == F.col("_width")).drop("_readings", "_width")


def short_series(df: DataFrame, series: Sequence[str], width: int | str) -> DataFrame:
    """Series with fewer readings than one window, or without a reading in second 0, so that they have no width."""
    size = F.max(width) if isinstance(width, str) else F.lit(width)
    counted = df.groupBy(*series).agg(F.count(F.lit(1)).alias("readings"), size.alias("width"))
    return counted.filter((F.col("readings") < F.col("width")) | (F.col("width") <= 0))


def features_with_series_width(
    df: DataFrame,
    series: Sequence[str],
    position: str,
    value: str,
    second: str,
    seconds: int,
    overlap_rate: float,
    buckets: int,
    strict: bool = False,
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """Window features where each series' own sampling rate sets the width."""
    widths = series_widths(df, series, second, seconds).withColumn(
        "overlap", F.floor(F.col("width") * F.lit(float(overlap_rate)))
    )
    sized = lookup(df, widths, series, "inner", skew)
    if strict and not short_series(sized, series, "width").isEmpty():
        raise ValueError("some series are shorter than one window")
    return window_features(sized, series, position, value, "width", "overlap", buckets, second)


# fixed values: which recordings each background condition takes.
# (condition, flow, noise marker a hydrophone must carry, contact sensors taken)
EXECUTED_RULES = [
    ("BC1", "0-18 LPS", None, True),
    ("BC2", "0-47 LPS", None, True),
    ("BC3", "ND", "NN", True),
    ("BC4", "ND", "N", False),
    ("BC5", "Transient", "N", True),
    ("BC6", "Transient", "NN", False),
]
STATED_RULES = [(c, f, "N" if c in ("BC1", "BC2") else n, s) for c, f, n, s in EXECUTED_RULES]
NOISE_CONDITIONS = ["BC1", "BC2", "BC4", "BC5"]


def conditions_of(parts: dict[str, Column], rules: Sequence[tuple] = tuple(EXECUTED_RULES)) -> Column:
    """Array of the conditions a recording belongs to; background noise belongs to several."""
    hydrophone = parts["sensor"].isin(HYDROPHONES)
    noise_file = parts["is_noise"] & hydrophone
    routes = []
    for condition, flow, marker, contact in rules:
        heard = hydrophone if marker is None else hydrophone & (parts["noise"] == marker)
        taken = heard | (F.lit(contact) & ~hydrophone)
        match = (~parts["is_noise"]) & (parts["flow"] == flow) & taken
        if condition in NOISE_CONDITIONS:
            match = match | noise_file
        routes.append(F.when(match, condition))
    return F.array_compact(F.array(*routes))


def candidate_predicate(parts: dict[str, Column], topology: str | None, label: str | None) -> Column:
    """Recordings of the wanted topology and label (None = any), and always the background noise."""
    wanted = F.lit(True)
    if topology is not None:
        wanted = wanted & (parts["topology"] == topology)
    if label is not None:
        wanted = wanted & (parts["label"] == label)
    return parts["is_noise"] | (~parts["is_noise"] & wanted)


def non_empty_groups(df: DataFrame, keys: Sequence[str] = ("topology", "label", "flow")) -> DataFrame:
    """The (topology, label, flow) patterns that have recordings, with their number."""
    known = (
        F.col(keys[0]).isin(TOPOLOGIES) & F.col(keys[1]).isin(list(LABELS)) & F.col(keys[2]).isin(FLOWS)
    )
    return df.filter(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("recordings"))


def beside(
    features: DataFrame,
    group: Sequence[str],
    sensors: Sequence[str],
    columns: Sequence[str],
    sensor: str = "sensor",
    window: str = "window_id",
    time: str = "time",
    recording: str = "file_name",
) -> DataFrame:
    """Sensor blocks side by side per (group, window): ``<sensor>_<column>``, one shared time.

    Where a group has several recordings of a sensor, the one first by name gives the whole block. The
    explicit sensor list makes the output schema stable and the reshape one grouping.
    """
    first = features.groupBy(*group, sensor).agg(F.min(recording).alias("_first"))
    features = features.join(first, [*group, sensor]).filter(F.col(recording) == F.col("_first"))
    blocks = [
        F.max(F.when(F.col(sensor) == s, F.col(c))).alias(f"{s}_{c.removeprefix('b')}" if c[1:].isdigit() else f"{s}_{c}")
        for s in sensors
        for c in columns
    ]
    first_time = F.coalesce(*[F.max(F.when(F.col(sensor) == s, F.col(time))) for s in sensors])
    return features.groupBy(*group, window).agg(first_time.alias(time), *blocks)


def with_noise(
    features: DataFrame,
    noise: DataFrame,
    columns: Sequence[str],
    sensor: str = "sensor",
    window: str = "window_id",
    marker: str = "noise",
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """Attach the background noise features ``N_*`` of the same hydrophone to recordings marked ``N``."""
    table = noise.select(sensor, window, *[F.col(c).alias(f"N_{c}") for c in columns])
    marked = F.col(marker).eqNullSafe("N")
    joined = lookup(features, table, [sensor, window], "left", skew)
    return joined.select(
        *features.columns, *[F.when(marked, F.col(f"N_{c}")).alias(f"N_{c}") for c in columns]
    )


def labelled(df: DataFrame, topology: str = "topology", label: str = "label", condition: str = "condition") -> DataFrame:
    """Numeric topology and target, and one 0/1 flag per background condition."""
    flags = condition_flags(F.col(condition))
    rest = [c for c in df.columns if c not in (topology, label, condition)]
    return df.select(
        topology_code(F.col(topology)).alias("topology"),
        label_code(F.col(label)).alias("target"),
        *[flag.alias(name) for name, flag in flags.items()],
        *rest,
    )


def joined_once(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "full") -> DataFrame:
    """Two blocks side by side on their keys; a column that both have comes from the left one."""
    fresh = [c for c in right.columns if c in on or c not in left.columns]
    return left.join(right.select(*fresh), list(on), how)


def fixed_rate_second(position: Column, rate: int) -> Column:
    """Whole second of a sample taken at a fixed rate."""
    return F.floor(position / F.lit(rate))
