"""Recordings to labelled window features, train/test and provider partitions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.text import CONTACT_SENSORS, HYDROPHONES, recording_parts
from quayside.operators.ordered import DEFAULT_SKEW, Skew
from quayside.operators.splits import chronological_split, provider_partitions
from quayside.operators.windows import (
    EXECUTED_RULES,
    beside,
    candidate_predicate,
    conditions_of,
    features_with_series_width,
    labelled,
    truncate_recording,
    with_noise,
)
from quayside.session import settle


@dataclass(frozen=True)
class FeatureOptions:
    # fixed values: the defaults of the recordings' configuration
    seconds: int = 5
    buckets: int = 2
    overlap: float = 0.5
    providers: int = 8
    test_fraction: float = 0.2
    last_second: int = 29
    topology: str | None = None
    label: str | None = None


GROUP = ["condition", "topology", "label", "flow"]


def recording_features(
    recordings: DataFrame, options: FeatureOptions = FeatureOptions(), skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """Window features per recording. Input: file_name, pos, second, value.

    Features are computed once per recording, before a recording is handed to its conditions.
    """
    parts = recording_parts(F.col("file_name"))
    chosen = recordings.filter(candidate_predicate(parts, options.topology, options.label))
    features = features_with_series_width(
        truncate_recording(chosen, "second", options.last_second), ["file_name"], "pos", "value", "second", options.seconds, options.overlap, options.buckets, skew=skew
    )
    return features.select("*", *[c.alias(n) for n, c in recording_parts(F.col("file_name")).items()])


def feature_table(
    recordings: DataFrame,
    options: FeatureOptions = FeatureOptions(),
    sensors: Sequence[str] = tuple(CONTACT_SENSORS + HYDROPHONES),
    rules: Sequence[tuple] = tuple(EXECUTED_RULES),
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """One row per (condition, topology, label, flow, window) with all sensor blocks side by side.

    The window features are a small fraction of the readings and feed both the recordings and
    their background noise, so they are written once.
    """
    features = settle(recording_features(recordings, options, skew))
    columns = [*[f"b{b}" for b in range(options.buckets)], "mean", "std"]
    noise = features.filter("is_noise")
    heard = with_noise(features.filter(~F.col("is_noise")), noise, columns, skew=skew)
    parts = {n: F.col(n) for n in ("is_noise", "topology", "label", "flow", "noise", "sensor")}
    routed = heard.withColumn("condition", F.explode(conditions_of(parts, rules)))
    noise_columns = [f"N_{c}" for c in columns]
    blocks = beside(routed, GROUP, sensors, [*columns, *noise_columns])
    unheard = [f"{s}_{c}" for s in sensors if s in CONTACT_SENSORS for c in noise_columns]
    return blocks.drop(*unheard)


def labelled_features(table: DataFrame) -> DataFrame:
    return labelled(table)


def train_test(table: DataFrame, options: FeatureOptions = FeatureOptions(), skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Chronological split inside every (condition, topology, label, flow) group."""
    return chronological_split(settle(table), GROUP, "time", ["window_id"], options.test_fraction, skew=skew)


def provider_shares(table: DataFrame, key: Sequence[str], options: FeatureOptions = FeatureOptions()) -> DataFrame:
    """Label-skewed plus uniform share per provider; ``table`` has a numeric ``target``."""
    return provider_partitions(settle(table), "target", key, options.providers, options.test_fraction)
