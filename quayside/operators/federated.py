"""Averaging model updates across providers, and training rounds over distributed data."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.session import settle


def averaged_parameters(updates: DataFrame, by: Sequence[str], weights: str = "weights", examples: str = "n") -> DataFrame:
    """Per group and parameter position, the mean weighted by the number of examples (long form).

    Providers without examples do not contribute; a group with none at all has no average.
    """
    exploded = updates.filter(F.col(examples) > 0).select(*by, F.col(examples).alias("_n"), F.posexplode(weights))
    return exploded.groupBy(*by, "pos").agg((F.sum(F.col("col") * F.col("_n")) / F.sum("_n")).alias("value"))


def federated_average(updates: DataFrame, by: Sequence[str], weights: str = "weights", examples: str = "n") -> DataFrame:
    """The same as one array per group; its length is the model size."""
    long = averaged_parameters(updates, by, weights, examples)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return long.groupBy(*by).agg(F.transform(ordered, lambda e: e.getField("value")).alias("weights"))


def weighted_metric(reports: DataFrame, by: Sequence[str], metric: str, examples: str = "n") -> DataFrame:
    """Mean of a metric weighted by the number of examples."""
    value = F.sum(F.col(examples) * F.col(metric)) / F.nullif(F.sum(examples), F.lit(0))
    return reports.groupBy(*by).agg(value.alias(metric))


@dataclass(frozen=True)
class ModelFunctions:
    """What a model consumer supplies. All four work on plain arrays.

    ``gradient`` and ``score`` must be sums over rows, so that a provider's rows may lie in any
    number of tasks: gradient(weights, x, y) -> array like weights; score(weights, x, y) ->
    (number correct, summed loss); step(weights, gradient sum, rows) -> new weights.
    """

    initial: Callable[[], np.ndarray]
    gradient: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    step: Callable[[np.ndarray, np.ndarray, int], np.ndarray]
    score: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[float, float]]


def softmax_regression(features: int, classes: int, rate: float = 0.5) -> ModelFunctions:
    """Multinomial logistic regression with a bias, labels 0..classes-1."""
    shape = (features + 1, classes)

    def shares(weights, x):
        scores = np.hstack([x, np.ones((len(x), 1))]) @ weights.reshape(shape)
        raised = np.exp(scores - scores.max(axis=1, keepdims=True))
        return raised / raised.sum(axis=1, keepdims=True)

    def gradient(weights, x, y):
        off = shares(weights, x)
        off[np.arange(len(y)), y] -= 1.0
        return (np.hstack([x, np.ones((len(x), 1))]).T @ off).ravel()

    def score(weights, x, y):
        p = shares(weights, x)
        return float((p.argmax(axis=1) == y).sum()), float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum())

    return ModelFunctions(
        lambda: np.zeros(shape[0] * shape[1]), gradient, lambda w, g, n: w - rate * g / max(n, 1), score
    )


#: Bytes of gradients a task combines before it hands them on.
HELD_BYTES = 64 << 20
#: Rows of one provider that meet its weights in one call; a larger provider is cut into parts.
PART_ROWS = 50_000
#: Most providers above ``PART_ROWS`` whose names are broadcast.
MOST_LARGE = 100_000
SUMS = "provider string, correct double, loss double, n long, gradient array<double>"
_SUM_COLUMNS = ["provider", "correct", "loss", "n", "gradient"]


def _row_sums(rows: pd.DataFrame, weights: np.ndarray, model: ModelFunctions, learn: bool) -> list:
    x, y = np.stack(rows["x"].to_numpy()), rows["y"].to_numpy()
    correct, loss = model.score(weights, x, y)
    return [correct, loss, len(y), model.gradient(weights, x, y) if learn else np.empty(0)]


def _sums(data: DataFrame, weights: np.ndarray, model: ModelFunctions, learn: bool) -> DataFrame:
    """Per task and provider: sums of score and gradient under the same weights. ``data`` is (provider, x, y)."""

    def reduce_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}

        def emit() -> pd.DataFrame:
            rows = [(name, *sums) for name, sums in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=_SUM_COLUMNS)

        for frame in frames:
            for provider, part in frame.groupby("provider", sort=False):
                sums = _row_sums(part, weights, model, learn)
                before = held.get(provider)
                held[provider] = sums if before is None else [a + b for a, b in zip(before, sums)]
            # sums are combined in the task, as far as they fit
            if learn and 8 * len(held) * len(weights) > HELD_BYTES:
                yield emit()
        if held:
            yield emit()

    return data.select(F.col("provider").cast("string"), "x", "y").mapInPandas(reduce_rows, SUMS)


def parted(data: DataFrame) -> DataFrame:
    """(provider, x, y, part): the rows of a large provider are spread over parts of about ``PART_ROWS`` rows.

    Rows without a provider belong to none and are left out. Stored, as a part must not change when a task is repeated.
    """
    rows = data.select(F.col("provider").cast("string").alias("provider"), "x", "y").filter("provider IS NOT NULL")
    sizes = rows.groupBy("provider").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > PART_ROWS)
    large = settle(sizes.select(F.col("provider").alias("_large"), F.ceil(F.col("_n") / PART_ROWS).cast("long").alias("_parts")))
    large = F.broadcast(large) if large.count() <= MOST_LARGE else large
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("_parts", F.lit(1).cast("long")))
    return settle(rows.join(large, F.col("provider") == F.col("_large"), "left").select("provider", "x", "y", place.alias("part")))


def _own_sums(parts: DataFrame, weights: DataFrame, model: ModelFunctions, learn: bool) -> DataFrame:
    """Per part: sums of score and gradient under the provider's own weights, a table (provider, weights).

    Every part meets one copy of its provider's weights; neither names nor weights pass through the driver.
    """

    def reduce_part(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or own.empty:
            return pd.DataFrame([], columns=_SUM_COLUMNS)
        sums = _row_sums(rows, np.asarray(own["weights"].iloc[0]), model, learn)
        return pd.DataFrame([(rows["provider"].iloc[0], *sums)], columns=_SUM_COLUMNS)

    places = parts.select(F.col("provider").alias("of"), F.col("part").alias("of_part")).distinct()
    places = places.join(weights.select(F.col("provider").alias("of"), "weights"), "of")
    return parts.groupBy("provider", "part").cogroup(places.groupBy("of", "of_part")).applyInPandas(reduce_part, SUMS)


def _scores(sums: DataFrame, prefix: str) -> DataFrame:
    return sums.groupBy("provider").agg(
        F.sum("n").alias("n"),
        (F.sum("correct") / F.sum("n")).alias(f"{prefix}_performance"),
        (F.sum("loss") / F.sum("n")).alias(f"{prefix}_loss"),
    )


def _stepped(sums: DataFrame, weights: DataFrame | np.ndarray, model: ModelFunctions) -> DataFrame:
    """New weights per provider from the summed gradients: provider, n, weights."""
    rows = sums.groupBy("provider").agg(F.sum("n").alias("n"))
    gradient = (
        sums.select("provider", F.posexplode("gradient"))
        .groupBy("provider", "pos")
        .agg(F.sum("col").alias("g"))
        .groupBy("provider")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "g"))), lambda e: e.getField("g")).alias("gradient"))
    )
    joined = gradient.join(rows, "provider")
    if isinstance(weights, np.ndarray):

        @F.pandas_udf("array<double>")
        def step(gradients: pd.Series, n: pd.Series) -> pd.Series:
            return pd.Series([model.step(weights, np.asarray(g), int(c)) for g, c in zip(gradients, n)])

        return joined.select("provider", "n", step("gradient", "n").alias("weights"))

    @F.pandas_udf("array<double>")
    def own_step(own: pd.Series, gradients: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([model.step(np.asarray(w), np.asarray(g), int(c)) for w, g, c in zip(own, gradients, n)])

    before = joined.join(weights.select("provider", F.col("weights").alias("_own")), "provider")
    return before.select("provider", "n", own_step("_own", "gradient", "n").alias("weights"))


def local_round(data: DataFrame, start: np.ndarray, model: ModelFunctions, epochs: int = 1) -> DataFrame:
    """Every provider evaluates the global weights, trains on its rows, and evaluates again.

    Returns provider, n, weights, pre_/post_ performance and loss. Gradients are summed across
    tasks, so a provider may hold any share of the rows. Only the weights all providers start from
    are sent by the driver; the weights of each provider are a table from the first step on.
    """
    parts = parted(data)
    first = settle(_sums(parts, start, model, True))
    before = _scores(first, "pre").select("provider", "pre_performance", "pre_loss")
    trained = settle(_stepped(first, start, model))
    for _ in range(epochs - 1):
        trained = settle(_stepped(settle(_own_sums(parts, trained, model, True)), trained, model))
    after = _scores(_own_sums(parts, trained, model, False), "post")
    return trained.join(before, "provider").join(after.drop("n"), "provider")


def evaluate_global(data: DataFrame, weights: np.ndarray, model: ModelFunctions) -> DataFrame:
    """A tester's performance and loss of the global model on held-out rows."""
    sums = _sums(data.withColumn("provider", F.lit("tester")), weights, model, False)
    return _scores(sums, "test").drop("provider")


def quality_messages(
    reports: DataFrame, model_id: str, run_id: str, train_round: int, dataset: str = "provider"
) -> DataFrame:
    """Training reports as monitoring messages."""

    def value(name):
        return (F.col(name) if name in reports.columns else F.lit(None)).cast("double")

    quality = F.struct(
        value("post_performance").alias("post_train_performance"),
        value("pre_performance").alias("pre_train_performance"),
        value("pre_loss").alias("pre_loss_value"),
        value("post_loss").alias("post_loss_value"),
        value("train_duration").alias("train_duration"),
        value("test_performance").alias("test_performance"),
        value("test_loss").alias("test_loss"),
    )
    return reports.select(
        F.struct(
            F.col("provider").alias("name"),
            F.lit(run_id).alias("run_id"),
            F.col(dataset).alias("functionality"),
            F.lit(model_id).alias("application_name"),
        ).alias("metadata"),
        F.current_timestamp().alias("timestamp"),
        F.struct(
            F.lit(train_round).alias("train_round"),
            quality.alias("quality_of_model"),
            F.lit(None).cast("struct<cpu_percentage:double,memory_usage:double>").alias("resource_monitor"),
        ).alias("report"),
    )
