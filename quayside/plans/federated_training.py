"""Training rounds: local training per provider, weighted averaging, optional tester."""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.operators.federated import (
    ModelFunctions,
    evaluate_global,
    federated_average,
    local_round,
    quality_messages,
)
from quayside.session import settle


@dataclass(frozen=True)
class Training:
    weights: np.ndarray
    messages: DataFrame
    history: DataFrame


def train(
    data: DataFrame,
    model: ModelFunctions,
    rounds: int,
    model_id: str = "model",
    run_id: str = "1",
    epochs: int = 1,
    held_out: DataFrame | None = None,
) -> Training:
    """Run the rounds over ``data`` (provider, x, y).

    Only the averaged weights, one model in size, pass through the driver between rounds.
    ``history`` has one row per (round, provider); ``messages`` are the quality reports.
    """
    weights = model.initial()
    history, messages = [], []
    for number in range(1, rounds + 1):
        began = time.time()
        updates = settle(local_round(data, weights, model, epochs))
        # examples decide the average; one group per round
        averaged = federated_average(updates.withColumn("round", F.lit(number)), ["round"]).first()
        weights = np.asarray(averaged["weights"])
        report = updates.drop("weights").withColumn("train_duration", F.lit(float(round(time.time() - began))))
        if held_out is not None:
            tested = evaluate_global(held_out, weights, model).first()
            report = report.withColumns(
                {c: F.lit(float(tested[c])) for c in ("test_performance", "test_loss")}
            )
        history.append(report.withColumn("round", F.lit(number)))
        messages.append(quality_messages(report, model_id, run_id, number))
    return Training(weights, _all(messages), _all(history))


def _all(frames: list[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result
