"""Messages and a price table in, one cost record per closed round out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from quayside.functions.pricing import STANDARD_COSTS, CostFunctions
from quayside.operators.ordered import DEFAULT_SKEW, Skew
from quayside.operators.rounds import closed_rounds, fold_rounds, price_rounds


def round_cost(
    messages: DataFrame,
    prices: DataFrame,
    order: Sequence[str] = ("timestamp",),
    costs: CostFunctions = STANDARD_COSTS,
    memory_unit: str = "bytes",
    skew: Skew | None = DEFAULT_SKEW,
) -> DataFrame:
    """Cost records of all closed rounds of a batch of flat messages."""
    return closed_rounds(price_rounds(fold_rounds(messages, order, skew=skew), prices, costs, memory_unit))
