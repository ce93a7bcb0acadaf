"""All quality metrics of one dataset in one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.operators.neighbours import tomek_links
from quayside.operators.quality import (
    class_overlap,
    class_parity,
    completeness,
    feature_correlation,
    feature_relevance,
    filled,
    label_purity,
)
from quayside.session import settle


def quality_report(
    df: DataFrame, ident: str, features: Sequence[str], label: str, alpha: float = 0.9, trees: int = 100, depth: int = 10
) -> DataFrame:
    """class_overlap, class_parity, label_purity, feature_correlation, feature_relevance, completeness.

    Completeness looks at the data as it came; all other metrics see the filled matrix.
    The nearest-neighbour links are found once and feed two of the metrics.
    """
    clean = settle(
        filled(df, features).select(ident, label, *features).withColumn("_x", F.array(*[F.col(c) for c in features]))
    )
    links = settle(tomek_links(clean, ident, "_x", label))
    forest = {"trees": trees, "depth": depth}
    overlap = class_overlap(clean, ident, "_x", label, links)
    metrics = {
        "class_parity": class_parity(clean, label),
        "label_purity": label_purity(clean, ident, "_x", label, links, **forest),
        "feature_correlation": feature_correlation(clean, features),
        "feature_relevance": feature_relevance(clean, "_x", label, alpha, **forest).select("feature_relevance"),
        "completeness": completeness(df, features),
    }
    return overlap.select("class_overlap", *[one.scalar().alias(name) for name, one in metrics.items()])
