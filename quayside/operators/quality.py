"""Quality metrics of a dataset: balance, completeness, correlation, overlap, purity, relevance."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.numeric import absent, array_variance, finite, metric_round, standardise, top_mean
from quayside.operators.correlations import correlations_by
from quayside.operators.grouped_neighbours import MOST_ROWS, nearest_neighbours_by
from quayside.operators.neighbours import link_members, tomek_links
from quayside.operators.ordered import DEFAULT_SKEW, Skew, lookup, ranked
from quayside.operators.sampling import contiguous_folds
from quayside.session import settle


def filled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """NaN and null to 0, infinities to the largest double, in the feature columns."""
    return df.withColumns({c: finite(F.col(c)) for c in features})


def standardised(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Every feature in population deviations from its mean; nulls stay out of the fit and stay null."""
    parts = [F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("deviation")).alias(c) for c in features]
    fit = df.agg(*parts).select(F.struct(*features).alias("fit")).scalar()
    fitted = df.withColumn("_fit", fit)
    return fitted.withColumns(
        {c: standardise(F.col(c), F.col(f"_fit.{c}.mean"), F.col(f"_fit.{c}.deviation")) for c in features}
    ).drop("_fit")


def class_parity(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """1 minus the mean absolute deviation of the class sizes, relative to the largest class."""
    by = list(by)
    sizes = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    spread = [F.max("_n").alias("_top"), F.avg("_n").alias("_mean")]
    if by:
        sized = sizes.join(sizes.groupBy(*by).agg(*spread), by)
        top, mean = F.col("_top"), F.col("_mean")
    else:
        stats = sizes.agg(*spread).select(F.struct("_top", "_mean").alias("s")).scalar()
        sized, top, mean = sizes.withColumn("_s", stats), F.col("_s._top"), F.col("_s._mean")
    deviation = F.abs(F.col("_n") / top - mean / top)
    rows = sized.withColumn("_d", deviation)
    score = metric_round(1 - F.avg("_d")).alias("class_parity")
    return rows.groupBy(*by).agg(score) if by else rows.agg(score)


def completeness(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of feature cells of any type that are neither null nor NaN."""
    kinds = dict(df.dtypes)
    gaps = sum((F.count_if(absent(F.col(c), kinds[c])) for c in features), F.lit(0))
    cells = F.count(F.lit(1)) * len(features)
    score = metric_round(1 - gaps / F.nullif(cells, F.lit(0))).alias("completeness")
    return df.groupBy(*by).agg(score) if by else df.agg(score)


def correlation_pairs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pearson correlation of every feature pair: left < right (positions), r.

    A pair is taken over the rows where neither cell is null or NaN; r is null if one of both is constant there.
    Each task reduces its rows to counts, sums and products of cells less their column's mean, and only those are
    exchanged, so the result does not depend on how the rows are spread.
    """
    features = list(features)
    numbers = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in features])
    means = np.array([np.nan if m is None else m for m in numbers.agg(*[F.avg(c) for c in features]).first()], "float64")
    if np.isinf(means).any():
        raise ValueError("infinite cells have no correlation; see filled")
    means = np.nan_to_num(means)
    size = len(features)
    left, right = np.triu_indices(size, 1)
    names = ["n", "x", "y", "xx", "yy", "xy"]

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(names), len(left)))
        for frame in frames:
            cells = frame.to_numpy("float64") - means
            there = (~np.isnan(cells)).astype("float64")
            cells = np.nan_to_num(cells)
            counts, sums, squares = there.T @ there, cells.T @ there, (cells * cells).T @ there
            parts = (counts[left, right], sums[left, right], sums[right, left], squares[left, right], squares[right, left])
            total += np.array([*parts, (cells.T @ cells)[left, right]])
        yield pd.DataFrame({"left": left, "right": right, **dict(zip(names, total))})

    kinds = ", ".join(f"{c} double" for c in names)
    sums = numbers.mapInPandas(products, f"left int, right int, {kinds}").groupBy("left", "right").agg(*[F.sum(c).alias(c) for c in names])

    def spread(square: str, plain: str) -> Column:
        # what is left of the squares of a constant column is rounding
        value = F.col(square) - F.try_divide(F.col(plain) * F.col(plain), F.col("n"))
        return F.when(value > F.col(square) * 1e-12, value)

    both = F.col("xy") - F.try_divide(F.col("x") * F.col("y"), F.col("n"))
    return sums.select("left", "right", F.try_divide(both, F.sqrt(spread("xx", "x")) * F.sqrt(spread("yy", "y"))).alias("r"))


def _correlation_score(r_sum: Column, size: int) -> Column:
    # both triangles are summed over the number of one triangle's pairs
    return metric_round(1 - F.lit(2.0) * F.coalesce(r_sum, F.lit(0.0)) / (size * (size - 1) / 2))


def _counted(r: Column) -> Column:
    """|r| of a pair that counts; perfect and undefined correlations do not."""
    return F.when(F.abs(r) < 1 - 1e-12, F.abs(r))


#: Pairs that are aggregated by an expression each.
MOST_PAIR_EXPRESSIONS = 45


def feature_correlation(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """1 minus twice the mean absolute correlation of feature pairs.

    Datasets named in ``by`` with few pairs are aggregated by an expression for each pair, others by ``correlations_by``.
    """
    size = len(features)
    if not by:
        return correlation_pairs(df, features).agg(
            _correlation_score(F.sum(_counted(F.col("r"))), size).alias("feature_correlation")
        )

    if size * (size - 1) // 2 > MOST_PAIR_EXPRESSIONS:
        found = correlations_by(df, features, by)
        total = F.aggregate("r", F.lit(0.0), lambda s, r: s + F.coalesce(_counted(r), F.lit(0.0)))
        return found.select(*by, _correlation_score(total, size).alias("feature_correlation"))

    def pearson(a: str, b: str) -> Column:
        # corr() fails on a constant column, where the correlation is undefined
        spread = F.stddev_pop(F.when(F.col(b).isNotNull(), F.col(a))) * F.stddev_pop(F.when(F.col(a).isNotNull(), F.col(b)))
        return F.try_divide(F.covar_pop(a, b), spread)

    pairs = [pearson(a, b).alias(f"r{i}") for i, (a, b) in enumerate(combinations(features, 2))]
    grouped = df.groupBy(*by).agg(*pairs)
    total = sum((F.coalesce(_counted(F.col(f"r{i}")), F.lit(0.0)) for i in range(len(pairs))), F.lit(0.0))
    return grouped.select(*by, _correlation_score(total, size).alias("feature_correlation"))


def relevance_score(importances: Column, alpha: float = 0.9) -> Column:
    """Even spread of importances against the mean of the three largest."""
    spread = F.lit(1.0) - array_variance(importances)
    return metric_round(F.lit(alpha) * spread + F.lit(1 - alpha) * top_mean(importances, 3))


MOST_CLASSES = 10_000


def _indexed(df: DataFrame, label: str) -> tuple[DataFrame, list]:
    """Add the dense class number; rows without a label take no part. A column with very many values is refused."""
    df = df.filter(F.col(label).isNotNull())
    classes = [r[0] for r in df.select(label).distinct().orderBy(label).limit(MOST_CLASSES + 1).collect()]
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"{label} has more than {MOST_CLASSES} classes")
    entries = [x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))]
    return df.withColumn("_class", F.create_map(*entries)[F.col(label)]), classes


def _forest(trees: int, depth: int, seed: int) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="_vector", labelCol="_class", probabilityCol="_p", numTrees=trees, maxDepth=depth, seed=seed
    )


def _assembled(df: DataFrame, features: Sequence[str] | str) -> DataFrame:
    if isinstance(features, str):
        return df.withColumn("_vector", array_to_vector(F.col(features)))
    return VectorAssembler(inputCols=list(features), outputCol="_vector").transform(df)


def feature_relevance(
    df: DataFrame, features: Sequence[str] | str, label: str, alpha: float = 0.9, trees: int = 100, depth: int = 10, seed: int = 42
) -> DataFrame:
    """Relevance from the importances of a random forest trained on the whole dataset."""
    indexed, _ = _indexed(df, label)
    model = _forest(trees, depth, seed).fit(_assembled(indexed, features))
    importances = F.array(*[F.lit(float(v)) for v in model.featureImportances.toArray()])
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", relevance_score(importances, alpha).alias("feature_relevance")
    )


def minority_class(df: DataFrame, label: str) -> DataFrame:
    """The smallest class, the lowest label among equals."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.min_by(label, F.struct("n", label)).alias("minority"))


def class_overlap(
    df: DataFrame,
    ident: str,
    vector: str,
    label: str,
    links: DataFrame | None = None,
    classify: bool = True,
    method: str = "exact",
) -> DataFrame:
    """Share of rows left after dropping the link members outside the smallest class; 1 if labels are no classes.

    ``method``: as in ``nearest_neighbours``; with "hashed" links are looked for among the neighbours found.
    """
    if not classify:
        return df.agg((F.lit(1.0) + 0 * F.count(F.lit(1))).alias("class_overlap"))
    found = tomek_links(df, ident, vector, label, method=method) if links is None else links
    dropped = link_members(found).filter(F.col("label") != minority_class(df, label).scalar())
    removed = dropped.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.agg((1 - removed / F.count(F.lit(1))).alias("class_overlap"))


def class_overlap_by(df: DataFrame, by: str, ident: str, vector: str, label: str, most: int = MOST_ROWS) -> DataFrame:
    """``class_overlap`` of every dataset named in ``by``, each searched by itself; see ``nearest_neighbours_by``.

    Ids are unique within a dataset. A dataset of one row has no link.
    """
    rows = df.select(F.col(by).alias("by"), F.col(label).alias("y"), F.col(ident).cast("long").alias("id"), F.col(vector).alias("x"))
    near = nearest_neighbours_by(rows, "by", "id", "x", most)
    pairs = near.groupBy("by", F.least("id", "neighbour").alias("low"), F.greatest("id", "neighbour").alias("high")).agg(F.count(F.lit(1)).alias("sides"))
    members = pairs.filter("sides = 2").select(F.col("by").alias("of"), "low", "high", F.explode(F.array("low", "high")).alias("member"))
    labelled = members.join(rows.select("by", "y", "id"), F.col("of").eqNullSafe(F.col("by")) & (F.col("member") == F.col("id")))
    links = labelled.groupBy("by", "low", "high").agg(F.collect_list("y").alias("labels")).filter(F.col("labels")[0] != F.col("labels")[1])
    linked = links.select(F.col("by").alias("of"), F.explode("labels").alias("y")).groupBy("of", "y").agg(F.count(F.lit(1)).alias("linked"))
    sizes = rows.groupBy("by", "y").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.groupBy("by").agg(F.min_by("y", F.struct("n", "y")).alias("least"), F.sum("n").alias("rows"))
    joined = whole.join(linked, F.col("by").eqNullSafe(F.col("of")), "left")
    dropped = F.sum(F.when(~F.col("y").eqNullSafe(F.col("least")), F.col("linked")))
    share = 1 - F.coalesce(dropped, F.lit(0)) / F.col("rows")
    return joined.groupBy("by", "rows").agg(share.alias("class_overlap")).select(F.col("by").alias(by), "class_overlap")


def out_of_fold_probabilities(
    df: DataFrame,
    ident: str,
    features: Sequence[str] | str,
    label: str,
    folds: int = 5,
    trees: int = 100,
    depth: int = 10,
    seed: int = 42,
) -> tuple[DataFrame, list]:
    """Class probabilities of each row from a forest that did not see it: id, class, p. Also the class list."""
    indexed, classes = _indexed(df, label)
    placed = settle(contiguous_folds(_assembled(indexed, features).select(ident, "_class", "_vector"), [ident], folds, seed))
    parts = []
    for fold in sorted(r[0] for r in placed.select("fold").distinct().collect()):
        model = _forest(trees, depth, seed).fit(placed.filter(F.col("fold") != fold))
        scored = model.transform(placed.filter(F.col("fold") == fold))
        p = vector_to_array("_p")
        # a class that is missing among the training rows has no probability of its own
        padded = F.concat(p, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(len(classes)) - F.size(p))))
        parts.append(scored.select(F.col(ident).alias("id"), F.col("_class").cast("int").alias("class"), padded.alias("p")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result, classes


def confident_joint(probabilities: DataFrame, classes: int) -> DataFrame:
    """How many rows of each class are confidently of each class: class, guess, n.

    A row is confidently of class j when its probability reaches the mean probability that
    rows of class j give to j; among several the most probable one counts.
    """
    means = [F.avg(F.when(F.col("class") == k, F.col("p")[k])).alias(f"t{k}") for k in range(classes)]
    limits = probabilities.agg(*means).select(F.array(*[f"t{k}" for k in range(classes)]).alias("t")).scalar()
    reached = F.array_compact(
        F.array(
            *[
                F.when(F.col("p")[k] >= F.col("_limits")[k] - 1e-6, F.struct(F.col("p")[k].alias("p"), F.lit(-k).alias("k")))
                for k in range(classes)
            ]
        )
    )
    guess = -F.array_max(reached).getField("k")
    return (
        probabilities.withColumn("_limits", limits)
        .select("class", guess.alias("guess"))
        .filter(F.col("guess").isNotNull())
        .groupBy("class", "guess")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def label_issues(probabilities: DataFrame, classes: int, skew: Skew = DEFAULT_SKEW) -> DataFrame:
    """Rows whose label is probably wrong: id, self_confidence.

    The confident joint is scaled to the class sizes. For every (class, other class) that many rows
    with the largest margin towards the other class are taken, except rows whose most probable
    class is their own.
    """
    # read by four branches
    probabilities = settle(probabilities)
    sizes = probabilities.groupBy("class").agg(F.count(F.lit(1)).alias("size"))
    joint = confident_joint(probabilities, classes)
    row_sums = joint.groupBy("class").agg(F.sum("n").alias("total"))
    scaled = joint.join(row_sums, "class").join(sizes, "class").filter("class <> guess")
    budget = scaled.groupBy("class").agg(
        F.map_from_entries(
            F.collect_list(F.struct("guess", F.floor(F.col("n") / F.col("total") * F.col("size") + 0.5).alias("take")))
        ).alias("budget")
    )
    open_rows = lookup(probabilities, budget, ["class"], "inner", skew)
    margins = (
        open_rows.select("id", "class", "p", F.explode("budget").alias("other", "take"))
        .filter("take > 0")
        .withColumn("lead", F.expr("p[class] - p[other]"))
    )
    taken = ranked(margins, ["class", "other"], ["lead", "id"], "place", skew).filter("place <= take")
    own = F.expr("p[class]")
    wrong = taken.filter(own < F.array_max("p"))
    return wrong.groupBy("id").agg(F.max(own).alias("self_confidence"))


def label_purity(
    df: DataFrame,
    ident: str,
    vector: str,
    label: str,
    links: DataFrame | None = None,
    issues: DataFrame | None = None,
    overlap: str = "links",
    **forest,
) -> DataFrame:
    """1 minus the share of rows that are both in an overlap set and a label issue.

    ``overlap="links"`` takes the link members, ``"kept"`` the rows that survive dropping them.
    """
    found = tomek_links(df, ident, vector, label) if links is None else links
    members = link_members(found)
    if overlap == "kept":
        dropped = members.filter(F.col("label") != minority_class(df, label).scalar())
        ids = df.select(F.col(ident).alias("id")).join(dropped.select("id"), "id", "left_anti")
    else:
        ids = members.select("id")
    if issues is None:
        probabilities, classes = out_of_fold_probabilities(df, ident, vector, label, **forest)
        issues = label_issues(probabilities, len(classes))
    both = ids.join(issues.select("id"), "id", "left_semi").agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.agg(metric_round(1 - both / F.count(F.lit(1))).alias("label_purity"))
