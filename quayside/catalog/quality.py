"""Quality metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.catalog.base import query, table
from quayside.catalog.views import FEATURES, GAPS_SQL, gaps, matrix, vectors
from quayside.functions.numeric import array_variance, euclidean, metric_round, top_mean
from quayside.operators.correlations import correlations_by
from quayside.operators.grouped_neighbours import nearest_neighbours_by
from quayside.operators.neighbours import mutual_pairs, nearest_neighbours, tomek_links
from quayside.operators.quality import (
    class_overlap,
    class_overlap_by,
    class_parity,
    completeness,
    confident_joint,
    correlation_pairs,
    feature_correlation,
    feature_relevance,
    label_issues,
    label_purity,
    out_of_fold_probabilities,
    relevance_score,
    standardised,
)
from quayside.plans.quality_report import quality_report
from quayside.session import settle

PARITY_SQL = """SELECT {keys} round_even(1 - avg(abs(n / top - mean / top)), 4) AS class_parity FROM (
 SELECT *, max(n) OVER ({part}) AS top, avg(n) OVER ({part}) AS mean FROM (
  SELECT {keys} {label} AS label, CAST(count(*) AS DOUBLE) AS n FROM {source} GROUP BY ALL)) {group}"""


@query("class_parity", PARITY_SQL.format(keys="", part="", label="label", source="embeddings", group=""))
def _(spark, sf_dir):
    return class_parity(table(spark, sf_dir, "embeddings"), "label")


@query("class_parity_of_labels", PARITY_SQL.format(keys="", part="", label="quality", source="labels", group=""))
def _(spark, sf_dir):
    return class_parity(table(spark, sf_dir, "labels"), "quality")


@query(
    "class_parity_by_dataset",
    PARITY_SQL.format(
        keys="l_suppkey,", part="PARTITION BY l_suppkey", label="l_returnflag", source="lineitem", group="GROUP BY l_suppkey"
    ),
)
def _(spark, sf_dir):
    return class_parity(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_suppkey"])


@query(
    "completeness",
    f"""WITH {GAPS_SQL} SELECT round_even(1 - (count(*) * 3 - count(l_quantity) - count(l_discount) - count(l_tax))::DOUBLE
     / (count(*) * 3), 4) AS completeness FROM gaps""",
)
def _(spark, sf_dir):
    return completeness(gaps(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"])


@query(
    "completeness_by_dataset",
    f"""WITH {GAPS_SQL} SELECT y, round_even(1 - (count(*) * 3 - count(l_quantity) - count(l_discount) - count(l_tax))::DOUBLE
     / (count(*) * 3), 4) AS completeness FROM gaps GROUP BY y""",
)
def _(spark, sf_dir):
    return completeness(gaps(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"], ["y"])


LONG_SQL = """
cells AS (SELECT vec_id, unnest(range(64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
pairs AS (SELECT CAST(a.d AS INTEGER) AS "left", CAST(b.d AS INTEGER) AS "right", corr(a.v, b.v) AS r
 FROM cells a JOIN cells b ON b.vec_id = a.vec_id AND a.d < b.d GROUP BY a.d, b.d)"""


@query("correlation_pairs", f'WITH {LONG_SQL} SELECT "left", "right", round(r, 6) AS r FROM pairs')
def _(spark, sf_dir):
    return correlation_pairs(matrix(spark, sf_dir), FEATURES).withColumn("r", F.round("r", 6))


@query(
    "feature_correlation",
    f"""WITH {LONG_SQL} SELECT round_even(1 - 2 * sum(abs(r)) FILTER (abs(r) < 1 - 1e-12) / (64 * 63 / 2.0e0), 4)
     AS feature_correlation FROM pairs""",
)
def _(spark, sf_dir):
    return feature_correlation(matrix(spark, sf_dir), FEATURES)


@query(
    "feature_correlation_by_dataset",
    """SELECT l_returnflag, round_even(1 - 2 * (abs(corr(l_quantity, l_discount)) + abs(corr(l_quantity, l_tax))
      + abs(corr(l_discount, l_tax))) / 3.0e0, 4) AS feature_correlation FROM lineitem GROUP BY 1""",
)
def _(spark, sf_dir):
    return feature_correlation(
        table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], ["l_returnflag"]
    )


@query(
    "relevance_of_importances",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
    SELECT vec_id, round_even(0.9e0 * (1 - list_var_pop(x)) + (1 - 0.9e0) * list_avg(list_reverse_sort(x)[1:3]), 4)
     AS feature_relevance FROM v""",
)
def _(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), relevance_score(F.col("x")).alias("feature_relevance"))


@query(
    "top_mean_and_variance",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
    SELECT vec_id, round(list_avg(list_reverse_sort(x)[1:3]), 6) AS best, round(list_var_pop(x), 6) AS spread FROM v""",
)
def _(spark, sf_dir):
    return vectors(spark, sf_dir).select(
        F.col("id").alias("vec_id"),
        F.round(top_mean(F.col("x"), 3), 6).alias("best"),
        F.round(array_variance(F.col("x")), 6).alias("spread"),
    )


@query(
    "standardised_features",
    """SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity,
     round((nullif(l_tax, 0.0e0) - avg(nullif(l_tax, 0.0e0)) OVER ()) / stddev_pop(nullif(l_tax, 0.0e0)) OVER (), 6) AS l_tax,
     1.0e0 - 1.0e0 AS one FROM lineitem""",
)
def _(spark, sf_dir):
    data = gaps(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", F.lit(1.0).alias("one"))
    scaled = standardised(data, ["l_quantity", "l_tax", "one"])
    return scaled.select(
        "l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in ("l_quantity", "l_tax")], "one"
    )


@query(
    "half_even_rounding",
    "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 8.0e0, 2) AS eighth FROM lineitem",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", metric_round(F.col("l_quantity") / 8.0, 2).alias("eighth")
    )


NEAREST_SQL = """
v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings),
near AS (SELECT a.id, a.label, arg_min(b.id, (list_distance(a.x, b.x), b.id)) AS neighbour, min(list_distance(a.x, b.x)) AS distance
 FROM v a JOIN v b ON a.id <> b.id GROUP BY a.id, a.label),
links AS (SELECT a.id AS low, b.id AS high, a.label AS low_label, b.label AS high_label
 FROM near a JOIN near b ON a.neighbour = b.id AND b.neighbour = a.id AND a.id < b.id)"""


@query(
    "nearest_neighbours",
    f"WITH {NEAREST_SQL} SELECT id, neighbour, round(distance, 6) AS distance FROM near",
)
def _(spark, sf_dir):
    return nearest_neighbours(vectors(spark, sf_dir), "id", "x").withColumn("distance", F.round("distance", 6))


@query("hashed_nearest_neighbours")
def _(spark, sf_dir):
    found = nearest_neighbours(vectors(spark, sf_dir), "id", "x", method="hashed")
    return found.withColumn("distance", F.round("distance", 6))


@query(
    "hashed_neighbour_recall",
    f"""WITH {NEAREST_SQL} SELECT count(*) AS "rows", count(*) AS answered, 0 AS nearer_than_nearest, true AS recall_reached FROM near""",
)
def _(spark, sf_dir):
    """The hashed form against the exact one, for every row."""
    rows = vectors(spark, sf_dir)
    exact = nearest_neighbours(rows, "id", "x").select("id", F.col("distance").alias("least"))
    both = exact.join(nearest_neighbours(rows, "id", "x", method="hashed"), "id", "left")
    return both.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("distance").alias("answered"),
        F.count_if(F.col("distance") < F.col("least") * (1 - 1e-9)).cast("int").alias("nearer_than_nearest"),
        (F.avg((F.col("distance") <= F.col("least") * (1 + 1e-9)).cast("int")) >= 0.9).alias("recall_reached"),
    )


@query("mutual_neighbours", f"WITH {NEAREST_SQL} SELECT low, high FROM links")
def _(spark, sf_dir):
    return mutual_pairs(nearest_neighbours(vectors(spark, sf_dir), "id", "x")).select("low", "high")


@query("tomek_links", f"WITH {NEAREST_SQL} SELECT * FROM links WHERE low_label <> high_label")
def _(spark, sf_dir):
    return tomek_links(vectors(spark, sf_dir), "id", "x", "y")


@query(
    "class_overlap",
    f"""WITH {NEAREST_SQL}, minority AS (SELECT label FROM v GROUP BY 1 ORDER BY count(*), label LIMIT 1),
    members AS (SELECT unnest([low_label, high_label]) AS label FROM links WHERE low_label <> high_label)
    SELECT round(1 - (SELECT count(*) FROM members WHERE label <> (SELECT label FROM minority))::DOUBLE / count(*), 6)
     AS class_overlap FROM v""",
)
def _(spark, sf_dir):
    return class_overlap(vectors(spark, sf_dir), "id", "x", "y").withColumn("class_overlap", F.round("class_overlap", 6))


OVERLAP_BY_SQL = """
v AS (SELECT vec_id AS id, vec_id % 4 AS dataset, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings),
near AS (SELECT a.id, a.dataset, a.label, arg_min(b.id, (list_distance(a.x, b.x), b.id)) AS neighbour
 FROM v a JOIN v b ON a.id <> b.id AND a.dataset = b.dataset GROUP BY a.id, a.dataset, a.label),
links AS (SELECT a.dataset, a.label AS low_label, b.label AS high_label
 FROM near a JOIN near b ON a.neighbour = b.id AND b.neighbour = a.id AND a.id < b.id WHERE a.label <> b.label),
minority AS (SELECT dataset, label FROM v GROUP BY dataset, label QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY count(*), label) = 1),
members AS (SELECT dataset, unnest([low_label, high_label]) AS label FROM links),
dropped AS (SELECT m.dataset, count(*) AS n FROM members m JOIN minority y ON y.dataset = m.dataset AND y.label <> m.label GROUP BY 1)"""


@query(
    "class_overlap_by_dataset",
    f"""WITH {OVERLAP_BY_SQL} SELECT dataset, round(1 - coalesce(any_value(n), 0)::DOUBLE / count(*), 6) AS class_overlap
    FROM v LEFT JOIN dropped USING (dataset) GROUP BY dataset""",
)
def _(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("dataset", F.col("id") % 4)
    return class_overlap_by(rows, "dataset", "id", "x", "y").withColumn("class_overlap", F.round("class_overlap", 6))


@query(
    "nearest_neighbours_by_dataset",
    """WITH v AS (SELECT vec_id AS id, nullif(vec_id % 97, 5) AS dataset, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
    SELECT a.dataset, a.id, arg_min(b.id, (list_distance(a.x, b.x), b.id)) AS neighbour, round(min(list_distance(a.x, b.x)), 6) AS distance
    FROM v a JOIN v b ON a.id <> b.id AND a.dataset IS NOT DISTINCT FROM b.dataset GROUP BY a.dataset, a.id""",
)
def _(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("dataset", F.nullif(F.col("id") % 97, F.lit(5)))
    near = nearest_neighbours_by(rows, "dataset", "id", "x")
    return near.select(F.col("by").alias("dataset"), "id", "neighbour", F.round("distance", 6).alias("distance"))


#: 64 features, a few cells missing, and a dataset for each label and parity.
WIDE_SQL = """
w AS (SELECT label, vec_id % 2 AS parity, i, vec_id, CASE WHEN (vec_id + 3 * i) % 11 <> 0 THEN CAST(embedding[i + 1] AS DOUBLE) END AS v
 FROM embeddings, range(64) r(i)),
pairs AS (SELECT a.label, a.parity, a.i AS "left", b.i AS "right", corr(a.v, b.v) AS r FROM w a JOIN w b ON a.vec_id = b.vec_id AND a.i < b.i
 GROUP BY a.label, a.parity, a.i, b.i)"""
WIDE = [f"f{i}" for i in range(64)]


def wide(spark, sf_dir):
    cell = [F.when((F.col("vec_id") + 3 * i) % 11 != 0, F.col("embedding")[i].cast("double")).alias(c) for i, c in enumerate(WIDE)]
    return table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 2).alias("parity"), *cell)


@query("wide_correlations_by_dataset", f'WITH {WIDE_SQL} SELECT label, parity, "left", "right", round(r, 6) AS r FROM pairs')
def _(spark, sf_dir):
    place = F.array(*[F.struct(F.lit(i).cast("long").alias("left"), F.lit(j).cast("long").alias("right")) for i in range(64) for j in range(i + 1, 64)])
    found = correlations_by(wide(spark, sf_dir), WIDE, ["label", "parity"])
    each = found.select("label", "parity", F.posexplode("r").alias("at", "r"))
    return each.select("label", "parity", place[F.col("at")].alias("p"), F.round("r", 6).alias("r")).select("label", "parity", "p.*", "r")


@query(
    "wide_feature_correlation_by_dataset",
    f"""WITH {WIDE_SQL} SELECT label, parity, round_even(1 - 2 * sum(CASE WHEN abs(r) < 1 - 1e-12 THEN abs(r) ELSE 0 END) / 2016.0e0, 4)
    AS feature_correlation FROM pairs GROUP BY label, parity""",
)
def _(spark, sf_dir):
    return feature_correlation(wide(spark, sf_dir), WIDE, by=["label", "parity"])


@query(
    "euclidean_to_class_centre",
    """WITH cells AS (SELECT vec_id, label, unnest(range(64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
    centres AS (SELECT label, d, avg(v) AS c FROM cells GROUP BY 1, 2)
    SELECT vec_id, round(sqrt(sum((v - c) * (v - c))), 6) AS distance FROM cells JOIN centres USING (label, d) GROUP BY 1""",
)
def _(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    width = range(64)
    centres = rows.groupBy("y").agg(F.array(*[F.avg(F.col("x")[i]) for i in width]).alias("centre"))
    joined = rows.join(centres, "y")
    return joined.select(F.col("id").alias("vec_id"), F.round(euclidean(F.col("x"), F.col("centre")), 6).alias("distance"))


# class probabilities derived from the embeddings: softmax of the first entry of each class
PROBABILITY_SQL = """
e AS (SELECT vec_id AS id, label, list_transform(range(10), lambda k: exp(CAST(embedding[k + 1] AS DOUBLE) * 3
  + CASE WHEN k = label THEN 0.5e0 ELSE 0.0e0 END)) AS w FROM embeddings),
probs AS (SELECT id, label, list_transform(w, lambda x: round(x / list_sum(w), 9)) AS p FROM e),
limits AS (SELECT label, avg(p[label + 1]) AS t FROM probs GROUP BY 1),
cells AS (SELECT id, label, unnest(range(10)) AS k, unnest(p) AS v FROM probs),
guesses AS (SELECT c.id, c.label, arg_max(c.k, (c.v, -c.k)) AS guess FROM cells c JOIN limits l ON l.label = c.k
 WHERE c.v >= l.t - 1e-6 GROUP BY 1, 2),
joint AS (SELECT label, guess, count(*) AS n FROM guesses GROUP BY 1, 2),
budget AS (SELECT label, guess, CAST(floor(n / sum(n) OVER (PARTITION BY label)
  * (SELECT count(*) FROM probs q WHERE q.label = joint.label) + 0.5e0) AS BIGINT) AS take FROM joint),
ranks AS (SELECT p.id, p.label, p.p, row_number() OVER (PARTITION BY p.label, b.guess
  ORDER BY p.p[p.label + 1] - p.p[b.guess + 1], p.id) AS place, b.take
 FROM probs p JOIN budget b ON b.label = p.label AND b.guess <> p.label),
issues AS (SELECT DISTINCT id, p[label + 1] AS self_confidence FROM ranks
 WHERE place <= take AND p[label + 1] < list_max(p))"""


def _probabilities(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    weights = F.array(
        *[F.exp(F.col("x")[k] * 3 + F.when(F.col("y") == k, F.lit(0.5)).otherwise(F.lit(0.0))) for k in range(10)]
    )
    weighted = rows.select("id", F.col("y").alias("class"), weights.alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda t, v: t + v)
    scaled = weighted.select("id", "class", F.transform("w", lambda v: F.round(v / total, 9)).alias("p"))
    # a stored table, as the out-of-fold models would leave it
    return settle(scaled)


@query("confident_joint", f'WITH {PROBABILITY_SQL} SELECT label AS class, CAST(guess AS INTEGER) AS guess, n FROM joint')
def _(spark, sf_dir):
    return confident_joint(_probabilities(spark, sf_dir), 10)


@query("label_issues", f"WITH {PROBABILITY_SQL} SELECT id, self_confidence FROM issues")
def _(spark, sf_dir):
    return label_issues(_probabilities(spark, sf_dir), 10)


@query(
    "label_purity_given_probabilities",
    f"""WITH {PROBABILITY_SQL}, {NEAREST_SQL.strip()},
    members AS (SELECT unnest([low, high]) AS id FROM links WHERE low_label <> high_label)
    SELECT round_even(1 - (SELECT count(*) FROM members WHERE id IN (SELECT id FROM issues))::DOUBLE / count(*), 4) AS label_purity
    FROM embeddings""",
)
def _(spark, sf_dir):
    issues = label_issues(_probabilities(spark, sf_dir), 10)
    return label_purity(vectors(spark, sf_dir), "id", "x", "y", issues=issues)


@query("feature_relevance")
def _(spark, sf_dir):
    return feature_relevance(vectors(spark, sf_dir), "x", "y")


@query("out_of_fold_probabilities")
def _(spark, sf_dir):
    probabilities, _ = out_of_fold_probabilities(vectors(spark, sf_dir), "id", "x", "y")
    return probabilities


@query(
    "out_of_fold_facts",
    """SELECT label AS class, count(*) AS "rows", count(DISTINCT vec_id) AS ids, count(*) AS with_all_classes, count(*) AS sum_to_one
    FROM embeddings GROUP BY 1""",
)
def _(spark, sf_dir):
    """What is fixed of the probabilities: one row for every row, one probability a class, that they sum to 1."""
    rows = vectors(spark, sf_dir)
    found, classes = out_of_fold_probabilities(rows, "id", "x", "y", trees=5, depth=3)
    total = F.aggregate("p", F.lit(0.0), lambda a, b: a + b)
    facts = found.join(rows.select("id", "y"), "id").groupBy("y").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("id").alias("ids"),
        F.count_if(F.size("p") == len(classes)).alias("with_all_classes"),
        F.count_if(F.abs(total - 1) < 1e-9).alias("sum_to_one"),
    )
    return facts.withColumnRenamed("y", "class")


@query("label_purity")
def _(spark, sf_dir):
    return label_purity(settle(vectors(spark, sf_dir)), "id", "x", "y")


@query("quality_report")
def _(spark, sf_dir):
    return quality_report(matrix(spark, sf_dir), "id", FEATURES, "y")
