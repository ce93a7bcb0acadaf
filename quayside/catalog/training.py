"""Federated averaging and training, and the cost dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.catalog import views
from quayside.catalog.base import query, table
from quayside.catalog.cost import cost_rows
from quayside.operators.federated import (
    averaged_parameters,
    evaluate_global,
    federated_average,
    local_round,
    quality_messages,
    softmax_regression,
    weighted_metric,
)
from quayside.plans.dashboard import cost_dashboard, running_totals
from quayside.plans.federated_training import train
from quayside.schemas import COST_FIELDS
from quayside.session import settle
from quayside.sources.sinks import as_json, measurement_points


def _updates(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("round"),
        F.col("embedding").cast("array<double>").alias("weights"),
        (F.col("vec_id") % 5).alias("n"),
    )


AVERAGE_SQL = """SELECT label AS round, CAST(pos AS INTEGER) AS pos, round(sum(w * n) / sum(n), 6) AS value FROM (
 SELECT label, vec_id % 5 AS n, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS w FROM embeddings)
 GROUP BY 1, 2 HAVING sum(n) > 0"""


@query("federated_average", AVERAGE_SQL)
def _(spark, sf_dir):
    return averaged_parameters(_updates(spark, sf_dir), ["round"]).withColumn("value", F.round("value", 6))


@query("federated_average_arrays", AVERAGE_SQL)
def _(spark, sf_dir):
    models = federated_average(_updates(spark, sf_dir), ["round"])
    return models.select("round", F.posexplode("weights").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query(
    "weighted_performance",
    """SELECT o_custkey AS provider, round(sum(o_orderkey % 5 * (o_totalprice / 1000000.0e0)) / nullif(sum(o_orderkey % 5), 0), 6)
     AS performance FROM orders GROUP BY 1""",
)
def _(spark, sf_dir):
    reports = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("provider"),
        (F.col("o_totalprice") / 1000000.0).alias("performance"),
        (F.col("o_orderkey") % 5).alias("n"),
    )
    return weighted_metric(reports, ["provider"], "performance").withColumn("performance", F.round("performance", 6))


def _shards(spark, sf_dir):
    return views.vectors(spark, sf_dir).select(
        F.concat(F.lit("p"), (F.col("id") % 4).cast("string")).alias("provider"), "x", "y"
    )


# at zero weights every class has probability 1/10, so the first step is a plain sum over rows
FIRST_STEP_SQL = """
cells AS (SELECT vec_id % 4 AS provider, label, unnest(range(65)) AS d,
  unnest(list_append(CAST(embedding AS DOUBLE[]), 1.0e0)) AS v FROM embeddings),
sizes AS (SELECT vec_id % 4 AS provider, count(*) AS n FROM embeddings GROUP BY 1),
classes AS (SELECT unnest(range(10)) AS k)"""


@query(
    "local_training_step",
    f"""WITH {FIRST_STEP_SQL}
    SELECT concat('p', CAST(c.provider AS VARCHAR)) AS provider, s.n, CAST(c.d * 10 + k.k AS INTEGER) AS pos,
     round(-0.5e0 * sum(c.v * (0.1e0 - CASE WHEN c.label = k.k THEN 1.0e0 ELSE 0.0e0 END)) / s.n, 6) + 0.0e0 AS weight
    FROM cells c CROSS JOIN classes k JOIN sizes s ON s.provider = c.provider GROUP BY c.provider, s.n, c.d, k.k""",
)
def _(spark, sf_dir):
    model = softmax_regression(64, 10)
    updates = local_round(_shards(spark, sf_dir), model.initial(), model)
    weights = updates.select("provider", "n", F.posexplode("weights").alias("pos", "weight"))
    return weights.withColumn("weight", F.round("weight", 6) + 0.0)


@query(
    "first_training_round",
    f"""WITH {FIRST_STEP_SQL}
    SELECT CAST(c.d * 10 + k.k AS INTEGER) AS pos,
     round(-0.5e0 * sum(c.v * (0.1e0 - CASE WHEN c.label = k.k THEN 1.0e0 ELSE 0.0e0 END)) / (SELECT count(*) FROM embeddings), 6)
      + 0.0e0 AS weight
    FROM cells c CROSS JOIN classes k GROUP BY c.d, k.k""",
)
def _(spark, sf_dir):
    model = softmax_regression(64, 10)
    updates = settle(local_round(_shards(spark, sf_dir), model.initial(), model)).withColumn("round", F.lit(1))
    averaged = averaged_parameters(updates, ["round"])
    return averaged.select("pos", (F.round("value", 6) + 0.0).alias("weight"))


@query("federated_training")
def _(spark, sf_dir):
    shards = _shards(spark, sf_dir)
    done = train(shards, softmax_regression(64, 10), rounds=3, epochs=2, held_out=shards.select("x", "y"))
    return done.history.drop("train_duration")


@query(
    "federated_training_facts",
    """WITH rounds AS (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS round)
    SELECT round, concat('p', CAST(vec_id % 4 AS VARCHAR)) AS provider, count(*) AS n, true AS better_after_training, true AS finite
    FROM embeddings CROSS JOIN rounds GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    """What is fixed of three rounds: every provider's rows in each, that training lowers its loss, that nothing diverges."""
    done = train(_shards(spark, sf_dir), softmax_regression(64, 10, rate=0.1), rounds=3)
    losses = ("pre_loss", "post_loss", "pre_performance", "post_performance")
    finite = F.lit(True)
    for name in losses:
        finite &= F.col(name).isNotNull() & (F.abs(name) < 1e6)
    better = (F.col("post_loss") < F.col("pre_loss")).alias("better_after_training")
    return done.history.select("round", "provider", "n", better, finite.alias("finite"))


@query(
    "tester_evaluation",
    """SELECT count(*) AS n, round(avg(CASE WHEN label = 0 THEN 1.0e0 ELSE 0.0e0 END), 6) AS test_performance,
     round(ln(10.0e0), 6) AS test_loss FROM embeddings""",
)
def _(spark, sf_dir):
    model = softmax_regression(64, 10)
    scores = evaluate_global(_shards(spark, sf_dir), model.initial(), model)
    return scores.withColumns({c: F.round(c, 6) for c in ("test_performance", "test_loss")})


@query(
    "training_report_messages",
    """SELECT concat('p', CAST(vec_id % 4 AS VARCHAR)) AS edge_id, 'demo' AS model_id, CAST(1 AS INTEGER) AS train_round,
     round(avg(CASE WHEN label = 0 THEN 1.0e0 ELSE 0.0e0 END), 6) AS pre_train_performance,
     round(ln(10.0e0), 6) AS pre_loss_value FROM embeddings GROUP BY 1""",
)
def _(spark, sf_dir):
    from quayside.operators.rounds import flatten_messages

    model = softmax_regression(64, 10)
    updates = local_round(_shards(spark, sf_dir), model.initial(), model)
    nested = quality_messages(updates, "demo", "1", 1).select(F.struct("*").alias("message"))
    return flatten_messages(nested).select(
        "edge_id",
        "model_id",
        "train_round",
        F.round("quality_of_model.pre_train_performance", 6).alias("pre_train_performance"),
        F.round("quality_of_model.pre_loss_value", 6).alias("pre_loss_value"),
    )


# --- dashboard -------------------------------------------------------------------------------

POINTS_SQL = f"""{views.ROUNDS_SQL},
points AS (
 UNPIVOT (SELECT model_id AS measurement, dataset_id, run_id, printf('%03d', train_round) AS task_id, "timestamp" AS "time",
  {", ".join(COST_FIELDS)} FROM round_cost) ON {", ".join(COST_FIELDS)} INTO NAME field VALUE value)"""


def _points(spark, sf_dir):
    return measurement_points(settle(cost_rows(spark, sf_dir)))


@query(
    "cost_points",
    f'WITH {POINTS_SQL} SELECT measurement, dataset_id, run_id, task_id, "time", field, value FROM points',
)
def _(spark, sf_dir):
    return _points(spark, sf_dir).filter(F.col("value").isNotNull())


RUNNING_SQL = f"""{POINTS_SQL},
running AS (SELECT measurement, dataset_id, run_id, task_id, "time", field,
  sum(value) OVER (PARTITION BY measurement, dataset_id, run_id, field ORDER BY "time", task_id ROWS UNBOUNDED PRECEDING) AS value
 FROM points WHERE field IN ('cost_resource', 'cost_qom'))"""


@query(
    "running_cost_totals",
    f"""WITH {RUNNING_SQL} SELECT measurement, dataset_id, run_id, task_id, "time", field, round(value, 6) AS value FROM running""",
)
def _(spark, sf_dir):
    points = _points(spark, sf_dir).filter(F.col("value").isNotNull())
    return running_totals(points).withColumn("value", F.round("value", 6))


DASHBOARD_SQL = f"""WITH {RUNNING_SQL}, shown AS (SELECT * FROM running UNION ALL BY NAME
      SELECT * FROM points WHERE field IN ('cost_qod', 'cost_context'))
    SELECT measurement, dataset_id, run_id, task_id, "time", round(max(value) FILTER (field = 'cost_context')
      + max(value) FILTER (field = 'cost_qod') + max(value) FILTER (field = 'cost_qom')
      + max(value) FILTER (field = 'cost_resource'), 6) AS total_cost FROM shown GROUP BY ALL"""


@query("cost_dashboard", DASHBOARD_SQL)
def _(spark, sf_dir):
    points = _points(spark, sf_dir).filter(F.col("value").isNotNull())
    return cost_dashboard(points).withColumn("total_cost", F.round("total_cost", 6))


@query(
    "cost_records_as_json",
    f"""WITH {views.ROUNDS_SQL} SELECT model_id, dataset_id, train_round, cost_qod, performance_post FROM round_cost""",
)
def _(spark, sf_dir):
    from quayside.schemas import ROUND_COST

    text = as_json(cost_rows(spark, sf_dir))
    return text.select(F.from_json("value", ROUND_COST).alias("r")).select(
        "r.model_id", "r.dataset_id", "r.train_round", "r.cost_qod", "r.performance_post"
    )
