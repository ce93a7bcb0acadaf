"""Round cost queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.catalog import views
from quayside.catalog.base import query, table
from quayside.functions.pricing import STANDARD_COSTS, quality_cost, resource_cost, total_cost
from quayside.operators.ordered import Scan, ordered_scan
from quayside.operators.rounds import decode_messages, flatten_messages, fold_rounds, price_rounds, running_peaks
from quayside.plans.round_cost import round_cost
from quayside.schemas import COST_FIELDS, ROUND_KEYS
from quayside.sources.readers import normalise_messages


# no sums are involved in a cost, so both engines produce the same doubles and nothing is rounded
COST_ROW_SQL = f'model_id, run_id, dataset_id, train_round, "timestamp", edge_id, {", ".join(COST_FIELDS)}'


def cost_rows(spark, sf_dir):
    return round_cost(views.messages(spark, sf_dir), views.prices(spark, sf_dir), views.MESSAGE_ORDER)


@query("round_cost", f"WITH {views.ROUNDS_SQL} SELECT {COST_ROW_SQL} FROM round_cost")
def _(spark, sf_dir):
    return cost_rows(spark, sf_dir)


@query(
    "round_fold",
    f"""WITH {views.ROUNDS_SQL}
    SELECT f.model_id, f.run_id, f.dataset_id, f.train_round, f."timestamp", f.edge_id, f.msg_count,
     f.last_pos IS NOT NULL AS done, c.peak_cpu AS peak_cpu, c.peak_memory AS peak_memory
    FROM folded f LEFT JOIN closing c ON c.model_id = f.model_id AND c.run_id = f.run_id
     AND c.dataset_id = f.dataset_id AND c.train_round = f.train_round""",
)
def _(spark, sf_dir):
    return fold_rounds(views.messages(spark, sf_dir), views.MESSAGE_ORDER).select(
        *ROUND_KEYS,
        "timestamp",
        "edge_id",
        "msg_count",
        "done",
        F.col("closing.peak_cpu").alias("peak_cpu"),
        F.col("closing.peak_memory").alias("peak_memory"),
    )


@query(
    "message_price_join",
    f"""WITH {views.MESSAGES_SQL}, {views.PRICES_SQL}
    SELECT m.event_id, m.model_id, m.dataset_id, p.qom_cost_function, p.performance, p.memory,
     p.cost_quantity_quality, p.model_id IS NOT NULL AS price_found
    FROM messages m LEFT JOIN prices p ON p.model_id = m.model_id AND p.dataset_id = m.dataset_id""",
)
def _(spark, sf_dir):
    priced = views.messages(spark, sf_dir).join(
        views.prices(spark, sf_dir).withColumn("listed", F.lit(True)), ["model_id", "dataset_id"], "left"
    )
    return priced.select(
        "event_id",
        "model_id",
        "dataset_id",
        "qom_cost_function",
        F.col("qom_base_cost.performance").alias("performance"),
        F.col("resource_base_cost.memory").alias("memory"),
        "cost_quantity_quality",
        F.coalesce("listed", F.lit(False)).alias("price_found"),
    )


@query(
    "closed_round_filter",
    f"""WITH {views.ROUNDS_SQL}
    SELECT model_id, dataset_id, train_round, msg_count FROM folded WHERE last_pos IS NOT NULL""",
)
def _(spark, sf_dir):
    folded = fold_rounds(views.messages(spark, sf_dir), views.MESSAGE_ORDER)
    return folded.filter("done").select("model_id", "dataset_id", "train_round", "msg_count")


@query(
    "price_match_flag",
    f"WITH {views.ROUNDS_SQL} SELECT model_id, dataset_id, train_round, price_found FROM round_cost",
)
def _(spark, sf_dir):
    folded = fold_rounds(views.messages(spark, sf_dir), views.MESSAGE_ORDER)
    priced = price_rounds(folded, views.prices(spark, sf_dir))
    return priced.filter("done").select("model_id", "dataset_id", "train_round", "price_found")


def _nested(spark, sf_dir):
    meta = F.struct(
        F.col("edge_id").alias("name"),
        "run_id",
        F.col("dataset_id").alias("functionality"),
        F.col("model_id").alias("application_name"),
    )
    report = F.struct("train_round", "quality_of_model", "resource_monitor")
    return views.messages(spark, sf_dir).select(
        "event_id",
        F.struct(
            meta.alias("metadata"),
            F.unix_seconds(F.col("timestamp").cast("timestamp")).alias("timestamp"),
            report.alias("report"),
        ).alias("raw"),
    )


@query(
    "message_flatten",
    f"""WITH {views.MESSAGES_SQL}
    SELECT event_id, model_id, run_id, dataset_id, edge_id, epoch(date_trunc('second', ts))::BIGINT AS "timestamp", train_round,
     pre_perf AS pre_train_performance, cpu_percentage AS cpu_percentage
    FROM messages""",
)
def _(spark, sf_dir):
    nested = _nested(spark, sf_dir).select("event_id", F.col("raw").alias("message"))
    return flatten_messages(nested, keep=["event_id"]).select(
        "event_id",
        "model_id",
        "run_id",
        "dataset_id",
        "edge_id",
        "timestamp",
        "train_round",
        F.col("quality_of_model.pre_train_performance").alias("pre_train_performance"),
        F.col("resource_monitor.cpu_percentage").alias("cpu_percentage"),
    )


@query(
    "queued_message_decode",
    f"""WITH {views.MESSAGES_SQL}
    SELECT event_id, model_id, edge_id, dataset_id, train_round, epoch(date_trunc('second', ts))::BIGINT AS seconds,
     duration AS train_duration, cpu_percentage FROM messages""",
)
def _(spark, sf_dir):
    nested = _nested(spark, sf_dir)
    # as it leaves the queue: single quotes, epoch seconds
    queued = nested.select("event_id", F.translate(F.to_json("raw"), '"', "'").alias("value"))
    stream = normalise_messages(queued, nested.schema["raw"].dataType)
    flat = flatten_messages(decode_messages(stream), keep=["event_id"])
    return flat.select(
        "event_id",
        "model_id",
        "edge_id",
        "dataset_id",
        "train_round",
        F.unix_seconds("timestamp").alias("seconds"),
        "quality_of_model.train_duration",
        "resource_monitor.cpu_percentage",
    )


@query(
    "running_resource_peak",
    f"""WITH {views.ROUNDS_SQL}
    SELECT event_id, peak_cpu AS peak_cpu, peak_memory AS peak_memory FROM seen""",
)
def _(spark, sf_dir):
    peaks = running_peaks(views.messages(spark, sf_dir), views.MESSAGE_ORDER)
    return peaks.select(
        "event_id", F.col("peak_cpu").alias("peak_cpu"), F.col("peak_memory").alias("peak_memory")
    )


@query(
    "running_first_and_latest",
    f"""WITH {views.MESSAGES_SQL}
    SELECT event_id, first_value(edge_id) OVER w AS first_edge, max(ts) OVER w AS latest,
     first_value(nullif(duration, 0.0e0) IGNORE NULLS) OVER w AS first_duration
    FROM messages WINDOW w AS (PARTITION BY model_id, run_id, train_round ORDER BY ts, event_id
     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def _(spark, sf_dir):
    scans = {
        "first_edge": Scan("first", F.col("edge_id")),
        "latest": Scan("max", F.col("timestamp")),
        "first_duration": Scan("first", F.nullif(F.col("quality_of_model.train_duration"), F.lit(0.0))),
    }
    keys = ["model_id", "run_id", "train_round"]
    seen = ordered_scan(views.messages(spark, sf_dir), keys, views.MESSAGE_ORDER, scans)
    return seen.select("event_id", *scans)


@query(
    "quality_cost_function",
    f"""WITH {views.MESSAGES_SQL}
    SELECT event_id, greatest(0.0e0, 23.5e0 * (post_perf - pre_perf) * pre_perf) AS cost_qom,
     post_perf - pre_perf AS improvement_diff
    FROM messages WHERE is_quality""",
)
def _(spark, sf_dir):
    quality = views.messages(spark, sf_dir).filter(F.col("quality_of_model").isNotNull())
    pre, post = F.col("quality_of_model.pre_train_performance"), F.col("quality_of_model.post_train_performance")
    return quality.select(
        "event_id",
        quality_cost(F.lit(23.5), pre, post).alias("cost_qom"),
        (post - pre).alias("improvement_diff"),
    )


@query(
    "resource_cost_function",
    """SELECT l_orderkey, l_linenumber,
     0.02e0 * (l_extendedprice / 60.0e0) *
      (0.02e0 * l_quantity + coalesce(nullif(l_tax, 0.0e0), 0.0e0) * (l_discount * 512.0e0)) AS cost_resource
    FROM lineitem""",
)
def _(spark, sf_dir):
    cost = resource_cost(
        F.lit(0.02),
        F.col("l_extendedprice") / 60.0,
        F.lit(0.02),
        F.col("l_quantity"),
        F.nullif("l_tax", F.lit(0.0)),
        F.col("l_discount") * 512.0,
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", cost.alias("cost_resource")
    )


@query(
    "cost_function_by_name",
    """SELECT o_orderkey, CASE o_orderpriority
      WHEN '1-URGENT' THEN greatest(0.0e0, 23.5e0 * (0.9e0 - 0.5e0) * 0.5e0)
      WHEN '2-HIGH' THEN 0.02e0 * (o_totalprice / 60.0e0) * (0.02e0 * 150.0e0 + 0.003e0 * 512.0e0)
      WHEN '3-MEDIUM' THEN o_totalprice * 0.05e0 END AS cost
    FROM orders""",
)
def _(spark, sf_dir):
    qom, resource = STANDARD_COSTS.names
    costs = STANDARD_COSTS.register("flat_share", lambda a: a["price"] * 0.05)
    name = (
        F.when(F.col("o_orderpriority") == "1-URGENT", qom)
        .when(F.col("o_orderpriority") == "2-HIGH", resource)
        .when(F.col("o_orderpriority") == "3-MEDIUM", "flat_share")
        .otherwise("unknown")
    )
    arguments = {
        "performance_price": F.lit(23.5),
        "pre": F.lit(0.5),
        "post": F.lit(0.9),
        "by_minute": F.lit(0.02),
        "minutes": F.col("o_totalprice") / 60.0,
        "cpu_price": F.lit(0.02),
        "cpu": F.lit(150.0),
        "memory_price": F.lit(0.003),
        "memory_mb": F.lit(512.0),
        "price": F.col("o_totalprice"),
    }
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", costs.choose(name, arguments).alias("cost"))


@query(
    "round_total_cost",
    f"""WITH {views.ROUNDS_SQL}
    SELECT model_id, dataset_id, train_round,
     cost_context + cost_qod + cost_qom + cost_resource AS total_cost FROM round_cost""",
)
def _(spark, sf_dir):
    parts = [F.col(c) for c in ("cost_context", "cost_qod", "cost_qom", "cost_resource")]
    return cost_rows(spark, sf_dir).select(
        "model_id", "dataset_id", "train_round", total_cost(*parts).alias("total_cost")
    )
