"""Streaming queries: each drains the tables as a stream, stores the output, and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.catalog import cost, training, views
from quayside.catalog.base import query, table
from quayside.operators.rounds import closed_rounds, fold_rounds, price_rounds
from quayside.schemas import ROUND_KEYS
from quayside.session import scratch, settle
from quayside.plans.dashboard import cost_dashboard
from quayside.sources.sinks import append_batch, measurement_points
from quayside.streaming.costs import current_folds, drain, fold_writer, folded_costs, stored_folds
from quayside.streaming.live_dashboard import live_dashboard, shown_dashboard
from quayside.streaming.liveness import transitions
from quayside.streaming.monitoring import gate_writer, online_spells, stored_samples
from quayside.streaming.round_state import keyed_rounds, resumed_rounds
from quayside.streaming.sources import configure_streams, table_stream


def _event_stream(spark, sf_dir):
    configure_streams(spark)
    schema = table(spark, sf_dir, "events").schema
    return table_stream(spark, sf_dir, schema, pattern="events.parquet")


def _cost_stream(spark, sf_dir):
    messages = views.messages_of(_event_stream(spark, sf_dir))
    return folded_costs(messages, views.prices(spark, sf_dir), scratch(spark, "folds"), scratch(spark, "log"), views.MESSAGE_ORDER)


@query("round_cost_stream", f"WITH {views.ROUNDS_SQL} SELECT {cost.COST_ROW_SQL} FROM round_cost")
def _(spark, sf_dir):
    rows = _cost_stream(spark, sf_dir)
    return rows.select(*ROUND_KEYS, F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "edge_id", *cost.COST_FIELDS)


@query("round_cost_from_batch_folds", f"WITH {views.ROUNDS_SQL} SELECT {cost.COST_ROW_SQL} FROM round_cost")
def _(spark, sf_dir):
    path = scratch(spark, "folds")
    messages = views.messages_of(_event_stream(spark, sf_dir))
    drain(messages, fold_writer(path, views.MESSAGE_ORDER), scratch(spark, "log"), "append")
    return closed_rounds(price_rounds(stored_folds(spark.read.parquet(path)), views.prices(spark, sf_dir)))


@query("round_cost_keyed_state", f"WITH {views.ROUNDS_SQL} SELECT {cost.COST_ROW_SQL} FROM round_cost")
def _(spark, sf_dir):
    """Keyed state over the later half of the events; the fold of the earlier half is its initial state."""
    path, events = scratch(spark, "keyed-rounds"), table(spark, sf_dir, "events")
    middle = F.lit(events.agg(F.percentile_approx("ts", 0.5)).first()[0])
    folds = settle(fold_rounds(views.messages_of(events.filter(F.col("ts") < middle)), views.MESSAGE_ORDER))
    later = views.messages_of(_event_stream(spark, sf_dir).filter(F.col("ts") >= middle))
    drain(keyed_rounds(later, views.MESSAGE_ORDER, initial=folds), append_batch(path), scratch(spark, "log"))
    rows = closed_rounds(price_rounds(resumed_rounds(spark.read.parquet(path), folds), views.prices(spark, sf_dir)))
    return rows.select(*ROUND_KEYS, F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "edge_id", *cost.COST_FIELDS)


@query(
    "edge_transitions_stream",
    """WITH marked AS (SELECT user_id, ts, coalesce(ts > lag(ts) OVER w + INTERVAL 600 SECONDS, true) AS opens,
      coalesce(lead(ts) OVER w > ts + INTERVAL 600 SECONDS, true) AS closes FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    told AS (SELECT user_id AS edge_id, 'online' AS status, date_trunc('milliseconds', ts) AS "at" FROM marked WHERE opens
      UNION ALL SELECT user_id, 'offline', date_trunc('milliseconds', ts) + INTERVAL 600 SECONDS FROM marked WHERE closes)
    SELECT * FROM told WHERE "at" <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 600 SECONDS FROM events)""",
)
def _(spark, sf_dir):
    beats = _event_stream(spark, sf_dir).select(F.col("user_id").alias("edge_id"), F.col("ts").cast("timestamp").alias("arrived"))
    path = scratch(spark, "transitions")
    drain(transitions(beats), append_batch(path), scratch(spark, "log"), "append", empty_batches=True)
    return spark.read.parquet(path).select("edge_id", "status", F.col("at").cast("timestamp_ntz").alias("at"))


@query("cost_dashboard_stream", training.DASHBOARD_SQL)
def _(spark, sf_dir):
    points = measurement_points(_cost_stream(spark, sf_dir)).filter("value IS NOT NULL")
    board = cost_dashboard(points.select("measurement", "dataset_id", "run_id", "task_id", "time", "field", "value"))
    return board.withColumns(
        {"time": F.col("time").cast("timestamp_ntz"), "total_cost": F.round("total_cost", 6)}
    )


@query("round_cost_from_compacted_folds", f"WITH {views.ROUNDS_SQL} SELECT {cost.COST_ROW_SQL} FROM round_cost")
def _(spark, sf_dir):
    """Ten batches in event order, merged into a base every third batch."""
    path, events = scratch(spark, "folds"), table(spark, sf_dir, "events")
    cuts = [F.lit(c) for c in events.agg(F.percentile_approx("ts", [i / 10 for i in range(1, 10)])).first()[0]]
    number = sum((F.when(F.col("ts") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    write = fold_writer(path, views.MESSAGE_ORDER, compact_every=3)
    for batch in range(10):
        write(views.messages_of(events.filter(number == batch)), batch)
    return closed_rounds(price_rounds(stored_folds(current_folds(spark, path)), views.prices(spark, sf_dir))).select(
        *ROUND_KEYS, F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "edge_id", *cost.COST_FIELDS
    )


@query("cost_dashboard_live", training.DASHBOARD_SQL)
def _(spark, sf_dir):
    """Cost records arrive in six files in no order of time, so most points come late."""
    configure_streams(spark)
    source, path = scratch(spark, "cost-records"), scratch(spark, "dashboard")
    records = cost.cost_rows(spark, sf_dir).withColumn("version", F.lit(0)).withColumn("part", F.pmod(F.xxhash64(*ROUND_KEYS), F.lit(6)))
    records.repartition(6, "part").drop("part").write.parquet(source)
    stream = table_stream(spark, source, spark.read.parquet(source).schema, files_per_batch=2)
    drain(live_dashboard(stream), append_batch(path), scratch(spark, "log"))
    board = shown_dashboard(spark.read.parquet(path))
    return board.withColumns({"time": F.col("time").cast("timestamp_ntz"), "total_cost": F.round("total_cost", 6)})


@query(
    "online_spells_stream",
    """WITH marked AS (SELECT user_id, ts, coalesce(ts > lag(ts) OVER w + INTERVAL 600 SECONDS, true) AS fresh_start FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    spells AS (SELECT user_id, ts, sum(CAST(fresh_start AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS spell FROM marked)
    SELECT user_id AS edge_id, min(ts) AS "from", max(ts) + INTERVAL 600 SECONDS AS until, count(*) AS beats
    FROM spells GROUP BY user_id, spell""",
)
def _(spark, sf_dir):
    beats = _event_stream(spark, sf_dir).select(
        F.col("user_id").alias("edge_id"), F.col("ts").cast("timestamp").alias("arrived")
    )
    path = scratch(spark, "spells")
    drain(online_spells(beats), append_batch(path), scratch(spark, "log"), "complete")
    # in complete mode the last batch holds every spell
    written = spark.read.parquet(path)
    last = written.agg(F.max("batch").alias("b")).scalar()
    return written.filter(F.col("batch") == last).select(
        "edge_id", F.col("from").cast("timestamp_ntz").alias("from"), F.col("until").cast("timestamp_ntz").alias("until"), "beats"
    )


@query(
    "round_gated_samples_stream",
    """WITH markers AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'signup' THEN 'start' ELSE 'end' END AS status,
      CAST(day(ts) AS INTEGER) AS train_round FROM events WHERE event_type IN ('signup', 'purchase')),
    samples AS (SELECT * FROM events WHERE event_type NOT IN ('signup', 'purchase'))
    SELECT CAST(s.user_id AS VARCHAR) AS edge_id, s.ts AS "timestamp", s.value, m.train_round
    FROM samples s ASOF JOIN markers m ON m.user_id = s.user_id AND m.ts <= s.ts
    WHERE m.status = 'start'""",
)
def _(spark, sf_dir):
    marker = F.col("event_type").isin("signup", "purchase")
    rows = _event_stream(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("edge_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        "value",
        F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "end").alias("status"),
        F.when(marker, F.dayofmonth("ts")).alias("train_round"),
    )
    path = scratch(spark, "gated")
    drain(rows, gate_writer(path), scratch(spark, "log"), "append")
    return stored_samples(spark, path).select(
        "edge_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "value", "train_round"
    )
