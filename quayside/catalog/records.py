"""Registry, request log and monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.catalog.base import query, table
from quayside.functions.pricing import bytes_to_mb
from quayside.operators.monitor import counter_rates, gate_by_round
from quayside.operators.ordered import Scan, ordered_scan, ranked
from quayside.operators.records import (
    clashing_keys,
    container_status,
    deleted,
    deleted_count,
    fresh,
    insert_if_absent,
    latest_per_key,
    newest_first,
    pending,
    per_dataset_configs,
    request_results,
    request_status,
    updated,
    with_request_id,
)


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query(
    "latest_record_per_key",
    """SELECT user_id, ts, event_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def _(spark, sf_dir):
    records = _events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type", "value")
    return latest_per_key(records, ["user_id"], ["ts", "event_id"])


@query(
    "fresh_heartbeats",
    """SELECT user_id AS edge_id, max(ts) AS seen FROM events
    WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 600 SECONDS GROUP BY 1""",
)
def _(spark, sf_dir):
    beats = _events(spark, sf_dir).select(F.col("user_id").alias("edge_id"), F.col("ts").alias("seen"))
    as_of = beats.agg(F.max("seen").alias("t")).scalar()
    return latest_per_key(fresh(beats, "seen", as_of), ["edge_id"], ["seen"])


@query(
    "provider_online",
    """SELECT user_id AS edge_id, max(ts) AS seen,
     max(ts) > (SELECT max(ts) FROM events) - INTERVAL 86400 SECONDS AS online FROM events GROUP BY 1""",
)
def _(spark, sf_dir):
    beats = _events(spark, sf_dir).select(F.col("user_id").alias("edge_id"), F.col("ts").alias("seen"))
    latest = latest_per_key(beats, ["edge_id"], ["seen"])
    as_of = beats.agg(F.max("seen").alias("t")).scalar()
    return latest.withColumn("online", F.col("seen") > as_of - F.expr("interval 86400 seconds"))


@query(
    "records_newest_first",
    """SELECT o_custkey AS owner, o_orderkey,
     row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders""",
)
def _(spark, sf_dir):
    records = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("owner"),
        "o_orderkey",
        (-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("age"),
    )
    return ranked(records, ["owner"], ["age", "o_orderkey"], "place").drop("age")


@query(
    "listing_by_owner_segment",
    "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'",
)
def _(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return newest_first(customers, "c_acctbal", F.col("c_mktsegment") == "BUILDING", ["c_custkey"]).select(
        "c_custkey", "c_name", "c_acctbal"
    )


def _keyed_suppliers(spark, sf_dir, shift=0):
    return table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + shift).alias("edge_id"), F.col("s_name").alias("name")
    )


def _edges(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("edge_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")
    )


@query(
    "insert_if_absent",
    """SELECT 'clean' AS batch, s_suppkey + 10000000 AS edge_id, s_name AS name FROM supplier
    WHERE NOT EXISTS (SELECT 1 FROM supplier s JOIN customer c ON c.c_custkey = s.s_suppkey + 10000000)
    UNION ALL SELECT 'clashing', s_suppkey, s_name FROM supplier
    WHERE NOT EXISTS (SELECT 1 FROM supplier s JOIN customer c ON c.c_custkey = s.s_suppkey)""",
)
def _(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    clean = insert_if_absent(edges, _keyed_suppliers(spark, sf_dir, 10000000), "edge_id")
    clashing = insert_if_absent(edges, _keyed_suppliers(spark, sf_dir), "edge_id")
    return clean.select(F.lit("clean").alias("batch"), "*").unionByName(
        clashing.select(F.lit("clashing").alias("batch"), "*")
    )


@query("clashing_keys", "SELECT s_suppkey AS edge_id FROM supplier JOIN customer ON c_custkey = s_suppkey")
def _(spark, sf_dir):
    return clashing_keys(_edges(spark, sf_dir), _keyed_suppliers(spark, sf_dir), "edge_id")


@query(
    "partial_update",
    """SELECT c_custkey AS edge_id, coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN s_name END, c_name) AS name,
     coalesce(s_acctbal, c_acctbal) AS balance FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""",
)
def _(spark, sf_dir):
    changes = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("edge_id"),
        F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("name"),
        F.col("s_acctbal").alias("balance"),
    )
    return updated(_edges(spark, sf_dir), changes, "edge_id")


@query(
    "partial_updates_in_order",
    """SELECT c_custkey AS edge_id, coalesce(n, c_name) AS name, coalesce(b, c_acctbal) AS balance
     FROM customer LEFT JOIN (
       SELECT o_custkey, last(o_orderpriority ORDER BY o_orderdate, o_orderkey) FILTER (WHERE o_orderkey % 3 <> 0) AS n,
              last(o_totalprice ORDER BY o_orderdate, o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS b
       FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""",
)
def _(spark, sf_dir):
    changes = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("edge_id"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("name"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("balance"),
        "o_orderdate",
        "o_orderkey",
    )
    return updated(_edges(spark, sf_dir), changes, "edge_id", order=["o_orderdate", "o_orderkey"])


@query(
    "delete_by_key",
    """SELECT c_custkey AS edge_id, c_name AS name FROM customer
    WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""",
)
def _(spark, sf_dir):
    keys = _keyed_suppliers(spark, sf_dir).select("edge_id")
    return deleted(_edges(spark, sf_dir), keys, "edge_id").select("edge_id", "name")


@query(
    "deleted_count",
    "SELECT count(*) AS deleted FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier)",
)
def _(spark, sf_dir):
    return deleted_count(_edges(spark, sf_dir), _keyed_suppliers(spark, sf_dir).select("edge_id"), "edge_id")


@query(
    "pending_responders",
    """SELECT DISTINCT l_orderkey AS request_id, l_suppkey AS edge_id FROM lineitem l
    WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_orderkey = l.l_orderkey AND r.l_suppkey = l.l_suppkey
     AND r.l_returnflag <> 'N')""",
)
def _(spark, sf_dir):
    sent = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request_id"), F.col("l_suppkey").alias("edge_id"), "l_returnflag"
    )
    return pending(sent.select("request_id", "edge_id").distinct(), sent.filter("l_returnflag <> 'N'"))


@query(
    "per_dataset_configs",
    """SELECT o_orderkey AS request_id, o_custkey AS consumer_id, dataset_id, edge_id FROM (
     SELECT o_orderkey, o_custkey, unnest(['d1', 'd2', o_orderstatus]) AS dataset_id,
      unnest([o_custkey % 7, o_custkey % 11, o_custkey % 13]) AS edge_id FROM orders)""",
)
def _(spark, sf_dir):
    def dataset(name, edge):
        return F.struct(name.alias("dataset_id"), edge.alias("edge_id"))

    owner = F.col("o_custkey")
    requests = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        owner.alias("consumer_id"),
        F.array(
            dataset(F.lit("d1"), owner % 7),
            dataset(F.lit("d2"), owner % 11),
            dataset(F.col("o_orderstatus"), owner % 13),
        ).alias("datasets"),
    )
    return per_dataset_configs(requests)


LOG_SQL = """
log AS (
 SELECT event_id, user_id * 100 + day(ts) AS request_id, ts AS moment,
  CASE event_type WHEN 'signup' THEN 'init' WHEN 'purchase' THEN 'qod_report' WHEN 'error' THEN 'service'
   ELSE 'response' END AS kind,
  CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS code, event_id % 7 AS edge_id
 FROM events)"""


def _log(spark, sf_dir):
    kind = (
        F.when(F.col("event_type") == "signup", "init")
        .when(F.col("event_type") == "purchase", "qod_report")
        .when(F.col("event_type") == "error", "service")
        .otherwise("response")
    )
    return _events(spark, sf_dir).select(
        "event_id",
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("request_id"),
        F.col("ts").alias("at"),
        kind.alias("kind"),
        F.when(F.col("event_id") % 10 == 0, 1).otherwise(0).alias("code"),
        (F.col("event_id") % 7).alias("edge_id"),
    )


@query(
    "request_status",
    f"""WITH {LOG_SQL}
    SELECT request_id, arg_max(CASE WHEN kind = 'init' THEN 'initializing' WHEN code <> 0 THEN 'error'
      WHEN kind = 'response' THEN 'started' ELSE 'finished' END, (moment, event_id)) AS status,
     min(moment) FILTER (kind = 'init') AS init_at, max(moment) FILTER (kind = 'response') AS start_at,
     max(moment) FILTER (kind IN ('qod_report', 'service')) AS finish_at,
     count(*) FILTER (kind = 'response') AS results, count(*) FILTER (kind = 'qod_report') AS reports
    FROM log GROUP BY request_id""",
)
def _(spark, sf_dir):
    return request_status(_log(spark, sf_dir), ["at", "event_id"])


@query(
    "request_results",
    f"""WITH {LOG_SQL}
    SELECT request_id, event_id, edge_id, code,
     row_number() OVER (PARTITION BY request_id ORDER BY moment, event_id) AS place FROM log WHERE kind = 'response'""",
)
def _(spark, sf_dir):
    results = request_results(_log(spark, sf_dir), ["at", "event_id"])
    return results.select("request_id", "event_id", "edge_id", "code", "place")


@query(
    "request_log_by_model",
    """SELECT o_orderkey AS request_id, o_custkey AS model_id FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""",
)
def _(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.struct(F.col("o_custkey").alias("model_id")).alias("content")
    )
    models = table(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY'").select("c_custkey")
    return log.join(models, F.col("content.model_id") == F.col("c_custkey"), "left_semi").select(
        "request_id", "content.model_id"
    )


@query(
    "container_status",
    f"""WITH {LOG_SQL}
    SELECT request_id, CAST(sum(code) AS BIGINT) AS status, count(*) AS containers FROM log GROUP BY 1""",
)
def _(spark, sf_dir):
    return container_status(_log(spark, sf_dir))


@query("distinct_labels", "SELECT DISTINCT o_orderstatus AS label FROM orders")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("label")).distinct()


@query(
    "round_gated_samples",
    """WITH markers AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'signup' THEN 'start' ELSE 'end' END AS status,
      CAST(day(ts) AS INTEGER) AS train_round FROM events WHERE event_type IN ('signup', 'purchase')),
    samples AS (SELECT * FROM events WHERE event_type NOT IN ('signup', 'purchase'))
    SELECT s.event_id, s.user_id AS edge_id, s.value, m.train_round
    FROM samples s ASOF JOIN markers m ON m.user_id = s.user_id AND m.ts <= s.ts
    WHERE m.status = 'start'""",
)
def _(spark, sf_dir):
    events = _events(spark, sf_dir).withColumnRenamed("user_id", "edge_id").withColumnRenamed("ts", "timestamp")
    is_marker = F.col("event_type").isin("signup", "purchase")
    markers = events.filter(is_marker).select(
        "edge_id",
        "timestamp",
        "event_id",
        F.when(F.col("event_type") == "signup", "start").otherwise("end").alias("status"),
        F.dayofmonth("timestamp").alias("train_round"),
    )
    samples = events.filter(~is_marker).select("event_id", "edge_id", "timestamp", "value")
    gated = gate_by_round(samples, markers, "edge_id", ["timestamp", "event_id"])
    return gated.select("event_id", "edge_id", "value", "train_round")


@query(
    "cpu_from_counters",
    """WITH readings AS (SELECT event_id, user_id,
      sum(CAST(round(value * 100) AS BIGINT)) OVER w AS used, row_number() OVER w * 100 AS system
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    steps AS (SELECT event_id, used - lag(used) OVER v AS du, system - lag(system) OVER v AS ds FROM readings
      WINDOW v AS (PARTITION BY user_id ORDER BY system))
    SELECT event_id, CAST(du AS DOUBLE) / CAST(ds AS DOUBLE) * 4 * 100.0e0 AS cpu_percentage FROM steps""",
)
def _(spark, sf_dir):
    readings = ordered_scan(
        _events(spark, sf_dir).select("event_id", "user_id", "ts", "value"),
        ["user_id"],
        ["ts", "event_id"],
        {"used": Scan("sum", F.round(F.col("value") * 100).cast("bigint")), "n": Scan("count")},
    ).withColumn("system", F.col("n") * 100)
    return counter_rates(readings, "user_id", ["n"], "used", "system", 4).select("event_id", "cpu_percentage")


@query(
    "memory_in_mb",
    "SELECT event_id, value * 4096.0e0 / 1048576.0e0 AS mb FROM events",
)
def _(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", bytes_to_mb(F.col("value") * 4096.0).alias("mb"))


@query("request_id_facts", "SELECT count(*) AS requests, count(*) AS different, count(*) AS well_formed FROM orders")
def _(spark, sf_dir):
    """What is fixed of random ids: one for every request, no two alike, of the usual form."""
    ids = with_request_id(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("consumer_id")))
    return ids.agg(
        F.count(F.lit(1)).alias("requests"),
        F.countDistinct("request_id").alias("different"),
        F.count_if(F.col("request_id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("well_formed"),
    )


@query("request_ids")
def _(spark, sf_dir):
    return with_request_id(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("consumer_id")))
