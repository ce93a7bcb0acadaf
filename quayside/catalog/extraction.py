"""Requests, filters, projections, samples and scalar conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.catalog.base import query, table
from quayside.catalog.views import GAPS_SQL, SIGNAL_SQL, gaps, shared_hash, shared_hash_sql, signal
from quayside.functions.numeric import finite, whole_second
from quayside.functions.pricing import bytes_to_mb, seconds_to_minutes, static_quality_price
from quayside.functions.text import epoch_text, file_code, folder_code, label_code, repair_quotes, round_tag, text_time
from quayside.operators.predicates import (
    accepted_requests,
    apply_filters,
    meets_constraints,
    project,
    rejected_requests,
    split_label,
    without,
)
from quayside.operators.reservoir import reservoir_sample
from quayside.operators.sampling import contiguous_folds, leading, sample_with_replacement, shuffled
from quayside.plans.extraction import TableExtractor, summarise


@query(
    "range_filter_and",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE (l_quantity >= 10 AND l_quantity <= 30) AND l_discount >= 0.03 AND l_tax <= 0.05""",
)
def _(spark, sf_dir):
    filters = {
        "operator": "and",
        "constraints": [
            {"feature_name": "l_quantity", "from": 10, "to": 30},
            {"feature_name": "l_discount", "from": 0.03, "to": "*"},
            {"feature_name": "l_tax", "from": None, "to": 0.05},
            {"feature_name": "l_extendedprice", "from": "*", "to": "*"},
        ],
    }
    return apply_filters(table(spark, sf_dir, "lineitem"), filters).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "range_filter_or",
    """SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_totalprice >= 300000 OR (o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1995-06-30')""",
)
def _(spark, sf_dir):
    filters = {
        "operator": "or",
        "constraints": [
            {"feature_name": "o_totalprice", "from": 300000.0, "to": "*"},
            {"feature_name": "o_orderdate", "from": "1995-01-01 00:00:00", "to": "1995-06-30 00:00:00"},
        ],
    }
    return apply_filters(table(spark, sf_dir, "orders"), filters).select("o_orderkey", "o_totalprice")


@query(
    "range_filter_not",
    "SELECT c_custkey, c_acctbal FROM customer WHERE NOT (c_acctbal >= 0 AND c_acctbal <= 5000 AND c_nationkey <= 12)",
)
def _(spark, sf_dir):
    filters = {
        "operator": "not",
        "constraints": [
            {"feature_name": "c_acctbal", "from": 0, "to": 5000},
            {"feature_name": "c_nationkey", "from": "*", "to": 12},
        ],
    }
    return apply_filters(table(spark, sf_dir, "customer"), filters).select("c_custkey", "c_acctbal")


@query(
    "ordered_projection",
    "SELECT l_extendedprice, l_quantity, l_partkey, l_returnflag FROM lineitem",
)
def _(spark, sf_dir):
    features = [
        {"name": "l_partkey", "index": 3},
        {"name": "l_extendedprice", "index": 0},
        {"name": "l_quantity", "index": 1},
    ]
    return project(table(spark, sf_dir, "lineitem"), features, {"name": "l_returnflag", "index": 4})


@query(
    "extraction_request",
    """SELECT o_totalprice, o_orderpriority, o_orderstatus FROM orders
    WHERE o_totalprice >= 1000 AND (o_custkey >= 10 AND o_custkey <= 1000000)""",
)
def _(spark, sf_dir):
    filters = {
        "operator": "and",
        "constraints": [
            {"feature_name": "o_totalprice", "from": 1000, "to": "*"},
            {"feature_name": "o_custkey", "from": 10, "to": 1000000},
        ],
    }
    features = [{"name": "o_orderpriority", "index": 1}, {"name": "o_totalprice", "index": 0}]
    return TableExtractor(table(spark, sf_dir, "orders"), ["o_orderkey"]).extract(
        features, {"name": "o_orderstatus", "index": 2}, filters
    )


def _requests(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_custkey").alias("owner_id"),
        F.concat(F.lit("d"), (F.col("o_orderkey") % 5).cast("string")).alias("dataset_id"),
    )


def _providers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("owner_id"),
        F.concat(F.lit("d"), (F.col("c_nationkey") % 5).cast("string")).alias("dataset_id"),
    )


_GATE_SQL = """SELECT o_orderkey AS request_id FROM orders WHERE {} EXISTS (SELECT 1 FROM customer
 WHERE c_custkey = o_custkey AND c_nationkey % 5 = o_orderkey % 5)"""


@query("request_gate", _GATE_SQL.format(""))
def _(spark, sf_dir):
    return accepted_requests(_requests(spark, sf_dir), _providers(spark, sf_dir)).select("request_id")


@query("request_gate_rejected", _GATE_SQL.format("NOT"))
def _(spark, sf_dir):
    return rejected_requests(_requests(spark, sf_dir), _providers(spark, sf_dir)).select("request_id")


@query(
    "feature_label_split",
    """SELECT CAST(l_orderkey AS DOUBLE) AS first_feature, l_discount AS fifth_feature,
    CAST(6 AS INTEGER) AS width, l_returnflag AS label FROM lineitem""",
)
def _(spark, sf_dir):
    data = table(spark, sf_dir, "lineitem").drop("l_linestatus", "l_suppkey", "l_partkey")
    split = split_label(data, "l_returnflag", drop=["l_shipdate"])
    return split.select(
        F.col("features")[0].alias("first_feature"),
        F.col("features")[4].alias("fifth_feature"),
        F.size("features").alias("width"),
        "label",
    )


@query(
    "quality_constraints",
    """WITH metrics AS (
     SELECT l_suppkey AS dataset_id, 'completeness' AS metric_name, round(avg(l_discount), 6) AS value
     FROM lineitem GROUP BY 1
     UNION ALL SELECT l_suppkey, 'class_parity', round(avg(l_tax), 6) FROM lineitem GROUP BY 1),
    bounds AS (SELECT metric_name, round(avg(value), 4) AS min_value FROM metrics GROUP BY 1)
    SELECT dataset_id, bool_and(value >= min_value) AS accepted FROM metrics JOIN bounds USING (metric_name) GROUP BY 1""",
)
def _(spark, sf_dir):
    means = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("dataset_id"))
        .agg(
            F.round(F.avg("l_discount"), 6).alias("completeness"), F.round(F.avg("l_tax"), 6).alias("class_parity")
        )
    )
    metrics = means.unpivot("dataset_id", ["completeness", "class_parity"], "metric_name", "value")
    bounds = metrics.groupBy("metric_name").agg(F.round(F.avg("value"), 4).alias("min_value"))
    return meets_constraints(metrics, bounds)


@query(
    "static_quality_price",
    """WITH metrics AS (SELECT l_suppkey AS dataset_id, round(avg(l_discount), 4) AS a, round(avg(l_tax), 4) AS b,
      round(avg(l_quantity) / 50.0e0, 4) AS c FROM lineitem GROUP BY 1)
    SELECT dataset_id, round((a + b + c) * 3 * 0.99e0, 2) AS price FROM metrics""",
)
def _(spark, sf_dir):
    metrics = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("dataset_id"))
        .agg(
            F.round(F.avg("l_discount"), 4).alias("a"),
            F.round(F.avg("l_tax"), 4).alias("b"),
            F.round(F.avg("l_quantity") / 50.0, 4).alias("c"),
        )
    )
    total = F.col("a") + F.col("b") + F.col("c")
    return metrics.select("dataset_id", static_quality_price(total).alias("price"))


@query(
    "dataset_summary",
    "SELECT count(*) AS rows, CAST(11 AS INTEGER) AS columns FROM lineitem",
)
def _(spark, sf_dir):
    return summarise(table(spark, sf_dir, "lineitem"))


@query(
    "sample_with_replacement",
    f"""WITH placed AS (SELECT o_orderkey, row_number() OVER (ORDER BY {shared_hash_sql("o_orderkey", 7)}, o_orderkey) AS pos,
      count(*) OVER () AS n FROM orders),
    draws AS (SELECT id AS draw, {shared_hash_sql("id * 7919 + 13", 11)} AS h FROM range(1000) t(id))
    SELECT p.o_orderkey FROM draws d JOIN placed p ON p.pos = d.h % p.n + 1""",
)
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return sample_with_replacement(
        orders,
        1000,
        ["o_orderkey"],
        row_hash=shared_hash(F.col("o_orderkey"), 7),
        draw_hash=shared_hash(F.col("id") * 7919 + 13, 11),
    )


@query(
    "reservoir_sample",
    """SELECT least(1000, count(*)) AS drawn, least(1000, count(*)) AS of_the_table, true AS same_again,
     true AS prices_near FROM lineitem""",
)
def _(spark, sf_dir):
    """What is fixed of a sample: its size, that its rows are the table's, that the seed repeats it, a mean near the table's."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("price"))
    key = ["l_orderkey", "l_linenumber"]
    first, again = reservoir_sample(lines, 1000, seed=5), reservoir_sample(lines, 1000, seed=5)
    code = F.sum(F.shiftright(F.xxhash64(*key), 16))
    member = first.join(lines.select(*key).distinct(), key, "left_semi").agg(F.count(F.lit(1))).scalar()
    mean, spread = lines.agg(F.avg("price")).scalar(), lines.agg(F.stddev("price")).scalar()
    drawn = first.agg(F.count(F.lit(1)).alias("drawn"), code.alias("_code"), F.avg("price").alias("_mean"))
    # five standard errors of the mean of 1000 draws
    near = F.abs(F.col("_mean") - mean) <= 5 * spread / F.sqrt(F.lit(1000.0))
    same = F.col("_code") == again.agg(code).scalar()
    return drawn.select("drawn", member.alias("of_the_table"), same.alias("same_again"), near.alias("prices_near"))


@query(
    "contiguous_folds",
    f"""WITH placed AS (SELECT o_orderkey,
      row_number() OVER (ORDER BY {shared_hash_sql("o_orderkey", 3)}, o_orderkey) - 1 AS pos,
      count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, CAST(least(pos // (n // 5), n // (n // 5) - 1) AS INTEGER) AS fold FROM placed""",
)
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return contiguous_folds(orders, ["o_orderkey"], row_hash=shared_hash(F.col("o_orderkey"), 3))


@query("leading_positions", f"WITH {SIGNAL_SQL} SELECT series_id, pos, value FROM signal WHERE pos < 32")
def _(spark, sf_dir):
    return leading(signal(spark, sf_dir), "pos", 32).select("series_id", "pos", "value")


# the order is random; the rows are those of the table, each once
@query("seeded_shuffle", "SELECT o_orderkey FROM orders")
def _(spark, sf_dir):
    return shuffled(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query(
    "recording_truncation",
    f"WITH {SIGNAL_SQL} SELECT series_id, pos, CAST(trunc(value) AS INTEGER) AS second FROM signal WHERE trunc(value) <= 29",
)
def _(spark, sf_dir):
    from quayside.operators.windows import truncate_recording

    kept = truncate_recording(signal(spark, sf_dir), "value", 29)
    return kept.select("series_id", "pos", whole_second(F.col("value")).alias("second"))


@query(
    "json_payload_decode",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
def _(spark, sf_dir):
    decoded = F.from_json("props", "k bigint", {"mode": "PERMISSIVE"})
    return table(spark, sf_dir, "events").select("event_id", decoded.alias("p")).select("event_id", "p.k")


@query(
    "epoch_to_text",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, '{"t": "' || event_type || '"}' AS repaired
    FROM events""",
)
def _(spark, sf_dir):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    quoted = F.concat(F.lit("{'t': '"), F.col("event_type"), F.lit("'}"))
    return table(spark, sf_dir, "events").select(
        "event_id", epoch_text(seconds).alias("at"), repair_quotes(quoted).alias("repaired")
    )


@query(
    "text_to_time",
    "SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS seconds FROM events",
)
def _(spark, sf_dir):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(text_time(text)).alias("seconds"))


@query(
    "unit_conversions",
    """SELECT l_orderkey, l_linenumber, l_extendedprice / 1048576.0e0 AS mb, l_quantity / 60.0e0 AS minutes,
     printf('%03d', l_linenumber) AS tag FROM lineitem""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        bytes_to_mb(F.col("l_extendedprice")).alias("mb"),
        seconds_to_minutes(F.col("l_quantity")).alias("minutes"),
        round_tag(F.col("l_linenumber")).alias("tag"),
    )


@query(
    "null_and_infinity_fill",
    f"""WITH {GAPS_SQL} SELECT l_orderkey, l_linenumber, coalesce(l_discount, 0.0e0) AS l_discount,
     CASE WHEN l_tax IS NULL THEN 1.7976931348623157e308 ELSE l_tax END AS l_tax FROM gaps""",
)
def _(spark, sf_dir):
    infinite = F.when(F.col("l_tax").isNull(), F.lit(float("inf"))).otherwise(F.col("l_tax"))
    return gaps(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        finite(F.coalesce("l_discount", F.lit(float("nan")))).alias("l_discount"),
        finite(infinite).alias("l_tax"),
    )


@query(
    "private_fields_removed",
    "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer",
)
def _(spark, sf_dir):
    return without(table(spark, sf_dir, "customer"), "c_acctbal", "c_name")


@query(
    "folder_vocabulary",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'A12' WHEN 'view' THEN 'P12' WHEN 'purchase' THEN 'H12'
      WHEN 'signup' THEN 'N' ELSE 'error' END AS folder,
     CASE WHEN event_type = 'click' THEN 'BR_CC_0-' || lpad(CAST(user_id AS VARCHAR), 4, '0') || '.5_A1.csv'
      WHEN event_type = 'signup' THEN 'N_H1.csv' ELSE 'LO_NL_ND_P1.csv' END AS file,
     CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 0 WHEN 'purchase' THEN 4 END AS target
    FROM events""",
)
def _(spark, sf_dir):
    kind = F.col("event_type")
    folder = (
        F.when(kind == "click", "Accelerometer")
        .when(kind == "view", "Dynamic Pressure Sensor")
        .when(kind == "purchase", "Hydrophone")
        .when(kind == "signup", "Background Noise")
        .otherwise(kind)
    )
    number = F.lpad(F.col("user_id").cast("string"), 4, "0")
    file = (
        F.when(kind == "click", F.concat(F.lit("BR_CC_0."), number, F.lit(".5_A1.csv")))
        .when(kind == "signup", F.lit("Background Noise_H1.csv"))
        .otherwise(F.lit("LO_NL_ND_P1.csv"))
    )
    label = F.when(kind == "click", "CC").when(kind == "view", "NL").when(kind == "purchase", "OL")
    return table(spark, sf_dir, "events").select(
        "event_id", folder_code(folder).alias("folder"), file_code(file).alias("file"), label_code(label).alias("target")
    )
