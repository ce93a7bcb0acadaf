"""The data model's inputs, derived from the star-schema tables: Spark form and SQL form side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.catalog.base import table
from quayside.operators.ordered import ranked


def code(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


# --- monitoring messages -----------------------------------------------------------------

MESSAGES_SQL = """
messages AS (
 SELECT event_id, concat('edge', CAST(user_id % 10 AS VARCHAR)) AS edge_id, '1' AS run_id,
  concat('ds', CAST(user_id % 10 AS VARCHAR)) AS dataset_id, concat('m', CAST(user_id % 3 AS VARCHAR)) AS model_id,
  ts, CAST(day(ts) AS INTEGER) AS train_round, event_type = 'purchase' AS is_quality,
  CASE WHEN event_type <> 'purchase' THEN value END AS cpu_percentage,
  CASE WHEN event_type <> 'purchase' THEN value * 1048576.0e0 END AS memory_usage,
  CASE WHEN event_type = 'purchase' THEN least(value / 100.0e0, 1.0e0) END AS pre_perf,
  CASE WHEN event_type = 'purchase' THEN least(value / 80.0e0, 1.0e0) END AS post_perf,
  CASE WHEN event_type = 'purchase' THEN least(value / 90.0e0, 1.0e0) END AS test_perf,
  CASE WHEN event_type = 'purchase' THEN value * 10.0e0 END AS duration
 FROM events)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_of(table(spark, sf_dir, "events"))


def messages_of(events: DataFrame) -> DataFrame:
    """Flat monitoring messages: purchases report model quality, other events resource use."""
    value = F.col("value")
    is_quality = F.col("event_type") == "purchase"
    quality = F.struct(
        F.least(value / 80.0, F.lit(1.0)).alias("post_train_performance"),
        F.least(value / 100.0, F.lit(1.0)).alias("pre_train_performance"),
        (value * 10.0).alias("train_duration"),
        F.least(value / 90.0, F.lit(1.0)).alias("test_performance"),
    )
    usage = F.struct(value.alias("cpu_percentage"), (value * 1048576.0).alias("memory_usage"))
    return events.select(
        "event_id",
        code("m", F.col("user_id") % 3).alias("model_id"),
        F.lit("1").alias("run_id"),
        code("ds", F.col("user_id") % 10).alias("dataset_id"),
        code("edge", F.col("user_id") % 10).alias("edge_id"),
        F.col("ts").alias("timestamp"),
        F.dayofmonth("ts").alias("train_round"),
        F.when(is_quality, quality).alias("quality_of_model"),
        F.when(~is_quality, usage).alias("resource_monitor"),
    )


MESSAGE_ORDER = ["timestamp", "event_id"]

# --- price table -------------------------------------------------------------------------

PRICES_SQL = """
prices AS (
 SELECT concat('m', CAST(c_nationkey % 3 AS VARCHAR)) AS model_id,
  concat('ds', CAST(c_custkey % 9 + 2 AS VARCHAR)) AS dataset_id,
  CASE WHEN c_nationkey % 3 = 2 AND c_custkey % 9 = 5 THEN 'no_such_function'
       ELSE 'qom_cost_by_train_performance' END AS qom_cost_function,
  23.5e0 AS performance, 'resource_cost_by_cpu_mem' AS resource_cost_function, 0.02e0 AS by_minute, 0.02e0 AS cpu,
  CASE WHEN c_custkey % 9 % 5 = 0 THEN NULL ELSE 0.003e0 END AS memory,
  round(avg(c_acctbal) / 500.0e0, 4) AS cost_quantity_quality, 3.25e0 AS cost_context
 FROM customer GROUP BY c_nationkey % 3, c_custkey % 9)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price table: one row per (model, dataset), priced from all customers of that pair."""
    pairs = (
        table(spark, sf_dir, "customer")
        .groupBy((F.col("c_nationkey") % 3).alias("m"), (F.col("c_custkey") % 9).alias("d"))
        .agg(F.round(F.avg("c_acctbal") / 500.0, 4).alias("cost_quantity_quality"))
    )
    return pairs.select(
        code("m", F.col("m")).alias("model_id"),
        code("ds", F.col("d") + 2).alias("dataset_id"),
        F.when((F.col("m") == 2) & (F.col("d") == 5), "no_such_function")
        .otherwise("qom_cost_by_train_performance")
        .alias("qom_cost_function"),
        F.struct(F.lit(23.5).alias("performance")).alias("qom_base_cost"),
        F.lit("resource_cost_by_cpu_mem").alias("resource_cost_function"),
        F.struct(
            F.lit(0.02).alias("by_minute"),
            F.lit(0.02).alias("cpu"),
            F.when(F.col("d") % 5 != 0, F.lit(0.003)).alias("memory"),
        ).alias("resource_base_cost"),
        "cost_quantity_quality",
        F.lit(3.25).alias("cost_context"),
    )


# --- folded and priced rounds in SQL -----------------------------------------------------

ROUNDS_SQL = f"""
{MESSAGES_SQL.strip()},
{PRICES_SQL.strip()},
seen AS (
 SELECT *, greatest(0.0e0, coalesce(max(cpu_percentage) OVER w, 0.0e0)) AS peak_cpu,
  greatest(0.0e0, coalesce(max(memory_usage) OVER w, 0.0e0)) AS peak_memory,
  row_number() OVER w AS pos
 FROM messages
 WINDOW w AS (PARTITION BY model_id, run_id, dataset_id, train_round ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
folded AS (
 SELECT model_id, run_id, dataset_id, train_round, max(ts) AS "timestamp", arg_min(edge_id, pos) AS edge_id,
  count(*) AS msg_count, max(pos) FILTER (is_quality) AS last_pos
 FROM seen GROUP BY ALL),
closing AS (
 SELECT f.model_id, f.run_id, f.dataset_id, f.train_round, f."timestamp", f.edge_id, f.msg_count,
  s.peak_cpu, s.peak_memory, s.pre_perf, s.post_perf, s.test_perf, s.duration
 FROM folded f JOIN seen s ON s.model_id = f.model_id AND s.run_id = f.run_id AND s.dataset_id = f.dataset_id
  AND s.train_round = f.train_round AND s.pos = f.last_pos),
round_cost AS (
 SELECT c.model_id, c.run_id, c.dataset_id, c.train_round, c."timestamp", c.edge_id, c.msg_count,
  CASE WHEN p.model_id IS NULL THEN 0.0e0 ELSE p.by_minute * (c.duration / 60.0e0) *
   (p.cpu * c.peak_cpu + coalesce(p.memory, 0.0e0) * (c.peak_memory / 1048576.0e0)) END AS cost_resource,
  CASE WHEN p.model_id IS NULL THEN 0.0e0
   WHEN p.qom_cost_function = 'qom_cost_by_train_performance' THEN
    greatest(0.0e0, p.performance * (c.post_perf - c.pre_perf) * c.pre_perf) END AS cost_qom,
  coalesce(p.cost_quantity_quality, 0.0e0) AS cost_qod, coalesce(p.cost_context, 0.0e0) AS cost_context,
  c.post_perf - c.pre_perf AS improvement_diff, c.post_perf AS performance_post, c.test_perf AS performance_test,
  p.model_id IS NOT NULL AND p.qom_cost_function <> 'no_such_function' AS price_found
 FROM closing c LEFT JOIN prices p ON p.model_id = c.model_id AND p.dataset_id = c.dataset_id)"""

# --- sensor signals ----------------------------------------------------------------------

SIGNAL_SQL = """
signal AS (
 SELECT user_id AS series_id, CAST(user_id % 2 AS INTEGER) AS topology, CAST(user_id % 5 AS INTEGER) AS target,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos, value
 FROM events)"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long sensor series: one row per (series, position)."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    placed = ranked(events, ["user_id"], ["ts", "event_id"], "n")
    return placed.select(
        F.col("user_id").alias("series_id"),
        (F.col("user_id") % 2).cast("int").alias("topology"),
        (F.col("user_id") % 5).cast("int").alias("target"),
        (F.col("n") - 1).cast("long").alias("pos"),
        "value",
    )


# --- feature matrix with gaps ------------------------------------------------------------

GAPS_SQL = """
gaps AS (
 SELECT l_orderkey, l_linenumber, l_quantity, nullif(l_discount, 0.0e0) AS l_discount, nullif(l_tax, 0.0e0) AS l_tax,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)"""


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
    )


# --- embeddings as a wide matrix -----------------------------------------------------------

FEATURES = [f"f{i}" for i in range(64)]


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature matrix with all 64 dimensions as columns: id, y, f0..f63."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").alias("y"),
        *[F.col("embedding")[i].cast("double").alias(name) for i, name in enumerate(FEATURES)],
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matrix with the features as one array<double>."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("y"), F.col("embedding").cast("array<double>").alias("x")
    )


# 32-bit multiplicative hash that both engines compute alike; ids stay far below 2^31
def shared_hash(ident: Column, seed: int) -> Column:
    mixed = (ident % 2147483647) * 2654435761 + seed
    return mixed % 4294967296


def shared_hash_sql(ident: str, seed: int) -> str:
    return f"((({ident}) % 2147483647) * 2654435761 + {seed}) % 4294967296"
