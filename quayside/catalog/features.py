"""Sensor windows, feature tables, routing, splits and provider partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.catalog.base import query, table
from quayside.catalog.views import SIGNAL_SQL, shared_hash, shared_hash_sql, signal
from quayside.functions.text import recording_parts
from quayside.operators.ordered import ranked
from quayside.operators.splits import chronological_split, provider_partitions
from quayside.operators.windows import (
    EXECUTED_RULES,
    STATED_RULES,
    bucket_of,
    candidate_predicate,
    conditions_of,
    fixed_rate_second,
    joined_once,
    labelled,
    non_empty_groups,
    series_widths,
    short_series,
    window_features,
    with_windows,
)
from quayside.plans.feature_engineering import (
    GROUP,
    FeatureOptions,
    feature_table,
    labelled_features,
    recording_features,
    train_test,
)

OPTIONS = FeatureOptions(seconds=2, buckets=3, overlap=0.5)

# --- recordings: events stand in for sensor files, 'error' events for background noise -----

RECORDINGS_SQL = """
named AS (
 SELECT event_id, ts, value, CASE WHEN event_type = 'error' THEN concat('N_H', CAST(user_id % 2 + 1 AS VARCHAR), '.csv')
  ELSE concat(CASE (user_id // 6) % 2 WHEN 0 THEN 'BR' ELSE 'LO' END, '_',
   ['NL', 'CC', 'GL', 'LC', 'OL'][CAST((user_id // 12) % 5 + 1 AS INTEGER)], '_',
   ['0-18 LPS', '0-47 LPS', 'ND', 'Transient'][CAST((user_id // 60) % 2 + 2 * ((user_id // 6) % 2) + 1 AS INTEGER)],
   CASE WHEN user_id % 6 >= 4 THEN CASE (user_id // 120) % 2 WHEN 0 THEN '_N' ELSE '_NN' END ELSE '' END, '_',
   ['A1', 'A2', 'P1', 'P2', 'H1', 'H2'][CAST(user_id % 6 + 1 AS INTEGER)], '.csv') END AS file_name
 FROM events),
recordings AS (
 SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY ts, event_id) - 1 AS pos,
  (row_number() OVER (PARTITION BY file_name ORDER BY ts, event_id) - 1) // 8 AS second FROM named)"""

PARTS_SQL = f"""{RECORDINGS_SQL},
parts AS (
 SELECT *, file_name LIKE 'N\\_%' ESCAPE '\\' AS is_noise, split_part(file_name[:-5], '_', 1) AS p1,
  split_part(file_name[:-5], '_', 2) AS p2, split_part(file_name[:-5], '_', 3) AS p3,
  split_part(file_name[:-5], '_', 4) AS p4, split_part(file_name[:-5], '_', 5) AS p5 FROM recordings),
attributes AS (
 SELECT event_id, file_name, pos, second, value, is_noise, CASE WHEN NOT is_noise THEN p1 END AS topology,
  CASE WHEN NOT is_noise THEN p2 END AS label, CASE WHEN NOT is_noise THEN p3 END AS flow,
  CASE WHEN is_noise THEN 'N' WHEN p5 <> '' THEN p4 END AS noise,
  CASE WHEN is_noise THEN p2 WHEN p5 <> '' THEN p5 ELSE p4 END AS sensor FROM parts)"""


def recordings(spark, sf_dir):
    user = F.col("user_id")

    def pick(values, index):
        return F.get(F.array(*map(F.lit, values)), index.cast("int"))

    def every(size, count):
        return F.floor(user / size) % count

    noise = F.when(user % 6 >= 4, F.when(every(120, 2) == 0, "_N").otherwise("_NN")).otherwise("")
    named = F.concat(
        pick(["BR", "LO"], every(6, 2)),
        F.lit("_"),
        pick(["NL", "CC", "GL", "LC", "OL"], every(12, 5)),
        F.lit("_"),
        pick(["0-18 LPS", "0-47 LPS", "ND", "Transient"], every(60, 2) + 2 * every(6, 2)),
        noise,
        F.lit("_"),
        pick(["A1", "A2", "P1", "P2", "H1", "H2"], user % 6),
        F.lit(".csv"),
    )
    background = F.concat(F.lit("N_H"), (user % 2 + 1).cast("string"), F.lit(".csv"))
    events = table(spark, sf_dir, "events").select(
        "event_id", "ts", "value", F.when(F.col("event_type") == "error", background).otherwise(named).alias("file_name")
    )
    placed = ranked(events, ["file_name"], ["ts", "event_id"], "n")
    return placed.select(
        "event_id",
        "file_name",
        (F.col("n") - 1).alias("pos"),
        F.floor((F.col("n") - 1) / 8).alias("second"),
        "value",
    )


def _attributes(spark, sf_dir):
    data = recordings(spark, sf_dir)
    return data.select("*", *[c.alias(n) for n, c in recording_parts(F.col("file_name")).items()])


@query(
    "recording_attributes",
    f"WITH {PARTS_SQL} SELECT event_id, is_noise, topology, label, flow, noise, sensor FROM attributes",
)
def _(spark, sf_dir):
    return _attributes(spark, sf_dir).select("event_id", "is_noise", "topology", "label", "flow", "noise", "sensor")


CONDITIONS_SQL = """SELECT *, unnest(list_filter([
  CASE WHEN is_noise OR flow = '0-18 LPS' {marker} THEN 'BC1' END,
  CASE WHEN is_noise OR flow = '0-47 LPS' {marker} THEN 'BC2' END,
  CASE WHEN NOT is_noise AND flow = 'ND' AND (sensor[1] <> 'H' OR noise = 'NN') THEN 'BC3' END,
  CASE WHEN is_noise OR flow = 'ND' AND sensor[1] = 'H' AND noise = 'N' THEN 'BC4' END,
  CASE WHEN is_noise OR flow = 'Transient' AND (sensor[1] <> 'H' OR noise = 'N') THEN 'BC5' END,
  CASE WHEN NOT is_noise AND flow = 'Transient' AND sensor[1] = 'H' AND noise = 'NN' THEN 'BC6' END],
  lambda c: c IS NOT NULL)) AS condition"""


def _routed(spark, sf_dir, rules):
    parts = {n: F.col(n) for n in ("is_noise", "topology", "label", "flow", "noise", "sensor")}
    return _attributes(spark, sf_dir).withColumn("condition", F.explode(conditions_of(parts, rules)))


@query(
    "condition_router",
    f"WITH {PARTS_SQL} SELECT event_id, condition FROM ({CONDITIONS_SQL.format(marker='')} FROM attributes)",
)
def _(spark, sf_dir):
    return _routed(spark, sf_dir, EXECUTED_RULES).select("event_id", "condition")


@query(
    "condition_router_stated_rules",
    f"""WITH {PARTS_SQL} SELECT event_id, condition FROM
    ({CONDITIONS_SQL.format(marker="AND (sensor[1] <> 'H' OR noise = 'N')")} FROM attributes)""",
)
def _(spark, sf_dir):
    return _routed(spark, sf_dir, STATED_RULES).select("event_id", "condition")


@query(
    "condition_flags",
    f"""WITH {PARTS_SQL}
    SELECT event_id, CAST(topology = 'BR' AS INTEGER) AS topology, list_position(['NL', 'CC', 'GL', 'LC', 'OL'], label) - 1 AS target,
     CAST(condition = 'BC1' AS INTEGER) AS BC1, CAST(condition = 'BC2' AS INTEGER) AS BC2,
     CAST(condition = 'BC3' AS INTEGER) AS BC3, CAST(condition = 'BC4' AS INTEGER) AS BC4,
     CAST(condition = 'BC5' AS INTEGER) AS BC5, CAST(condition = 'BC6' AS INTEGER) AS BC6
    FROM ({CONDITIONS_SQL.format(marker='')} FROM attributes) WHERE NOT is_noise""",
)
def _(spark, sf_dir):
    routed = _routed(spark, sf_dir, EXECUTED_RULES).filter(~F.col("is_noise"))
    return labelled(routed.select("event_id", "topology", "label", "condition"))


@query(
    "candidate_recordings",
    f"""WITH {PARTS_SQL} SELECT file_name, count(*) AS readings FROM attributes
    WHERE is_noise OR (topology = 'LO' AND label = 'NL') GROUP BY 1""",
)
def _(spark, sf_dir):
    parts = recording_parts(F.col("file_name"))
    wanted = recordings(spark, sf_dir).filter(candidate_predicate(parts, "LO", "NL"))
    return wanted.groupBy("file_name").agg(F.count(F.lit(1)).alias("readings"))


@query(
    "non_empty_groups",
    f"""WITH {PARTS_SQL} SELECT topology, label, flow, count(*) AS recordings
    FROM (SELECT DISTINCT file_name, topology, label, flow FROM attributes WHERE NOT is_noise) GROUP BY 1, 2, 3""",
)
def _(spark, sf_dir):
    files = _attributes(spark, sf_dir).select("file_name", "topology", "label", "flow").distinct()
    return non_empty_groups(files)


# --- windows -------------------------------------------------------------------------------

WINDOW_SQL = """
placed AS (
 SELECT *, unnest(range(greatest(0, (pos - {w} + {s}) // {s}), pos // {s} + 1)) AS window_id FROM {source}),
bucketed AS (
 SELECT *, pos - window_id * {s} AS q, CASE WHEN pos - window_id * {s} < ({w} % 3) * ({w} // 3 + 1)
   THEN (pos - window_id * {s}) // ({w} // 3 + 1)
   ELSE ({w} % 3) + (pos - window_id * {s} - ({w} % 3) * ({w} // 3 + 1)) // ({w} // 3) END AS bucket FROM placed),
features AS (
 SELECT {keys}, window_id, avg(value) FILTER (bucket = 0) AS b0, avg(value) FILTER (bucket = 1) AS b1,
  avg(value) FILTER (bucket = 2) AS b2, avg(value) AS mean, stddev_samp(value) AS std, arg_min(second, pos) AS "time"
 FROM bucketed GROUP BY {keys}, window_id HAVING count(*) = any_value({w}))"""

SIGNAL_WINDOWS_SQL = f"""{SIGNAL_SQL}, timed AS (SELECT *, pos // 8 AS second FROM signal),
{WINDOW_SQL.format(w="16", s="8", source="timed", keys="series_id, topology, target").strip()}"""


def _timed(spark, sf_dir):
    return signal(spark, sf_dir).withColumn("second", F.expr("pos div 8"))


def signal_features(spark, sf_dir):
    return window_features(
        _timed(spark, sf_dir), ["series_id", "topology", "target"], "pos", "value", 16, 8, 3, "second"
    )


@query(
    "overlapping_windows",
    f"WITH {SIGNAL_WINDOWS_SQL} SELECT series_id, pos, window_id, q AS \"offset\" FROM bucketed",
)
def _(spark, sf_dir):
    placed = with_windows(signal(spark, sf_dir).select("series_id", "pos"), "pos", 16, 8)
    return placed.select("series_id", "pos", "window_id", "offset")


@query(
    "window_buckets",
    f"""WITH {SIGNAL_WINDOWS_SQL} SELECT bucket, count(*) AS readings, min(q) AS first_place, max(q) AS last_place
    FROM bucketed GROUP BY bucket""",
)
def _(spark, sf_dir):
    placed = with_windows(signal(spark, sf_dir).select("series_id", "pos"), "pos", 16, 8)
    return (
        placed.withColumn("bucket", bucket_of("offset", "window_width", 3))
        .groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("readings"),
            F.min("offset").alias("first_place"),
            F.max("offset").alias("last_place"),
        )
    )


FEATURE_VALUES = ["b0", "b1", "b2", "mean", "std"]
FEATURE_VALUES_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in FEATURE_VALUES)


def rounded(columns):
    return [F.round(F.col(c), 6).alias(c) for c in columns]


@query(
    "window_features",
    f"""WITH {SIGNAL_WINDOWS_SQL} SELECT series_id, topology, target, window_id, "time", {FEATURE_VALUES_SQL} FROM features""",
)
def _(spark, sf_dir):
    return signal_features(spark, sf_dir).select(
        "series_id", "topology", "target", "window_id", "time", *rounded(FEATURE_VALUES)
    )


SIZED_SQL = f"""{PARTS_SQL},
widths AS (SELECT file_name, count(*) FILTER (second = 0) * 2 AS width FROM recordings GROUP BY 1),
sized AS (SELECT a.*, w.width, w.width - CAST(floor(w.width * 0.5e0) AS BIGINT) AS step
 FROM attributes a JOIN widths w USING (file_name) WHERE w.width > 0 AND a.second <= 29),
{WINDOW_SQL.format(w="width", s="step", source="sized", keys="file_name, is_noise, topology, label, flow, noise, sensor").strip()}"""


@query(
    "recording_widths",
    f"WITH {RECORDINGS_SQL} SELECT file_name, count(*) FILTER (second = 0) * 2 AS width FROM recordings GROUP BY 1",
)
def _(spark, sf_dir):
    return series_widths(recordings(spark, sf_dir), ["file_name"], "second", 2)


@query(
    "short_recordings",
    f"""WITH {RECORDINGS_SQL} SELECT file_name, count(*) AS readings, CAST(70 AS INTEGER) AS width
    FROM recordings GROUP BY 1 HAVING count(*) < 70""",
)
def _(spark, sf_dir):
    return short_series(recordings(spark, sf_dir), ["file_name"], 70)


@query(
    "recording_features",
    f"""WITH {SIZED_SQL} SELECT file_name, sensor, window_id, "time", {FEATURE_VALUES_SQL} FROM features""",
)
def _(spark, sf_dir):
    features = recording_features(recordings(spark, sf_dir), OPTIONS)
    return features.select("file_name", "sensor", "window_id", "time", *rounded(FEATURE_VALUES))


SENSORS = ["A1", "A2", "P1", "P2", "H1", "H2"]


def _block_sql(sensor, column, name):
    return f"round(max({column}) FILTER (sensor = '{sensor}'), 6) AS {sensor}_{name}"


_BLOCKS = [("b0", "0"), ("b1", "1"), ("b2", "2"), ("mean", "mean"), ("std", "std")]
WIDE_SQL = f"""{SIZED_SQL},
noise_features AS (SELECT sensor, window_id, {", ".join(f"{c} AS n_{c}" for c, _ in _BLOCKS)} FROM features WHERE is_noise),
heard AS (SELECT f.*, {", ".join(f"CASE WHEN f.noise = 'N' THEN n.n_{c} END AS n_{c}" for c, _ in _BLOCKS)}
 FROM features f LEFT JOIN noise_features n ON n.sensor = f.sensor AND n.window_id = f.window_id WHERE NOT f.is_noise),
routed AS ({CONDITIONS_SQL.format(marker='')} FROM heard),
firsts AS (SELECT * FROM routed QUALIFY dense_rank() OVER (PARTITION BY condition, topology, label, flow, sensor ORDER BY file_name) = 1),
wide AS (SELECT condition, topology, label, flow, window_id,
 coalesce({", ".join(f"max(\"time\") FILTER (sensor = '{s}')" for s in SENSORS)}) AS "time",
 {", ".join(_block_sql(s, c, n) for s in SENSORS for c, n in _BLOCKS)},
 {", ".join(_block_sql(s, f"n_{c}", f"N_{c}") for s in ("H1", "H2") for c, _ in _BLOCKS)}
 FROM firsts GROUP BY condition, topology, label, flow, window_id)"""


def wide_features(spark, sf_dir):
    return feature_table(recordings(spark, sf_dir), OPTIONS)


WIDE_VALUES = [f"{s}_{n}" for s in SENSORS for _, n in _BLOCKS] + [f"{s}_N_{c}" for s in ("H1", "H2") for c, _ in _BLOCKS]


@query("feature_table", f"WITH {WIDE_SQL} SELECT * FROM wide")
def _(spark, sf_dir):
    return wide_features(spark, sf_dir).select(*GROUP, "window_id", "time", *rounded(WIDE_VALUES))


@query(
    "labelled_feature_table",
    f"""WITH {WIDE_SQL}
    SELECT CAST(topology = 'BR' AS INTEGER) AS topology, list_position(['NL', 'CC', 'GL', 'LC', 'OL'], label) - 1 AS target,
     {", ".join(f"CAST(condition = 'BC{i}' AS INTEGER) AS BC{i}" for i in range(1, 7))}, flow, window_id, "time", A1_mean, H1_mean,
     H1_N_mean FROM wide""",
)
def _(spark, sf_dir):
    wide = wide_features(spark, sf_dir).select(*GROUP, "window_id", "time", *rounded(["A1_mean", "H1_mean", "H1_N_mean"]))
    return labelled_features(wide)


# --- splits --------------------------------------------------------------------------------

SPLIT_SQL = """
ordered AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY {t}, {k}) - 1 AS place,
  count(*) OVER (PARTITION BY {g}) AS n FROM {source}),
cuts AS (SELECT {g}, CAST(floor(any_value(n) / 1.2e0) AS BIGINT) AS cut, any_value(n) AS n FROM ordered GROUP BY {g}),
cut_time AS (SELECT o.*, c.cut FROM ordered o JOIN cuts c USING ({g}) WHERE o.place = c.cut),
run_end AS (SELECT {g}, max(o.place) AS cut FROM ordered o JOIN cut_time c USING ({g}) WHERE o.{t} = c.{t} GROUP BY {g})"""


@query(
    "chronological_split",
    f"""WITH {SPLIT_SQL.format(g="o_custkey", t="o_orderdate", k="o_orderkey", source="orders")}
    SELECT o.o_custkey, o.o_orderkey, CASE WHEN r.cut IS NULL OR o.place < r.cut THEN 'train' ELSE 'test' END AS split
    FROM ordered o LEFT JOIN run_end r USING (o_custkey)""",
)
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    split = chronological_split(orders, ["o_custkey"], "o_orderdate", ["o_orderkey"], 0.2)
    return split.select("o_custkey", "o_orderkey", "split")


@query(
    "chronological_split_with_ties",
    f"""WITH days AS (SELECT user_id, event_id, CAST(day(ts) AS INTEGER) AS d FROM events),
    {SPLIT_SQL.format(g="user_id", t="d", k="event_id", source="days").strip()}
    SELECT o.user_id, o.event_id, CASE WHEN r.cut IS NULL OR o.place <= r.cut THEN 'train' ELSE 'test' END AS split
    FROM ordered o LEFT JOIN run_end r USING (user_id)""",
)
def _(spark, sf_dir):
    days = table(spark, sf_dir, "events").select("user_id", "event_id", F.dayofmonth("ts").alias("d"))
    split = chronological_split(days, ["user_id"], "d", ["event_id"], 0.2, keep_ties_together=True)
    return split.select("user_id", "event_id", "split")


@query(
    "chronological_split_all_rows",
    f"""WITH days AS (SELECT 1 AS one, event_id, date_trunc('day', ts) AS d FROM events),
    {SPLIT_SQL.format(g="one", t="d", k="event_id", source="days").strip()}
    SELECT o.event_id, CASE WHEN r.cut IS NULL OR o.place < r.cut THEN 'train' ELSE 'test' END AS split
    FROM ordered o LEFT JOIN run_end r USING (one)""",
)
def _(spark, sf_dir):
    days = table(spark, sf_dir, "events").select("event_id", F.date_trunc("day", "ts").alias("d"))
    return chronological_split(days, [], "d", ["event_id"], 0.2).select("event_id", "split")


@query(
    "feature_train_test",
    f"""WITH {WIDE_SQL}, keyed AS (SELECT condition || topology || label || flow AS g, window_id, "time" AS t FROM wide),
    {SPLIT_SQL.format(g="g", t="t", k="window_id", source="keyed").strip()}
    SELECT o.g, o.window_id, CASE WHEN r.cut IS NULL OR o.place < r.cut THEN 'train' ELSE 'test' END AS split
    FROM ordered o LEFT JOIN run_end r USING (g)""",
)
def _(spark, sf_dir):
    split = train_test(wide_features(spark, sf_dir).select(*GROUP, "window_id", "time"), OPTIONS)
    return split.select(F.concat(*GROUP).alias("g"), "window_id", "split")


@query(
    "provider_partitions",
    f"""WITH placed AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS label,
      {shared_hash_sql("o_orderkey", 5)} AS h1, {shared_hash_sql("o_orderkey * 31 + 17", 9)} AS h2 FROM orders),
    ranks AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h1, o_orderkey) AS r,
      CASE WHEN label = 0 THEN 0 ELSE CAST(floor(count(*) OVER (PARTITION BY label) * 0.8e0) AS BIGINT) END AS kept
      FROM placed),
    skewed AS (SELECT o_orderkey, 'skewed' AS pool, row_number() OVER (ORDER BY label, r) - 1 AS p, count(*) OVER () AS n
      FROM ranks WHERE r <= kept),
    even AS (SELECT o_orderkey, 'even' AS pool, row_number() OVER (ORDER BY h2, o_orderkey) - 1 AS p, count(*) OVER () AS n
      FROM ranks WHERE r > kept),
    pools AS (SELECT * FROM skewed UNION ALL SELECT * FROM even)
    SELECT o_orderkey, pool, CAST(CASE WHEN p < (n % 8) * (n // 8 + 1) THEN p // (n // 8 + 1)
      ELSE n % 8 + (p - (n % 8) * (n // 8 + 1)) // (n // 8) END + 1 AS INTEGER) AS provider FROM pools""",
)
def _(spark, sf_dir):
    label = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"))
    shares = provider_partitions(
        orders,
        "label",
        ["o_orderkey"],
        8,
        0.2,
        first_hash=shared_hash(F.col("o_orderkey"), 5),
        second_hash=shared_hash(F.col("o_orderkey") * 31 + 17, 9),
    )
    return shares.select("o_orderkey", "pool", "provider")


@query(
    "appended_feature_frames",
    f"""WITH {SIZED_SQL}
    SELECT file_name, window_id, round(mean, 6) AS mean, round(b0, 6) AS b0, NULL::DOUBLE AS std FROM features WHERE is_noise
    UNION ALL SELECT file_name, window_id, round(mean, 6), NULL, round(std, 6) FROM features WHERE NOT is_noise""",
)
def _(spark, sf_dir):
    features = recording_features(recordings(spark, sf_dir), OPTIONS).withColumns(
        {c: F.round(c, 6) for c in ("mean", "b0", "std")}
    )
    noise = features.filter("is_noise").select("file_name", "window_id", "mean", "b0")
    rest = features.filter("not is_noise").select("file_name", "window_id", "mean", "std")
    return noise.unionByName(rest, allowMissingColumns=True)


@query(
    "fixed_rate_seconds",
    f"WITH {SIGNAL_SQL} SELECT series_id, pos, CAST(pos // 8 AS BIGINT) AS second FROM signal",
)
def _(spark, sf_dir):
    return signal(spark, sf_dir).select("series_id", "pos", fixed_rate_second(F.col("pos"), 8).alias("second"))


@query(
    "blocks_without_duplicate_columns",
    f"""WITH {SIGNAL_WINDOWS_SQL},
    a AS (SELECT series_id // 2 AS pair, window_id, mean, "time" FROM features WHERE series_id % 2 = 0),
    b AS (SELECT series_id // 2 AS pair, window_id, std, "time" FROM features WHERE series_id % 2 = 1)
    SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.window_id, b.window_id) AS window_id, a."time",
     round(a.mean, 6) AS mean, round(b.std, 6) AS std
    FROM a FULL JOIN b ON a.pair = b.pair AND a.window_id = b.window_id""",
)
def _(spark, sf_dir):
    features = signal_features(spark, sf_dir).withColumn("pair", F.floor(F.col("series_id") / 2))
    even = features.filter("series_id % 2 = 0").select("pair", "window_id", "mean", "time")
    odd = features.filter("series_id % 2 = 1").select("pair", "window_id", "std", "time")
    return joined_once(even, odd, ["pair", "window_id"]).select("pair", "window_id", "time", *rounded(["mean", "std"]))
