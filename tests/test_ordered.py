"""The path for hot keys must give the same answers as the plain one."""

import random

import pytest
from pyspark.sql import functions as F

from quayside.operators import positions
from quayside.operators.ordered import Scan, Skew, hot_keys, lookup, ordered_scan, ranked
from quayside.operators.positions import rows_at, uniform_hash
from quayside.operators.rounds import fold_rounds
from quayside.operators.splits import chronological_split

FORCED = Skew(share=0.1, min_rows=20, pieces=7)



@pytest.fixture(scope="module")
def skewed(spark):
    random.seed(3)
    rows = []
    for i in range(600):
        key = "hot" if random.random() < 0.5 else random.choice(["a", "b", None, *[f"k{j}" for j in range(40)]])
        time = None if random.random() < 0.05 else random.randrange(50)
        rows.append((i, key, time, random.choice([None, random.randrange(100)])))
    return spark.createDataFrame(rows, "id long, key string, time int, v int").cache()


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)




def scans():
    v = F.col("v")
    return {
        "n": Scan("count"),
        "s": Scan("sum", v),
        "hi": Scan("max", v),
        "lo": Scan("min", v),
        "first": Scan("first", v),
        "last": Scan("last", v),
        "before": Scan("last", v, inclusive=False),
        "s_before": Scan("sum", v, inclusive=False),
    }


def test_hot_keys_are_found(skewed):
    found = hot_keys(skewed, ["key"], FORCED)
    assert [r["key"] for r in found.keys.collect()] == ["hot"] and found.rows == 600
    assert hot_keys(skewed, ["key"], Skew()) is None


def test_hot_scan_equals_plain_scan(skewed):
    order = ["time", "id"]
    plain = ordered_scan(skewed, ["key"], order, scans(), None)
    hot = ordered_scan(skewed, ["key"], order, scans(), FORCED)
    assert rows(plain, "id", *scans()) == rows(hot, "id", *scans())


def test_one_time_value_fills_most_of_a_hot_key(skewed):
    heavy = skewed.withColumn("time", F.when(F.col("id") % 3 > 0, 25).otherwise(F.col("time")))
    plain = ordered_scan(heavy, ["key"], ["time", "id"], scans(), None)
    hot = ordered_scan(heavy, ["key"], ["time", "id"], scans(), FORCED)
    assert rows(plain, "id", *scans()) == rows(hot, "id", *scans())


def test_text_order_falls_back_to_a_plain_window(skewed):
    named = skewed.withColumn("name", F.format_string("%05d", "id"))
    got = ranked(named, ["key"], ["name"], skew=FORCED)
    assert rows(got, "id", "rank") == rows(ranked(named, ["key"], ["id"], skew=None), "id", "rank")


def test_hot_scan_over_timestamps(skewed):
    timed = skewed.withColumn("at", F.timestamp_seconds(F.col("time").cast("long") * 3600))
    plain = ranked(timed, ["key"], ["at", "id"], skew=None)
    hot = ranked(timed, ["key"], ["at", "id"], skew=FORCED)
    assert rows(plain, "id", "rank") == rows(hot, "id", "rank")


@pytest.mark.parametrize("most", [1_000_000, 40])
@pytest.mark.parametrize("keys", [[], ["half"]])
@pytest.mark.parametrize("sent", [0, 1000])
def test_rows_at_positions(spark, skewed, monkeypatch, keys, most, sent):
    monkeypatch.setattr(positions, "MOST_SENT", sent)
    monkeypatch.setattr(positions, "MOST_SLICES", most)
    hashed = skewed.select("id", (F.col("id") % 2).alias("half"), uniform_hash("id").alias("h"))
    groups = {}
    for r in sorted(hashed.collect(), key=lambda r: (r["h"], r["id"])):
        groups.setdefault(tuple(r[k] for k in keys), []).append(r["id"])
    asked = [(*g, rank) for g, ids in groups.items() for rank in (1, 2, 17, len(ids) // 2, len(ids))]
    wanted = spark.createDataFrame(asked, ", ".join([*[f"{k} long" for k in keys], "rank long"]))
    got = rows_at(hashed, keys, "h", ["id"], wanted, 600, len(asked)).collect()
    assert sorted((*[r[k] for k in keys], r["rank"], r["id"]) for r in got) == sorted(
        (*a, groups[a[:-1]][a[-1] - 1]) for a in asked
    )


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_lookup_equals_join(spark, skewed, how):
    table = spark.createDataFrame([("hot", 1), ("a", 2), ("k3", 3)], "key string, w int")
    assert rows(lookup(skewed, table, ["key"], how, FORCED), "id", "w") == rows(
        skewed.join(table, ["key"], how), "id", "w"
    )


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_with_more_hot_keys_than_are_broadcast(spark, skewed, how):
    many = Skew(share=0.3, min_rows=1)
    assert not hot_keys(skewed, ["key"], many).few
    table = spark.createDataFrame([("hot", 1), ("a", 2), ("k3", 3)], "key string, w int")
    got = lookup(skewed, table, ["key"], how, many)
    assert rows(got, "id", "w") == rows(skewed.join(table, ["key"], how), "id", "w")


def test_hot_round_fold(spark, sf_dir):
    from quayside.catalog import views

    messages = views.messages(spark, sf_dir).withColumn("train_round", F.lit(1)).withColumn("dataset_id", F.lit("d"))
    plain = fold_rounds(messages, views.MESSAGE_ORDER, skew=None)
    hot = fold_rounds(messages, views.MESSAGE_ORDER, skew=FORCED)
    columns = ["model_id", "timestamp", "edge_id", "msg_count", "closing.peak_cpu", "closing.post", "done"]
    assert rows(plain, *columns) == rows(hot, *columns)


def test_hot_chronological_split(skewed):
    known = skewed.filter("key IS NOT NULL AND time IS NOT NULL")
    plain = chronological_split(known, ["key"], "time", ["id"], 0.3, skew=None)
    hot = chronological_split(known, ["key"], "time", ["id"], 0.3, skew=FORCED)
    assert rows(plain, "id", "split") == rows(hot, "id", "split")
