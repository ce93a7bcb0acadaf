"""Compare a Spark result with the same question asked in DuckDB."""

import math
import os

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, name)}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return _plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return repr(value)


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(df, con, sql):
    """Return (number of rows, list of complaints)."""
    spark_rows = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    duck_rows = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return len(spark_rows), [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    left, right = normal_rows(df.columns, spark_rows), normal_rows(names, duck_rows)
    problems = []
    if len(left) != len(right):
        problems.append(f"rows {len(left)} vs {len(right)}")
    only_left, only_right = sorted(set(left) - set(right)), sorted(set(right) - set(left))
    if only_left or only_right:
        problems.append(f"{len(only_left)} / {len(only_right)} differ: {only_left[:2]} vs {only_right[:2]}")
    elif left != right:
        problems.append("multiplicities differ")
    return len(spark_rows), problems
