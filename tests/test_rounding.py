"""Doubles are rounded as the SQL rounds them, and no depth needs no precision."""

import random

import duckdb

from metrilith.plans import registry
from metrilith.plans.views import rounded

import __spark_entry__  # noqa: F401  registers the queries


def _against_sql(spark, folder, name, table, df):
    df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    con.execute(registry.oracle_sql()[name])
    names, want = [c[0] for c in con.description], con.fetchall()
    got = [tuple(x) for x in registry.queries()[name](spark, str(folder)).select(*names).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def test_rounded_as_sql_does(spark):
    draw = random.Random(5)
    xs = [draw.randrange(-(10**7), 10**7) / 10**p for p in range(1, 8) for _ in range(300)] + [1.005, 73.975, -73.975, 1e300, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = {row.i: row[1:] for row in df.select("i", *(rounded("x", n).alias(f"r{n}") for n in (2, 4, 6))).collect()}
    con = duckdb.connect()
    for i, x in enumerate(xs):
        assert repr([v + 0.0 if v is not None else v for v in got[i]]) == repr([v + 0.0 if v is not None else v for v in con.execute("select round($1::double, 2), round($1::double, 4), round($1::double, 6)", [x]).fetchone()])


def test_precision_of_no_depth(spark, tmp_path):
    rows = [(i, v, "error", 1) for i, v in enumerate([0.0, 30.0, 41.5, 55.25, None] * 7)]
    got = _against_sql(spark, tmp_path, "p17_p57_accuracy_annotation", "events", spark.createDataFrame(rows, "event_id bigint, value double, event_type string, user_id bigint"))
    assert any(row[1] == float("inf") and row[3] for row in got)


def test_calibrations_of_halves(spark, tmp_path):
    rows = [(3 * i + i % 3, x) for i, x in enumerate([3698.75, 3805.75, 6814.75, 3305.75, 3741.75, -12.25, 0.25])]
    _against_sql(spark, tmp_path, "src15_snk10_calibrations", "supplier", spark.createDataFrame(rows, "s_suppkey bigint, s_acctbal double"))
