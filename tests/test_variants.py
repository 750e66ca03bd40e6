"""Variants written from one plan, and a record that equals a separate count."""

import json

from pyspark.sql import functions as F

from metrilith.operators import variants


def test_record_equals_a_separate_count(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "'own' as method", "id % 10 as v").repartition(5)
    many = {f"v{k}": {"accepted": F.col("v") >= k} for k in range(18)}
    record = variants.run(rows, many, ["id", "method"], {"accepted": F.col("accepted")}, f"{tmp_path}/out")
    written = spark.read.parquet(f"{tmp_path}/out")
    assert written.columns == ["id", "accepted", "method"]
    counted = {r.method: {"n": r.n, "accepted": r.a} for r in written.groupBy("method").agg(F.count("*").alias("n"), F.count_if("accepted").alias("a")).collect()}
    assert record == counted and len(record) == 18 and record["v9"] == {"n": 1000, "accepted": 100}
    assert {r.method: r.accepted for r in variants.record_table(rows, record).collect()} == {k: x["accepted"] for k, x in record.items()}
    variants.write_summary(rows, record, f"{tmp_path}/summary", {"a": 1})
    kept = json.loads(spark.read.text(f"{tmp_path}/summary").first().value)
    assert kept["variants"] == record and kept["settings"] == {"a": 1} and kept["environment"]["spark"] == spark.version


def test_one_scan_and_no_rows(spark, tmp_path):
    rows = spark.range(10).withColumn("v", F.col("id") % 2)
    both = {"a": {"x": F.col("v")}, "b": {"x": F.col("v") + 1}}
    plan = variants.expanded(rows, both, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and "Exchange" not in plan
    assert variants.run(rows.limit(0), both, ["id"], {"odd": F.col("x") == 1}, f"{tmp_path}/none") == {"a": {"n": 0, "odd": 0}, "b": {"n": 0, "odd": 0}}


def test_counting_sees_each_row_once(spark, tmp_path, monkeypatch):
    """Conditions may read the label, kept columns and the variant's, which hide the row's own of the same name."""
    rows = spark.range(1000).selectExpr("id", "id % 10 as v")
    many = {f"v{k}": {"v": F.col("v") + k, "x": F.col("v") >= k} for k in range(18)}
    seen = {"odd": F.col("v") % 2 == 1, "own": (F.col("method") == "v3") & (F.col("id") < 10), "null": F.when(F.col("x"), True)}
    counted_rows, write = [], variants.Scratch.write
    monkeypatch.setattr(variants.Scratch, "write", lambda self, df, name: counted_rows.append(df) or write(self, df, name))
    many["a/b=c%"] = many["v1"]
    record = variants.run(rows, many, ["id"], seen, f"{tmp_path}/out")
    assert len(counted_rows) == 1 and counted_rows[0].count() == 1000  # not once for each variant
    written = spark.read.parquet(f"{tmp_path}/out")
    counted = written.groupBy("method").agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in seen.items()))
    assert record == {r.method: {"n": r.n, "odd": r.odd, "own": r.own, "null": r["null"]} for r in counted.collect()}
    assert record["v3"]["own"] == 10 and record["v4"]["own"] == 0
