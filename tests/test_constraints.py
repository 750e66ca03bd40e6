"""Constraints on truth files: all codes, by line, and a status for each file."""

import pytest

from metrilith.operators import constraints, stats


@pytest.fixture
def truth(spark):
    names = ["point_id", "gt_x_mm", "gt_y_mm", "gt_z_mm", "frame", "timestamp_s"]
    good = ["p", "1", "2", "3", "0", "0.5"]
    files = {
        "good": [good, ["p", "1", "2", "3", "1", "0.75"], ["q", "1", "2", "3", "0", "0.5"]],
        "bad": [good, [" ", "1", "2", "3", "0", "0.5"], ["p", "nan", "2", "3", "-1", "0.5"], ["p", "1", "", "3", "1.5", "x"], ["p", "1", "2", "3", "0", "0.25"], ["p", "1", "2", "3", "", ""]],
    }
    rows = [(f, i + 2, dict(zip(names, r, strict=True))) for f, x in files.items() for i, r in enumerate(x)]
    rows += [("fields", 2, {"point_id": "p", "gt_x_mm": "1", "frame": "bad"}), ("unaligned", 2, dict(zip(names[:5], good[:5], strict=True)))]
    expected = [(f, "timestamp") for f in ("good", "bad", "fields", "unaligned", "empty")]
    return spark.createDataFrame(rows, "file string, line int, cells map<string,string>"), spark.createDataFrame(expected, "file string, alignment string")


def test_all_codes_by_line(truth):
    found = constraints.truth_issues(*truth)
    got = sorted((r.file, r.line, r.code) for r in found.collect() if r.line is not None)
    assert got == sorted([("bad", 3, "GT_POINT_ID"), ("bad", 4, "GT_XYZ"), ("bad", 4, "GT_FRAME"), ("bad", 4, "GT_DUPLICATE_TIMESTAMP"), ("bad", 4, "GT_TIMESTAMP_ORDER"), ("bad", 5, "GT_XYZ"), ("bad", 5, "GT_FRAME"), ("bad", 5, "GT_TIMESTAMP"), ("bad", 6, "GT_DUPLICATE_FRAME"), ("bad", 6, "GT_TIMESTAMP_ORDER")])
    whole = {(r.file, r.code, r.message) for r in found.filter("line is null").collect()}
    assert whole == {("fields", "GT_FIELDS", "missing GT fields gt_y_mm, gt_z_mm"), ("unaligned", "GT_ALIGNMENT_FIELD", "missing timestamp_s"), ("empty", "GT_EMPTY", "GT has no records")}
    status = {r.file: r.status for r in constraints.verdicts(found, truth[1]).collect()}
    assert status == {"good": "PASS", "bad": "FAIL", "fields": "FAIL", "unaligned": "FAIL", "empty": "FAIL"}


def test_warnings_and_no_rows(spark, truth):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("b", 1, 7)], "file string, line int, v int")
    rules = constraints.Constraints("file", "line", (), (constraints.Rule("V", F.col("v").isNull(), "no value", constraints.WARNING),))
    found = constraints.issues(rows, rules)
    assert [tuple(r)[:4] for r in found.collect()] == [("a", 2, "WARNING", "V")]
    assert {r.file: r.status for r in constraints.verdicts(found, rows.select("file").distinct()).collect()} == {"a": "WARNING", "b": "PASS"}
    assert {r.code for r in constraints.truth_issues(truth[0].limit(0), truth[1]).collect()} == {"GT_EMPTY"}


def test_numbers_over_partitions(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as a", "id % 3 as b").repartition(7)
    assert all(r.at == r.a + 1 for r in stats.numbered(df, ["a"], "at").collect())


@pytest.mark.parametrize("span", [3, 1 << 20])
def test_one_large_group_is_looked_at_in_stretches(spark, monkeypatch, span):
    import random

    from pyspark.sql import functions as F

    monkeypatch.setattr(constraints, "SPAN", span, raising=False)
    rng = random.Random(5)
    values = [rng.choice([None, *range(12)]) for _ in range(200)]
    rows = spark.createDataFrame([("a", i + 2, v) for i, v in enumerate(values)] + [("b", 2, 5), ("b", 90, 4)], "file string, line int, v int")
    found = constraints.issues(rows, constraints.Constraints("file", "line", (), (constraints.Unique("U", F.col("v"), "again"), constraints.Increasing("I", F.col("v"), "not above"))))
    want, last = [("b", 90, "I")], None
    for i, v in enumerate(values):
        if v is None:
            continue
        want += [("a", i + 2, "U")] * (v in values[:i]) + [("a", i + 2, "I")] * (last is not None and v <= last)
        last = v
    assert sorted((r.file, r.line, r.code) for r in found.collect()) == sorted(want)
    # a window over whole files sees ends of stretches only
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by(__rule_1" in plan and plan.count("Window [") == 3
