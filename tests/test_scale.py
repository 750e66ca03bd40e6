"""Operators that keep hot keys out of one task, against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from metrilith.functions import decisions
from metrilith.operators import align, generators, stats, temporal
from metrilith.plans import errors

SHARES = {"low": 0.0, "mid": 0.5, "p95": 0.95, "top": 1.0}


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(3)
    hot = pd.DataFrame({"k": "hot", "v": np.round(rng.normal(0, 50, 6000), 1)})
    flat = pd.DataFrame({"k": "flat", "v": np.full(900, 7.0)})
    few = pd.DataFrame({"k": ["one", "two", "two"], "v": [3.0, 1.0, 2.0]})
    return pd.concat([hot, flat, few], ignore_index=True)


def test_quantiles_of_hot_tied_and_tiny_keys(spark, values):
    got = stats.quantiles(spark.createDataFrame(values), ["k"], "v", SHARES).toPandas().set_index("k")
    for k, g in values.groupby("k"):
        assert np.allclose(got.loc[k, list(SHARES)].astype(float), np.quantile(g.v, list(SHARES.values())))


def test_quantiles_without_keys_nulls_and_rows(spark, values):
    df = spark.createDataFrame(values).unionByName(spark.createDataFrame([("hot", None), (None, float("nan")), (None, None)], "k string, v double"))
    row = stats.quantiles(df, [], "v", SHARES).first()
    assert np.allclose([row[n] for n in SHARES], np.quantile(values.v, list(SHARES.values())))
    assert stats.quantiles(df.filter("v is null"), ["k"], "v", SHARES).count() == 0


def test_running_sums(spark, values):
    df = spark.createDataFrame(values.reset_index()).withColumn("w", F.lit(2))
    got = stats.running(df, ["k"], "v", "w", ["index"]).toPandas().sort_values(["k", "v", "index"])
    want = values.reset_index().sort_values(["k", "v", "index"])
    assert (got.upto.to_numpy() == (want.groupby("k").cumcount() + 1).to_numpy() * 2).all()
    assert (got.groupby("k").total.first() == 2 * values.groupby("k").size()).all()


def test_null_keys_are_keys_and_rows_that_go_take_no_part(spark):
    df = spark.createDataFrame([(None, 1.0, 5.0), (None, 3.0, 6.0), ("a", 1.0, None), ("a", 2.0, 7.0)], "k string, v double, u double")
    got = {r.k: r.mid for r in stats.quantiles(df, ["k"], "v", {"mid": 0.5}).collect()}
    assert got == {None: 2.0, "a": 1.5}
    sums = stats.running(df.withColumn("w", F.lit(1)), ["k"], "v", "w").collect()
    assert sorted((str(r.k), r.upto, r.total) for r in sums) == [("None", 1, 2), ("None", 2, 2), ("a", 1, 2), ("a", 2, 2)]
    assert [(r.rank_v, r.rank_u) for r in stats.with_ranks(df, ["k"], ["v", "u"]).collect()] == [(1.0, 1.0)]


def test_ranks_of_ties(spark, values):
    got = stats.with_ranks(spark.createDataFrame(values), ["k"], ["v"]).toPandas()
    want = values.assign(rank_v=values.groupby("k").v.rank())
    order = ["k", "v", "rank_v"]
    assert np.allclose(got.sort_values(order).rank_v.astype(float), want.sort_values(order).rank_v)


def test_one_to_one_rejects_repeats(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None)], "k int, a double")
    b = spark.createDataFrame([(1, 5.0), (2, 6.0)], "k int, b double")
    assert sorted(map(tuple, align.one_to_one(a, b, ["k"]).collect())) == [(1, 2.0, 5.0), (2, None, 6.0)]
    with pytest.raises(Exception, match="repeat"):
        align.one_to_one(a, b.union(b), ["k"]).collect()


def test_stage_never_falls_back(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "id int, measured_x double, measured_y double, measured_z double")
    assert decisions.stage(df, "measured").columns == ["id", "x", "y", "z"]
    with pytest.raises(ValueError, match="FINAL_XYZ_UNAVAILABLE"):
        decisions.stage(df, "final")
    with pytest.raises(ValueError, match="unknown stage"):
        decisions.stage(df, "guessed")


def test_nulls_give_no_evidence(spark):
    row = spark.range(1).select(
        decisions.visual_evidence(F.lit(None).cast("double"), F.lit(None).cast("double")).alias("none"),
        decisions.visual_evidence(F.lit(None).cast("double"), F.lit(0.0)).alias("some"),
        decisions.weighted_mean([(F.lit(None).cast("double"), 1.0)]).alias("mean"),
        decisions.clip(F.lit(None).cast("double"), 0, 1).alias("clip"),
        decisions.safety_reasons(F.lit(None).cast("double"), F.lit(True), F.lit(None).cast("boolean"), F.lit(True), F.lit(True), F.lit("NORMAL")).alias("why"),
    ).first()
    assert (row["none"], row["some"], row["mean"], row["clip"]) == (None, 1.0, None, None)
    assert row["why"] == "candidate_not_finite+correction_unauthorized+i2_state_disallows_candidate"


def test_spectral_window_finds_the_sine(spark):
    f = generators.frames(spark, 120, 30.0).withColumn("x", generators.sines([(5, 3.75)])).withColumn("p", F.lit(1))
    got = temporal.spectral(f, ["p"], "frame", "x", 30.0).toPandas()
    assert len(got) == 120 - 15
    assert np.allclose(got[got.frame >= 63].frequency, 3.75)


def test_evenly_spaced_places(spark):
    for n in (3, 7, 8, 50):
        got = [r.id for r in spark.range(n).filter(temporal.evenly(F.col("id"), F.lit(n), 7)).collect()]
        assert got == (list(range(n)) if n <= 7 else np.linspace(0, n - 1, 7, dtype=int).tolist())


def test_medians_meet_their_rows_by_broadcast(spark, small, monkeypatch):
    seen, plain = [], errors.quantiles
    monkeypatch.setattr(errors, "quantiles", lambda df, *a: (seen.append(df), plain(df, *a))[1])
    errors.a58(spark, small)
    # joined by method, all rows of one would meet in one task
    assert "strategy=broadcast" in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_places_of_hot_null_and_tiny_keys(spark):
    """Each row's place in its key; no window brings a key's rows together."""
    rows = [("hot" if i % 7 else None, (i * 7919) % 1000, i) for i in range(1000)] + [("one", 5, 0)]
    got = stats.placed(spark.createDataFrame(rows, "k string, v int, index int").repartition(5), ["k"], ["v"], "at")
    want = {k: sorted(v for key, v, _ in rows if key == k) for k in ("hot", None, "one")}
    assert sorted((str(r.k), r.v, r["at"]) for r in got.collect()) == sorted((str(k), v, i + 1) for k, x in want.items() for i, v in enumerate(x))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join Inner" in x]
    assert len(joins) == 1 and "__c" in joins[0]  # by key and partition, not by key
