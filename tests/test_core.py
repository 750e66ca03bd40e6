import json
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metrilith.functions import kernels, parse
from metrilith.operators import align, temporal
from metrilith.operators.components import connected_components
from metrilith.sources import readers
from metrilith.streaming import state


def test_cells(spark):
    cells = ["", "nan", "inf", "3.0", " 1.5 ", None, "7", "x", "TRUE", "yes"]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(cells)], "k int, s string")
    s = F.col("s")
    got = df.select(parse.clean_double(s), parse.frame_or_all(s), parse.truncated_int(s), parse.flag(s)).collect()
    assert [r[0] for r in got] == [None, None, None, 3.0, 1.5, None, 7.0, None, None, None]
    assert [r[1] for r in got] == [-1, -1, -1, -1, -1, -1, 7, -1, -1, -1]
    assert [r[2] for r in got] == [None, None, None, 3, 1, None, 7, None, None, None]
    assert [r[3] for r in got] == [False] * 8 + [True] * 2


def test_jump_fixtures(spark):
    def run(xs, fraction=0.025):
        df = spark.createDataFrame([(rep, 1, k, float(x), 0.0, 2.0) for rep, own in enumerate(xs) for k, x in enumerate(own)], "rep int, p int, frame int, x double, y double, z double")
        return [(r.checks, r.jumps) for r in temporal.jumps(df, ["rep", "p"], "frame", ["x", "y", "z"], fraction).collect()]

    assert run([[0, 0.01, 0.5, 0.51]]) == [(2, 2)]
    assert run([[0, 0, 0.08]], 0.02) == [(1, 1)] and run([[0, 0, 0.08]], 0.05) == [(1, 0)]
    assert sorted(run([[0, 0.01, 0.02], [0, 0.01, 0.02]])) == [(1, 0), (1, 0)]


def test_fallback_applies_to_every_frame(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "p string, f int")
    truth = spark.createDataFrame([("a", -1, 5.0), ("a", 2, 7.0)], "p string, f int, v double")
    got = align.with_fallback(rows, truth, "p", "f", ["v"]).collect()
    assert sorted((r.p, r.f, r.v or 0.0) for r in got) == [("a", 1, 5.0), ("a", 2, 7.0), ("b", 1, 0.0)]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60)), max_size=12), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60)), max_size=12))
def test_nearest_in_time(spark, left, right):
    a = spark.createDataFrame([(i, k, t / 4) for i, (k, t) in enumerate(left)], "i int, k int, t double")
    b = spark.createDataFrame([(i, k, t / 4) for i, (k, t) in enumerate(right)], "j int, k int, t double")
    got = {r.i: r.j for r in align.nearest_in_time(a, b, ["k"], "t", 2.0, "i", "j", ["j"]).collect()}
    for i, (k, t) in enumerate(left):
        near = sorted((abs(t - u) / 4, j) for j, (m, u) in enumerate(right) if m == k and abs(t - u) / 4 <= 2)
        assert got[i] == (near[0][1] if near else None)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, edges):
    label = {x: x for e in edges for x in e}
    for _ in label:
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    df = spark.createDataFrame(edges, "u int, v int")
    assert {r.node: r.component for r in connected_components(df).collect()} == label


def test_components_of_a_long_chain(spark):
    ids = list(range(300))
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "u int, v int")
    assert {r.component for r in connected_components(df).collect()} == {0}


def run(ys, anomalies=(), **kw):
    s = state.Quarantine()
    return [state.quarantine_step(s, 0.1 * k, [0.0, float(y), 0.0], anomaly=k in anomalies, **kw) for k, y in enumerate(ys)], s


def test_quarantine_corrects_and_recovers():
    out, s = run([0, 0, 80, 0, 0], {2})
    assert out[2]["corrected"] == [0, 0, 0] and [o["mode"] for o in out] == ["NORMAL", "NORMAL", "QUARANTINED", "RECOVERY", "NORMAL"]
    assert [t for t, _ in s.trusted] == pytest.approx([0.3, 0.4]) and s.episode is None and s.episodes == 1
    out, _ = run([0, 0, 80, 10, 10], {2})
    assert [o["mode"] for o in out][3:] == ["RECOVERY", "NORMAL"]
    out, _ = run([0, 0, 80, 10.001, 10.001], {2})
    assert [o["reason"] for o in out][3:] == ["reacquiring", "reacquired"]
    out, _ = run([0, 0, 101], {2})
    assert out[2]["corrected"] is None
    out, _ = run([0, 0, math.nan, 0])
    assert out[2]["reason"] == "hard_failure"


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(p, f, float(f), rng.gauss(0, 3) + 200 * (f % 11 == 7), rng.gauss(0, 3), 0.0, False, f % 11 == 7, False) for p in range(5) for f in range(40)]
    schema = "point_id bigint, frame bigint, t double, x double, y double, z double, hard boolean, anomaly boolean, suspicious boolean"
    df = spark.createDataFrame(rows, schema)
    for k in range(4):
        df.filter(f"frame >= {10 * k} and frame < {10 * k + 10}").coalesce(1).write.parquet(f"{tmp_path}/in/batch={k}")
    want = sorted(map(tuple, state.quarantine(df).collect()))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = state.quarantine_stream(source).writeStream.format("memory").queryName("points").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = sorted(map(tuple, spark.sql("select * from points").collect()))
    assert len(want) == 200 and got == want


def test_filter_skips_outliers():
    rng = np.random.default_rng(0)
    z = np.stack([np.linspace(0, 50, 60)] * 3, 1) + rng.normal(0, 1, (60, 3))
    z[30] += 80
    est, status = state.filter_series(z, np.ones(60), np.ones((60, 3)))
    assert status[30] == "predict_only_outlier" and abs(est[30, 0] - 50 * 30 / 59) < 5
    truth = np.linspace(0, 50, 60)
    assert np.std(est[20:, 0] - truth[20:]) < np.std(np.delete(z[:, 0] - truth, 30))


def test_rigid_fit_of_many_points_with_a_bad_first_one(spark):
    """Triplets come from all points, and the order of rows changes nothing."""
    rng = np.random.default_rng(3)
    p = rng.normal(0, 100, (400, 3))
    q = p + [1, 2, 3]
    q[0] += 500
    status, _, t, inside = kernels.robust_rigid(p, q)
    assert status == "valid" and np.allclose(t, [1, 2, 3]) and inside.sum() == 399
    q[50:190] += rng.normal(0, 50, (140, 3))
    rows = [(1, i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(p, q, strict=True))]
    made = lambda x: spark.createDataFrame(x, "frame bigint, point_id bigint, px double, py double, pz double, qx double, qy double, qz double")
    one, two = (kernels.frame_motion(made(x).coalesce(1)).first() for x in (rows, rows[::-1]))
    assert one == two and one.status == "valid"


def test_kernels():
    rng = np.random.default_rng(1)
    p = rng.normal(0, 100, (8, 3))
    a = 0.3
    r = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    q = p @ r.T + [1, 2, 3]
    q[0] += 50
    status, got, t, inside = kernels.robust_rigid(p, q)
    assert status == "valid" and np.allclose(got, r) and np.allclose(t, [1, 2, 3]) and not inside[0] and inside.sum() == 7
    assert kernels.robust_rigid(p[:2], q[:2])[0] == "insufficient"
    t = np.arange(512) / 64
    x = np.sin(2 * np.pi * 5 * t)
    f, _, energy = kernels.dominant(x, 64.0, 256)
    assert f == 5.0 and energy == pytest.approx(0.5, rel=0.4)
    f, c, phase, ratio = kernels.coherence(x, 2 * np.sin(2 * np.pi * 5 * t - 0.5), 64.0, 5.0)
    assert (f, round(c, 3)) == (5.0, 1.0) and phase == pytest.approx(-0.5, abs=0.01) and ratio == pytest.approx(2, rel=0.01)
    patch = rng.random((7, 7))
    assert kernels.patch_cost(patch, patch) < 1e-6 < 0.5 < kernels.patch_cost(patch, 1 - patch)
    p1, p2 = np.eye(3, 4), np.eye(3, 4)
    p2[0, 3] = -0.1
    xyz = np.array([[0.1, 0.2, 2.0], [0, 0, 5.0]])
    left, right = xyz[:, :2] / xyz[:, 2:], (xyz[:, :2] - [0.1, 0]) / xyz[:, 2:]
    assert np.allclose(kernels.triangulated(left, right, p1, p2), xyz)
    assert kernels.bootstrap(np.array([1.0, 2.0, 3.0])) == kernels.bootstrap(np.array([1.0, 2.0, 3.0]))


def test_readers(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "one.csv").write_text("﻿rame,x\n1,nan\n2,\n")
    (tmp_path / "m" / "summary.csv").write_text("frame,x\n9,9\n")
    got = readers.method_tables(spark, str(tmp_path / "m")).collect()
    assert [(r.method, r.x) for r in got] == [("one", "nan"), ("one", None)]
    manifest = {"experiment_id": "e", "experiment_type": "E0", "gt_unit": "mm", "data_source": "s", "sequences": [{"sequence_id": "a", "split": "evaluation"}, {"sequence_id": "a", "split": "calibration"}]}
    (tmp_path / "e0.json").write_text(json.dumps(manifest, indent=1))
    with pytest.raises(ValueError, match="several splits"):
        readers.experiment(spark, str(tmp_path / "e0.json"))
    manifest["sequences"].pop()
    (tmp_path / "e1.json").write_text(json.dumps(manifest, indent=1))
    assert readers.experiment(spark, str(tmp_path / "e1.json")).count() == 1
    values = np.arange(6, dtype="<f4").reshape(2, 3)
    (tmp_path / "a.pfm").write_bytes(b"Pf\n3 2\n-1.0\n" + values[::-1].tobytes())
    r = readers.float_maps(spark, str(tmp_path / "a.pfm")).first()
    assert (r.h, r.w, r["values"]) == (2, 3, list(range(6)))
    for side in ("Left", "right"):
        (tmp_path / "pairs" / side).mkdir(parents=True)
        (tmp_path / "pairs" / side / "f1.png").write_bytes(b"x")
    assert readers.stereo_pairs(spark, str(tmp_path / "pairs")).count() == 1
    df = spark.range(10)
    assert readers.write_remaining(df.filter("id < 4"), f"{tmp_path}/t", "id") == 4 and readers.write_remaining(df, f"{tmp_path}/t", "id") == 6
    readers.write_csv(spark.createDataFrame([(1, float("nan")), (2, 0.5)], "a int, b double"), f"{tmp_path}/out", ["b", "a"])
    assert sorted(x.strip() for f in (tmp_path / "out").glob("*.csv") for x in f.read_text().split("\n") if x and x != "b,a") == [",1", "0.5,2"]


def test_a_long_stretch_is_gone_through_once(spark):
    n = 30_000
    left = spark.range(n).select(F.col("id").alias("i"), F.lit("p").alias("p"), (F.col("id") * 7 % n / n).alias("t"))
    right = spark.range(0, n, 9).select(F.col("id").alias("j"), F.when(F.col("id") % 2 == 0, "p").alias("p"), (F.col("id") / n).alias("t"))
    near = align.nearest_truth(left, right, "p", "t", 2.0, "i", "j", ["j"])
    between = align.interpolated(left, right.withColumn("p", F.lit("p")).withColumn("v", F.col("t") * 3), ["p"], "t", "v", "i")
    for df in (near, between):
        frames = re.findall(r"specifiedwindowframe\(RangeFrame, ([^)]*\(?\)?), ([^)]*\(?\)?)\)", df._jdf.queryExecution().optimizedPlan().toString())
        assert frames and not any("unboundedfollowing" in f[1].lower() for f in frames)
    got = {x.i: x.j for x in near.collect()}
    assert all(got[i] == min((k // 9 * 9, k // 9 * 9 + 9), key=lambda j: (abs(j - k), j)) for i, k in ((i, i * 7 % n) for i in range(0, n, 101)) if k < n - 9)
    assert all(abs(x.v - 3 * (x.i * 7 % n) / n) < 1e-9 for x in between.collect() if x.v is not None)
