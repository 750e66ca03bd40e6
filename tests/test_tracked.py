"""The tracker's stream against plain loops, restarts and timers included; the filter of many points against one at a time."""

import datetime as dt
import math
import random
import time

import numpy as np
import pytest

from metrilith.streaming import state, tracked
from metrilith.streaming.tracked import Life, Point, Rules

SCHEMA = "point_id bigint, frame bigint, t double, x double, y double, z double, score double, ok boolean"


def rows_of(points, frames, seed=5):
    rng = random.Random(seed)
    out = []
    for p in range(points):
        for f in range(frames):
            x = 3 + p + 0.1 * f + rng.gauss(0, 0.3) + 40 * (rng.random() < 0.05)
            out.append((p, f, f / 2, x, rng.gauss(0, 1), rng.gauss(0, 1), rng.random(), rng.random() > 0.3))
    return out


class Row:
    def __init__(self, r):
        _, self.frame, self.t, self.x, self.y, self.z, self.score, self.ok = r


def plain(rows, rules):
    out = []
    for p in sorted({r[0] for r in rows}):
        s = Point(Life(), [])
        out += [s.row(p, Row(r), rules, state.Filter()) for r in sorted((r for r in rows if r[0] == p), key=lambda r: (r[2], r[1]))]
    return out


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        for a, b in zip(g, w, strict=True):
            assert a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9)), (g, w)


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    rows, rules = rows_of(4, 30), Rules()
    want = plain(rows, rules)
    for k in range(3):
        part = [r for r in rows if r[1] // 10 == k]
        late = [r[:3] + (999.0,) + r[4:] for r in rows if r[1] == 10 * k - 5]  # seen before: no row
        random.Random(k).shuffle(part)
        spark.createDataFrame(part + late, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/in/batch={k}")
        source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        tracked.run(tracked.track(source, rules), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=lambda r: r[:2])
    same(got, want)
    assert {r[2] for r in got} == {"tracking", "recovering", "lost"} and {r[6] for r in got} >= {"HIGH", "MEDIUM", "LOW"}
    assert {r[-1] for r in got} >= {"updated", "predict_only", "predict_only_outlier"}


def test_silent_points_are_lost_and_a_table_gives_first_states(spark, tmp_path):
    schema = SCHEMA + ", at timestamp"
    begin = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    row = lambda p, f, ok=True: (p, f, float(f), 1.0, 0.0, 0.0, 0.9, ok, begin + dt.timedelta(seconds=f))
    initial = spark.createDataFrame([(1, 2, 1, 4, 0, 0), (9, 1, 0, 0, 0, 0)], "point_id bigint, failures int, recoveries int, recovery_frames bigint, started bigint, low_frames int")
    rules = Rules(silence=5000)
    for k, part in enumerate([[row(1, 1, False), row(2, 1)], [row(2, 20)], [row(2, 21)], [row(1, 22), row(2, 22)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/batch={k}")
        source = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in").withWatermark("at", "0 seconds")
        tracked.run(tracked.track(source, rules, initial=initial), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = [tuple(r)[:6] for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    of = lambda p: [r[1:] for r in sorted((r for r in got if r[0] == p), key=lambda r: (r[1] is not None, r[1]))]
    # point 1 had two failures in the table; it falls silent, and comes back after 22 frames
    assert of(1) == [(None, "lost", 3, 1, 4), (1, "lost", 3, 1, 4), (22, "tracking", 0, 2, 26)]
    assert of(2)[:1] == [(None, "lost", 3, 0, 0)] and of(2)[1:] == [(1, "tracking", 0, 0, 0), (20, "tracking", 0, 1, 19), (21, "tracking", 0, 1, 19), (22, "tracking", 0, 1, 19)]


@pytest.mark.parametrize(("feedback", "want"), [(False, ["LOW", "LOW", "LOW", "LOST", "LOST", "HIGH"]), (True, ["LOW", "LOW", "LOST", "LOST", "LOST", "HIGH"])])
def test_low_scores(feedback, want):
    s, rules = Life(), Rules(feedback=feedback)
    assert [tracked.grade(s, v, rules) for v in (0.3, 0.1, None, math.nan, 0.19, 0.8)] == want


def test_rules_of_values():
    rules = Rules()
    assert tracked.stabilised([(0, 5.0)], 5.5, True, rules) == pytest.approx(5.1)
    assert tracked.stabilised([(0, 5.0)], 5.76, True, rules) == 5.76  # too far from the newest one
    assert tracked.stabilised([(0, 8.0)], 8.0, True, rules) == 8.0 and tracked.stabilised([], 5.0, True, rules) == 5.0
    assert tracked.stabilised([(0, 5.0)], 5.5, False, rules) is None
    assert tracked.predicted([(0, 1.0), (2, 5.0)], 3) == 7 and tracked.predicted([(2, 1.0), (2, 5.0)], 3) == 5 and tracked.predicted([], 3) is None


def test_many_points_filter_like_one(spark):
    rng = np.random.default_rng(7)
    rows = []
    for p in range(40):
        n = int(rng.integers(1, 60)) if p else 400  # one point holds a third of all rows
        z = np.cumsum(rng.normal(0, 1, (n, 3)), 0)
        z[rng.random(n) < 0.05] += 90
        rows += [(p - 20, f, float(f // 2), *map(float, z[f])) for f in range(n)]
    df = spark.createDataFrame(rows, "point_id bigint, frame bigint, t double, x double, y double, z double").repartition(5)
    got = {(r.point_id, r.frame): (r.est_x, r.status) for r in state.kalman(df, 2.0).collect()}
    assert len(got) == len(rows)
    for p in range(-20, 20):
        own = sorted(r for r in rows if r[0] == p)
        t = np.array([r[2] for r in own])
        est, status = state.filter_series(np.array([r[3:] for r in own]), np.maximum(np.diff(t, prepend=t[0]), 1e-3), np.full((len(own), 3), 2.0))
        for r, e, s in zip(own, est, status, strict=True):
            assert got[r[:2]][1] == s and math.isclose(got[r[:2]][0], e[0], rel_tol=1e-9, abs_tol=1e-9)
    assert {s for _, s in got.values()} >= {"initialized", "updated", "predict_only_outlier", "variance_inflated"}


def test_filter_of_odd_rows(spark):
    nan = float("nan")
    rows = [(1, 0, 0.0, nan, 0.0, 0.0), (1, 1, 1.0, 1.0, 1.0, 1.0), (1, 2, 2.0, None, 1.0, 1.0), (1, 3, 3.0, 1.0, 1.0, 1.0), (None, 0, 0.0, 1.0, 1.0, 1.0), (2, 0, None, 1.0, 1.0, 1.0), (3, 0, 0.0, 1.0, 1.0, 1.0), (3, 0, 0.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "point_id bigint, frame bigint, t double, x double, y double, z double")
    got = sorted((r.point_id, r.frame, r.status, r.est_x is None) for r in state.kalman(df).collect())
    assert got == [(1, 0, "not_initialized", True), (1, 1, "initialized", False), (1, 2, "predict_only", False), (1, 3, "updated", False), (3, 0, "initialized", False), (3, 0, "updated", False)]
    assert state.kalman(df.filter("false")).count() == 0


@pytest.mark.parametrize("noise", [1.0, 100.0])
def test_one_point_steps_like_arrays(noise):
    rng, model = np.random.default_rng(3), state.Filter()
    z = np.cumsum(rng.normal(0, 1, (300, 3)), 0)
    z[rng.random(300) < 0.1] += 30
    z[rng.random(300) < 0.05] += 1e200
    x, p = model.begin(z[:1])
    one, q = model.begin_one(tuple(z[0]))
    seen = set()
    for v in z[1:]:
        dt, missing = rng.random() + 0.01, rng.random() < 0.1
        x, p, named = model.step(x, p, np.full((1, 3), np.nan) if missing else v[None], np.array([dt]), np.full((1, 3), noise))
        one, q, status = model.step_one(one, q, None if missing else tuple(v.tolist()), dt, noise)
        seen.add(status)
        assert status == named[0] and np.allclose(one, x[0], rtol=1e-9, atol=1e-9)
        assert np.allclose(np.kron(np.array([[q[0], q[1]], [q[1], q[2]]]), np.eye(3)), p[0], rtol=1e-9, atol=1e-9)
    assert seen >= {"predict_only", "updated"} and len(seen) >= 3


def test_a_row_takes_no_arrays():
    rows, s = rows_of(1, 20_000), Point(Life(), [])
    began = time.process_time()
    for r in rows:
        s.row(0, Row(r), Rules(), state.Filter())
    assert time.process_time() - began < 3.0  # 7.0 with arrays of one row, 0.4 without


def test_missing_numbers_are_failures(spark, tmp_path):
    rows = [(1, 0, 0.0, 1.0, 1.0, 1.0, 0.9, True), (1, 1, 1.0, None, 1.0, 1.0, None, True), (1, 2, 2.0, 1.0, 1.0, 1.0, 0.9, None), (1, 3, 3.0, 1.0, 1.0, 1.0, 0.9, True)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/in/batch=0")
    source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    tracked.run(tracked.track(source, Rules()), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = sorted((r.frame, r.state, r.confidence, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, "tracking", "HIGH", "initialized"), (1, "recovering", "LOW", "predict_only"), (2, "recovering", "HIGH", "predict_only"), (3, "tracking", "HIGH", "updated")]
