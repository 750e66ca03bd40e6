"""Rigid motion of frames by sums against a plain loop over each frame."""

import itertools
import math
import random

import numpy as np
import pytest

from metrilith.operators import motion

SCHEMA = "frame bigint, point_id string, px double, py double, pz double, qx double, qy double, qz double, w double"


def turned(a, b):
    x, y = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]]), np.array([[1, 0, 0], [0, math.cos(b), -math.sin(b)], [0, math.sin(b), math.cos(b)]])
    return x @ y


def plain_fit(p, q, w):
    w = w / w.sum()
    cp, cq = w @ p, w @ q
    u, _, vt = np.linalg.svd((p - cp).T @ ((q - cq) * w[:, None]))
    r = vt.T @ u.T
    if np.linalg.det(r) < 0:
        vt[2] *= -1
        r = vt.T @ u.T
    return r, cq - r @ cp


def on_a_line(p):
    return np.linalg.matrix_rank(p - p.mean(0), tol=1e-10) < 2


def plain(rows, tolerance=3.0, share=0.6, longest=3.0):
    """Status, rotation, shift, inliers and rmse of one frame, trying all triplets."""
    rows = [r for r in rows if all(v is not None and math.isfinite(v) for v in r[2:8])]
    if len(rows) < 3:
        return ("insufficient_references", None, None, 0, None)
    if any(r[8] is None or not 0 < r[8] < math.inf for r in rows):
        return ("invalid_references", None, None, 0, None)
    x = np.array([r[2:] for r in rows], float)
    p, q, w = x[:, :3], x[:, 3:6], x[:, 6]
    if on_a_line(p) or on_a_line(q):
        return ("degenerate_references", None, None, 0, None)
    best, seen = None, False
    for pick in map(list, itertools.combinations(range(len(p)), 3)):
        if on_a_line(p[pick]) or on_a_line(q[pick]):
            continue
        seen = True
        r, t = plain_fit(p[pick], q[pick], w[pick])
        e = np.linalg.norm(p @ r.T + t - q, axis=1)
        inside = e <= tolerance
        key = (-inside.sum(), (e[inside] ** 2).sum())
        if inside.sum() >= max(3, math.ceil(share * len(p))) and (best is None or key < best[0]):
            best = key, inside
    if best is None:
        return ("ransac_failed" if seen else "degenerate_references", None, None, 0, None)
    inside = best[1]
    r, t = plain_fit(p[inside], q[inside], w[inside])
    rmse = math.sqrt((np.linalg.norm(p[inside] @ r.T + t - q[inside], axis=1) ** 2).mean())
    return ("rmse_exceeded", None, None, 0, rmse) if rmse > longest else ("valid", r, t, int(inside.sum()), rmse)


def frames():
    rng = np.random.default_rng(4)
    out = []

    def add(frame, p, q, w=None):
        w = np.ones(len(p)) if w is None else w
        out.extend((frame, f"p{i}", *map(float, p[i]), *map(float, q[i]), None if w[i] is None else float(w[i])) for i in range(len(p)))

    for f in range(12):
        n = int(rng.integers(3, 9))
        p = rng.normal(1000, 100, (n, 3))
        q = p @ turned(0.2 * f, 0.1 * f).T + [5, -2, f] + rng.normal(0, 0.8, (n, 3))
        if f % 3 == 0 and n > 4:
            q[0] += 300
        add(f, p, q, rng.uniform(0.1, 5, n))
    p = rng.normal(0, 100, (6, 3))
    add(20, p[:2], p[:2])
    add(21, p, p, [1, 1, 0, 1, 1, 1])
    add(22, p, p, [1, 1, None, 1, 1, 1])
    add(23, np.outer(np.arange(6), [1, 2, 3]), p)
    add(24, p, rng.normal(0, 1000, (6, 3)))
    add(25, np.vstack([p, [[math.nan, 0, 0]]]), np.vstack([p, p[:1]]))
    add(26, np.full((3, 3), math.nan), np.zeros((3, 3)))
    return out


def close(a, b):
    return a is None and b is None or a is not None and b is not None and np.allclose(np.ravel(a), np.ravel(b), atol=1e-6)


@pytest.mark.parametrize("longest", [3.0, 0.5])
def test_frames_against_plain_loops(spark, longest):
    rows = frames()
    got = {}
    for order in (rows, random.Random(2).sample(rows, len(rows))):
        df = spark.createDataFrame(order, SCHEMA).repartition(3)
        found = {r.frame: r for r in motion.frame_motion(df, longest=longest).collect()}
        assert set(found) == {r[0] for r in rows}
        for f, r in found.items():
            want = plain([x for x in rows if x[0] == f], longest=longest)
            assert r.status == want[0] and r.inliers == want[3], (f, r, want)
            assert close(r.rotation, want[1]) and close(r.shift, want[2]) and close(r.rmse, want[4]), (f, r, want)
            got[f] = r.status
    assert set(got.values()) >= {"insufficient_references", "invalid_references", "degenerate_references", "ransac_failed"} | ({"rmse_exceeded"} if longest < 1 else {"valid"})


def test_a_large_frame_among_small_ones(spark):
    """A frame of 20,000 points, two in five of them wrong, far from the origin."""
    rng = np.random.default_rng(8)
    n = 20_000
    p = rng.normal(0, 100, (n, 3)) + [1e5, -1e5, 5e4]
    r, t = turned(0.4, -0.3), np.array([10.0, 20.0, -30.0])
    q = p @ r.T + t + rng.normal(0, 0.1, (n, 3))
    bad = rng.random(n) < 0.25
    q[bad] += rng.normal(0, 500, (int(bad.sum()), 3))
    rows = [(7, f"p{i}", *map(float, (*p[i], *q[i])), 1.0) for i in range(n)] + [(8, "a", *map(float, p[0]), *map(float, q[0]), 1.0)]
    got = {x.frame: x for x in motion.frame_motion(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert got[8].status == "insufficient_references" and got[7].status == "valid"
    assert got[7].inliers >= (~bad).sum() and np.allclose(np.reshape(got[7].rotation, (3, 3)), r, atol=1e-4) and abs(got[7].rmse - 0.1 * math.sqrt(3)) < 0.05


def test_single_reference_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "b", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0), (1, "a", 1.0, 2.0, 3.0, 4.0, 4.0, 4.0, 1.0), (2, "a", None, 2.0, 3.0, 4.0, 4.0, 4.0, 1.0)], SCHEMA)
    got = {r.frame: r for r in motion.frame_motion(rows, single=True).collect()}
    assert got[1].status == "single_reference" and got[1].shift == [3.0, 2.0, 1.0] and got[1].rotation == [1, 0, 0, 0, 1, 0, 0, 0, 1]
    assert got[2].status == "insufficient_references" and got[2].shift is None
    assert motion.frame_motion(rows.limit(0)).count() == 0
