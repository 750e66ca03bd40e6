"""Numeric kernels that columns can't express; applied to groups or arrays inside tasks."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def rigid_fit(p: np.ndarray, q: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and shift that take p to q with the least weighted squared distance."""
    w = np.ones(len(p)) if w is None else w
    cp, cq = np.average(p, 0, w), np.average(q, 0, w)
    u, _, vt = np.linalg.svd((p - cp).T @ ((q - cq) * w[:, None]))
    r = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
    return r, cq - r @ cp


def _triplets(n: int, most: int, seed: int) -> list[tuple[int, ...]]:
    """All triplets of n points, or `most` distinct ones drawn from all of them."""
    if math.comb(n, 3) <= most:
        return list(itertools.combinations(range(n), 3))
    rng = np.random.default_rng(seed)
    picks: set[tuple[int, ...]] = set()
    while len(picks) < most:
        x = tuple(sorted(rng.integers(0, n, 3).tolist()))
        if len(set(x)) == 3:
            picks.add(x)
    return sorted(picks)


def robust_rigid(p: np.ndarray, q: np.ndarray, tolerance: float = 3.0, least_share: float = 0.6, most: int = 100, seed: int = 0) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Status, rotation, shift and inliers; three-point fits vote, and the winners' inliers are fitted once more."""
    none = ("insufficient", np.eye(3), np.zeros(3), np.zeros(len(p), bool))
    if len(p) < 3:
        return none
    best = none[3]
    for pick in map(list, _triplets(len(p), most, seed)):
        if np.linalg.matrix_rank(p[pick] - p[pick].mean(0), tol=1e-9) < 2:
            continue
        r, t = rigid_fit(p[pick], q[pick])
        inside = np.linalg.norm(p @ r.T + t - q, axis=1) <= tolerance
        if inside.sum() > best.sum():
            best = inside
    if best.sum() < 3 or best.mean() < least_share:
        return ("degenerate" if not best.any() else "low_inlier_ratio", *none[1:3], best)
    return ("valid", *rigid_fit(p[best], q[best]), best)


#: Columns that settle the order of rows that share a point_id.
XYZ = ["px", "py", "pz", "qx", "qy", "qz"]


def frame_motion(df: DataFrame) -> DataFrame:
    """Rigid motion of each frame's reference points (px, py, pz) to (qx, qy, qz): status, rotation, shift, inliers.

    Rows are taken by point_id, so that the order in which they arrive changes nothing.
    """
    schema = "frame bigint, status string, rotation array<double>, shift array<double>, inliers int"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["point_id", *XYZ])
        status, r, t, inside = robust_rigid(pdf[["px", "py", "pz"]].to_numpy(float), pdf[["qx", "qy", "qz"]].to_numpy(float))
        return pd.DataFrame({"frame": [key[0]], "status": [status], "rotation": [r.ravel()], "shift": [t], "inliers": [int(inside.sum())]})

    return df.groupBy("frame").applyInPandas(run, schema)


def rotations(covariance: np.ndarray) -> np.ndarray:
    """For each 3 x 3 sum of w (p - cp)(q - cq)^T, n of them, the rotation that takes p to q with the least weighted squared distance."""
    u, _, vt = np.linalg.svd(covariance)
    turn = np.linalg.det(np.swapaxes(vt, 1, 2) @ np.swapaxes(u, 1, 2)) < 0
    vt[turn, 2] *= -1
    return np.swapaxes(vt, 1, 2) @ np.swapaxes(u, 1, 2)


def rigid_fits(p: np.ndarray, q: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations and shifts of n weighted groups of points (n, k, 3)."""
    w = w / w.sum(1, keepdims=True)
    cp, cq = np.einsum("nk,nki->ni", w, p), np.einsum("nk,nki->ni", w, q)
    r = rotations(np.einsum("nk,nki,nkj->nij", w, p - cp[:, None], q - cq[:, None]))
    return r, cq - np.einsum("nij,nj->ni", r, cp)


def flat(points: np.ndarray) -> np.ndarray:
    """Whether each of n groups of points (n, k, 3) lies on a line."""
    return np.linalg.matrix_rank(points - points.mean(1, keepdims=True), tol=1e-10) < 2


def triplets(n: int, most: int) -> np.ndarray:
    """All triplets of n places, or, if they are more than `most`, as many that don't meet (from 3 * most places on) or are drawn by a fixed seed."""
    if n * (n - 1) * (n - 2) // 6 <= most:
        return np.array(list(itertools.combinations(range(n), 3)), np.int64).reshape(-1, 3)
    if n >= 3 * most:
        return np.arange(3 * most).reshape(most, 3)
    rng = np.random.default_rng(0)
    picks: set[tuple[int, ...]] = set()
    while len(picks) < most:
        picks.add(tuple(sorted(rng.choice(n, 3, replace=False).tolist())))
    return np.array(sorted(picks), np.int64)


def _segments(x: np.ndarray, n: int) -> np.ndarray:
    """Half-overlapping segments, each without its line of best fit, under a Hann window."""
    step = n - n // 2
    s = np.stack([x[a : a + n] for a in range(0, len(x) - n + 1, step)])
    t = np.arange(n) - (n - 1) / 2
    s = s - s.mean(1, keepdims=True)
    s -= (s @ t / (t @ t))[:, None] * t
    return s * np.hanning(n + 1)[:-1]


def spectra(x: np.ndarray, y: np.ndarray, fs: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and the averaged one-sided cross spectral density of two series."""
    n = min(n, len(x))
    a, b = np.fft.rfft(_segments(x, n)), np.fft.rfft(_segments(y, n))
    w = np.hanning(n + 1)[:-1]
    p = (a.conj() * b).mean(0) / (fs * (w @ w))
    p[1 : len(p) - (n % 2 == 0)] *= 2
    return np.fft.rfftfreq(n, 1 / fs), p


def dominant(x: np.ndarray, fs: float, n: int = 64, half_width: float = 0.5) -> tuple[float, float, float]:
    """Frequency of the largest density above zero, its root, and the energy around it."""
    f, p = spectra(x, x, fs, n)
    p = p.real
    k = 1 + int(np.argmax(p[1:]))
    band = np.abs(f - f[k]) <= half_width
    return float(f[k]), float(np.sqrt(max(p[k], 0))), float(np.trapezoid(p[band], f[band]))


def coherence(x: np.ndarray, y: np.ndarray, fs: float, target: float, n: int = 64) -> tuple[float, float, float, float]:
    """At the frequency nearest to the target: frequency, coherence, phase and amplitude ratio of y to x."""
    f, xy = spectra(x, y, fs, n)
    xx, yy = (spectra(v, v, fs, n)[1].real for v in (x, y))
    k = int(np.argmin(np.abs(f - target)))
    c = float(np.clip(abs(xy[k]) ** 2 / max(xx[k] * yy[k], 1e-300), 0, 1))
    return float(f[k]), c, float(np.angle(xy[k])), float(np.sqrt(max(yy[k], 0) / max(xx[k], 1e-15)))


def patch_cost(a: np.ndarray, b: np.ndarray, census: float = 0.6) -> float:
    """Cost in [0, 1] of two patches: share of differing centre comparisons, and 1 - normalised correlation."""
    a, b = np.asarray(a, np.float32), np.asarray(b, np.float32)
    mid = a.shape[0] // 2, a.shape[1] // 2
    bits = float(np.mean((a > a[mid]) != (b > b[mid])))
    da, db = a - a.mean(), b - b.mean()
    norm = float(np.sqrt((da * da).sum() * (db * db).sum()))
    zncc = float((da * db).sum()) / norm if norm > 1e-9 else 0.0
    return census * bits + (1 - census) * (1 - zncc) / 2


def triangulated(left: np.ndarray, right: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
    """Points (n, 3) seen at (n, 2) in two views, each from the null vector of its four equations."""
    a = np.stack([left[:, :1] * p1[2] - p1[0], left[:, 1:] * p1[2] - p1[1], right[:, :1] * p2[2] - p2[0], right[:, 1:] * p2[2] - p2[1]], axis=1)
    h = np.linalg.svd(a)[2][:, -1]
    return h[:, :3] / h[:, 3:]


def bootstrap(diff: np.ndarray, rounds: int = 10_000, seed: int = 2026) -> tuple[float, float, float]:
    """Mean of paired differences and its 2.5 and 97.5 percentiles over resamples."""
    rng = np.random.default_rng(seed)
    means = np.concatenate([rng.choice(diff, (min(500, rounds - a), len(diff))).mean(1) for a in range(0, rounds, 500)])
    return float(diff.mean()), *map(float, np.percentile(means, [2.5, 97.5]))
