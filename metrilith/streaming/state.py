"""State machines of tracked points, as pure steps, batch operators and a stream operator.

A step takes the state of one key and its next observation and returns both the new state
and an output row. The batch operators run it over each key's rows in order; the stream
operator keeps the state between micro-batches.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# --- quarantine -------------------------------------------------------------------------


@dataclass
class Quarantine:
    """What a point remembers: its mode, the two newest trusted observations (t, xyz), clean ones that wait for confirmation, and its episode."""

    mode: str = "NORMAL"
    trusted: list = field(default_factory=list)
    returning: list = field(default_factory=list)
    fresh: list = field(default_factory=list)
    episode: int | None = None
    episodes: int = 0


@dataclass(frozen=True)
class Limits:
    correction: float = 100.0
    consistency: float = 10.0
    gap: float = 1.0
    confirmations: int = 2


def predicted(trusted: list, t: float, gap: float) -> list[float] | None:
    """Constant velocity from the two newest trusted observations; the newest alone over a long gap."""
    if not trusted:
        return None
    t1, p1 = trusted[-1]
    if t < t1:
        raise ValueError("observations have to come in order of time")
    if len(trusted) < 2 or t - t1 > gap:
        return list(p1)
    t0, p0 = trusted[-2]
    return [b + (b - a) / (t1 - t0) * (t - t1) for a, b in zip(p0, p1, strict=True)]


def quarantine_step(s: Quarantine, t: float, xyz: list[float], hard: bool = False, anomaly: bool = False, suspicious: bool = False, safe: bool = True, limits: Limits = Limits()) -> dict:
    """Advance `s` by one observation; the output names the mode, any correction and why.

    Only observations that are confirmed to be normal enter the history that predicts.
    A quarantine ends by enough observations in a row near the prediction, or, where
    the prediction is stale, by two safe ones near each other, which replace the history.
    """
    guess = predicted(s.trusted, t, limits.gap)
    near = guess is not None and math.dist(guess, xyz) <= limits.consistency
    away = s.mode in ("QUARANTINED", "RECOVERY")
    corrected, kept = None, False

    def leave(trusted: list) -> None:
        s.trusted, s.mode, s.episode, s.returning, s.fresh = trusted[-2:], "NORMAL", None, [], []

    def enter() -> None:
        if s.episode is None:
            s.episodes += 1
            s.episode = s.episodes
        s.mode, s.returning, s.fresh = "QUARANTINED", [], []

    if hard or not all(map(math.isfinite, xyz)):
        enter()
        why = "hard_failure"
    elif away and near:
        s.fresh = []
        s.returning = [*s.returning, [t, xyz]] if s.mode == "RECOVERY" else [[t, xyz]]
        if s.mode == "RECOVERY" and len(s.returning) >= limits.confirmations:
            leave([*s.trusted, *s.returning])
            why, kept = "recovered", True
        else:
            s.mode, why = "RECOVERY", "recovering"
    elif anomaly:
        enter()
        if guess is not None and safe and math.dist(guess, xyz) <= limits.correction:
            corrected, why = guess, "corrected"
        else:
            why = "not_corrected"
    elif away and guess is not None and safe:
        s.mode, s.returning = "QUARANTINED", []
        if not s.fresh:
            s.fresh, why = [[t, xyz]], "reacquiring"
        elif t > s.fresh[0][0] and math.dist(s.fresh[0][1], xyz) <= limits.consistency:
            leave([s.fresh[0], [t, xyz]])
            why, kept = "reacquired", True
        else:
            s.fresh, why = [], "inconsistent"
    elif away:
        why = "unresolved" if s.mode == "QUARANTINED" else "recovery_broken"
        enter()
    elif suspicious:
        s.mode, why = "SUSPECT", "suspect"
    else:
        if s.trusted and t <= s.trusted[-1][0]:
            raise ValueError("trusted observations need increasing times")
        leave([*s.trusted, [t, xyz]])
        why, kept = "normal", True
    return {"mode": s.mode, "prediction": guess, "corrected": corrected, "trusted": kept, "episode": s.episode, "reason": why}


_OUT = "point_id bigint, frame bigint, t double, mode string, y double, corrected_y double, trusted boolean, episode int, reason string"


def _row(point_id: int, r, s: Quarantine, limits: Limits) -> tuple:
    o = quarantine_step(s, r.t, [r.x, r.y, r.z], bool(r.hard), bool(r.anomaly), bool(r.suspicious), True, limits)
    return point_id, r.frame, r.t, o["mode"], r.y, o["corrected"][1] if o["corrected"] else None, o["trusted"], o["episode"], o["reason"]


def quarantine(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Run the machine over every point's rows (point_id, frame, t, x, y, z, hard, anomaly, suspicious) in order of time."""
    names = [c.split()[0] for c in _OUT.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = Quarantine()
        rows = [_row(int(key[0]), r, s, limits) for r in pdf.sort_values(["t", "frame"]).itertuples()]
        return pd.DataFrame(rows, columns=names).astype({"episode": "Int32", "corrected_y": "float64"})

    return df.groupBy("point_id").applyInPandas(run, _OUT)


class QuarantineProcessor(StatefulProcessor):
    """The same machine over a stream: rows of a batch are taken in order of time, and rows older than what a point has seen already are late and skipped."""

    def __init__(self, limits: Limits = Limits()):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("point", "state string, newest double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        s = Quarantine(**json.loads(held[0])) if held else Quarantine()
        newest = held[1] if held else -math.inf
        out = []
        for r in pd.concat(rows).sort_values(["t", "frame"]).itertuples():
            if r.t > newest:
                out.append(_row(int(key[0]), r, s, self.limits))
                newest = r.t
        self.state.update((json.dumps(asdict(s)), newest))
        names = [c.split()[0] for c in _OUT.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({"episode": "Int32", "corrected_y": "float64", "point_id": "int64", "frame": "int64", "trusted": "boolean"})

    def close(self) -> None:
        pass


def quarantine_stream(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The machine over a stream of observations; state is kept by Spark's state store."""
    return df.groupBy("point_id").transformWithStateInPandas(QuarantineProcessor(limits), _OUT, "append", "none")


# --- adaptive filter ---------------------------------------------------------------------

#: Gates on the normalised innovation: above the first noise is inflated, above the second the measurement is skipped.
SOFT, HARD, INFLATE = 7.815, 16.266, 4.0


@dataclass(frozen=True)
class Filter:
    """Variances: of a step's process for places and speeds, and of both at the beginning."""

    q_pos: float = 0.05
    q_vel: float = 0.05
    p_pos: float = 1.0
    p_vel: float = 10.0

    def begin(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States (n, 2d) and covariances (n, 2d, 2d) of points first seen at z (n, d)."""
        n, d = z.shape
        return np.concatenate([z, np.zeros((n, d))], 1), np.tile(np.diag([self.p_pos] * d + [self.p_vel] * d), (n, 1, 1))

    def step(self, x: np.ndarray, p: np.ndarray, z: np.ndarray, dt: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """New states and covariances, and statuses, of n points at once, each with its own dt (n) and noise (n, d).

        The coordinates of a point share gates: a measurement is judged by the sum over all
        of them. One that isn't finite is no measurement: the point is only predicted.
        """
        n, d = z.shape
        f, q = np.tile(np.eye(2 * d), (n, 1, 1)), np.zeros((n, 2 * d, 2 * d))
        at = np.arange(d)
        f[:, at, at + d] = dt[:, None]
        q[:, at, at], q[:, at + d, at + d] = self.q_pos * dt[:, None] ** 2, self.q_vel * dt[:, None]
        x = (f @ x[:, :, None])[:, :, 0]
        p = f @ p @ f.transpose(0, 2, 1) + q
        seen = np.isfinite(z).all(1)
        e = np.where(seen[:, None], z - x[:, :d], 0.0)
        r = np.zeros((n, d, d))
        r[:, at, at] = noise
        s = p[:, :d, :d] + r
        nis = (e * np.linalg.solve(s, e[:, :, None])[:, :, 0]).sum(1)
        soft = nis > SOFT
        r[soft] *= INFLATE
        g = np.linalg.solve(p[:, :d, :d] + r, p[:, :d]).transpose(0, 2, 1)
        a = np.eye(2 * d) - g @ np.eye(d, 2 * d)
        after = a @ p @ a.transpose(0, 2, 1) + g @ r @ g.transpose(0, 2, 1)
        taken = seen & (nis <= HARD)
        x = np.where(taken[:, None], x + (g @ e[:, :, None])[:, :, 0], x)
        p = np.where(taken[:, None, None], (after + after.transpose(0, 2, 1)) / 2, p)
        return x, p, np.select([~seen, ~taken, soft], ["predict_only", "predict_only_outlier", "variance_inflated"], "updated").astype(object)

    def begin_one(self, z: tuple) -> tuple[list, list]:
        """State of a single point as `step_one` has it."""
        return [*map(float, z), *[0.0] * len(z)], [self.p_pos, 0.0, self.p_vel]

    def step_one(self, x: list, p: list, z: tuple | None, dt: float, noise: float) -> tuple[list, list, str]:
        """The step of one point in plain numbers, which cost far less than arrays of one row.

        With one noise for all coordinates their covariances are equal and none goes from one
        to another, so p holds only a place's variance, its covariance with the speed and the
        speed's variance. No z is no measurement.
        """
        d = len(x) // 2
        place, speed = [a + dt * b for a, b in zip(x[:d], x[d:], strict=True)], x[d:]
        pp, pv, vv = p
        pp, pv, vv = pp + dt * (2 * pv + dt * (vv + self.q_pos)), pv + dt * vv, vv + self.q_vel * dt
        if z is None:
            return [*place, *speed], [pp, pv, vv], "predict_only"
        e = [a - b for a, b in zip(z, place, strict=True)]
        nis = sum(a * a for a in e) / (pp + noise)
        if nis > HARD:
            return [*place, *speed], [pp, pv, vv], "predict_only_outlier"
        r = noise * INFLATE if nis > SOFT else noise
        g, h = pp / (pp + r), pv / (pp + r)
        p = [(1 - g) * (1 - g) * pp + g * g * r, (1 - g) * (pv - h * pp) + g * h * r, vv - 2 * h * pv + h * h * (pp + r)]
        return [a + g * b for a, b in zip(place, e, strict=True)] + [a + h * b for a, b in zip(speed, e, strict=True)], p, "variance_inflated" if nis > SOFT else "updated"


def filter_series(z: np.ndarray, dt: np.ndarray, noise: np.ndarray, model: Filter = Filter()) -> tuple[np.ndarray, list[str]]:
    """Constant-velocity filter over one point's measurements z (n, d): estimates and statuses."""
    d = z.shape[1]
    x, p = model.begin(z[:1])
    out, status = [x[0, :d]], ["initialized"]
    for k in range(1, len(z)):
        x, p, named = model.step(x, p, z[k : k + 1], dt[k : k + 1], noise[k : k + 1])
        out.append(x[0, :d])
        status.append(named[0])
    return np.asarray(out), status


class _Bank:
    """The filters of all points of a task; rows come by place in the series, so that points step together."""

    def __init__(self, model: Filter, noise: float):
        self.model, self.noise = model, noise
        self.ids, self.alive = np.empty(0, np.int64), np.empty(0, bool)
        self.x, self.p = np.empty((0, 6)), np.empty((0, 6, 6))

    def take(self, ids: np.ndarray, first: bool, z: np.ndarray, dt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates and statuses of one row of each of some points, whose ids go up."""
        n = len(ids)
        if first:
            self.ids, self.alive = np.concatenate([self.ids, ids]), np.concatenate([self.alive, np.zeros(n, bool)])
            self.x, self.p = np.concatenate([self.x, np.full((n, 6), np.nan)]), np.concatenate([self.p, np.zeros((n, 6, 6))])
        slot = np.searchsorted(self.ids, ids)
        status = np.full(n, "not_initialized", object)
        old = self.alive[slot]
        new = ~old & np.isfinite(z).all(1)
        if old.any():
            at = slot[old]
            self.x[at], self.p[at], status[old] = self.model.step(self.x[at], self.p[at], z[old], dt[old], np.full((len(at), 3), self.noise))
        if new.any():
            at = slot[new]
            self.x[at], self.p[at] = self.model.begin(z[new])
            self.alive[at], status[new] = True, "initialized"
        return self.x[slot, 0], status


def kalman(df: DataFrame, noise: float = 1.0, model: Filter = Filter()) -> DataFrame:
    """Filter each point's (t, x, y, z); rows with equal times of a point follow in order of frame, a thousandth apart.

    A task holds the states of its points, not their rows: rows reach it by place in the
    series, in batches, and all points of a batch at one place step together. A row with a coordinate
    that isn't finite is only predicted (`not_initialized`, without an estimate, before the first
    whole one). Rows without a point or a time have no place and are left out.
    """
    schema = "point_id bigint, frame bigint, x double, est_x double, status string"
    w = Window.partitionBy("point_id").orderBy("t", "frame", "x", "y", "z")
    kept = df.filter("point_id is not null and t is not null").select(F.col("point_id").cast("bigint").alias("point_id"), F.col("frame").cast("bigint").alias("frame"), "t", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    placed = kept.withColumn("place", F.row_number().over(w)).withColumn("dt", F.greatest(F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(0.0)), F.lit(1e-3)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bank = _Bank(model, noise)
        for pdf in batches:
            ids, place, dt = (pdf[c].to_numpy() for c in ("point_id", "place", "dt"))
            z = pdf[["x", "y", "z"]].to_numpy(float)
            cuts = [0, *(np.flatnonzero(np.diff(place)) + 1), len(pdf)]
            found = [bank.take(ids[i:j], place[i] == 1, z[i:j], dt[i:j]) for i, j in zip(cuts, cuts[1:], strict=False) if j > i]
            if found:
                yield pdf[["point_id", "frame", "x"]].assign(est_x=np.concatenate([f[0] for f in found]), status=np.concatenate([f[1] for f in found]))

    # the window has brought a point's rows together; the order by place needs no further exchange
    out = placed.select("point_id", "frame", "x", "y", "z", "place", "dt").sortWithinPartitions("place", "point_id").mapInPandas(run, schema)
    return out.withColumn("est_x", F.nanvl("est_x", F.lit(None).cast("double")))


def lifecycle(df: DataFrame, max_failures: int = 3) -> DataFrame:
    """tracking, recovering or lost after each row of (point_id, frame, ok): lost for good once failures in a row reach the limit, until a success begins a new count."""
    w = Window.partitionBy("point_id").orderBy("frame")
    d = df.withColumn("__g", F.count_if("ok").over(w))
    fails = F.count_if(~F.col("ok")).over(Window.partitionBy("point_id", "__g").orderBy("frame"))
    state = F.when(fails == 0, "tracking").when(fails < max_failures, "recovering").otherwise("lost")
    return d.withColumn("failures", fails).withColumn("state", state).drop("__g")
