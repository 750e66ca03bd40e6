"""Tracked points as a stream: lifecycle, filter, confidence, stabilised values and prediction.

Each point's state lies in Spark's state store in four parts: counters, the two newest
accepted observations, the filter's state and the place in time. A point that is silent for
long is lost by a timer, and a stream may begin from a table of states.
"""

from __future__ import annotations

import contextlib
import math
from collections import namedtuple
from collections.abc import Iterator
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from metrilith.streaming.state import Filter


@dataclass(frozen=True)
class Rules:
    """Limits of a point's states.

    `lost_after` failures in a row lose a point; `low_after` scores in a row below `low` lose
    its confidence (below `medium` where `feedback` is set). A value below `far` within
    `smooth` of the newest accepted one moves by the share `alpha` only. `noise` is the
    variance of a measurement, `spread` what a prediction adds to the predictor's own.
    `silence` is in milliseconds of event time; None sets no timers.
    """

    lost_after: int = 3
    low: float = 0.2
    medium: float = 0.5
    high: float = 0.8
    low_after: int = 3
    feedback: bool = False
    alpha: float = 0.2
    smooth: float = 0.75
    far: float = 8.0
    noise: float = 1.0
    spread: float = 0.01
    silence: int | None = None


@dataclass
class Life:
    """Counters of a point: failures in a row, recoveries and the frames that they took, low scores in a row, predictions."""

    failures: int = 0
    recoveries: int = 0
    recovery_frames: int = 0
    started: int | None = None
    low_frames: int = 0
    predictions: int = 0
    silent: bool = False


LIFE = "failures int, recoveries int, recovery_frames bigint, started bigint, low_frames int, predictions int, silent boolean"
OUT = (
    "point_id bigint, frame bigint, state string, failures int, recoveries int, recovery_frames bigint, confidence string, low_frames int, "
    "stabilised double, predicted double, spread double, est_x double, status string"
)
_Out = Row(*(c.split()[0] for c in OUT.split(", ")))
#: What a row of observations holds, in this order; `at` only with timers.
_COLUMNS = ["point_id", "frame", "t", "x", "y", "z", "score", "ok"]
_Seen = namedtuple("_Seen", [*_COLUMNS, "at"], defaults=[None])


def live(s: Life, frame: int, ok: bool, rules: Rules) -> str:
    """tracking, recovering or lost after a row; a success after failures is a recovery, of at least one frame."""
    if not ok:
        s.failures += 1
        s.started = frame if s.started is None else s.started
        return "lost" if s.failures >= rules.lost_after else "recovering"
    if s.started is not None:
        s.recoveries += 1
        s.recovery_frames += max(1, frame - s.started)
    s.failures, s.started = 0, None
    return "tracking"


def grade(s: Life, score: float | None, rules: Rules) -> str:
    """HIGH, MEDIUM, LOW or LOST; a score that is missing is below all limits."""
    score = -math.inf if score is None or math.isnan(score) else score
    if score >= rules.medium or (score >= rules.low and not rules.feedback):
        s.low_frames = 0
        return "HIGH" if score >= rules.high else "MEDIUM" if score >= rules.medium else "LOW"
    s.low_frames += 1
    return "LOST" if s.low_frames >= rules.low_after else "LOW"


def stabilised(accepted: list, value: float, ok: bool, rules: Rules) -> float | None:
    """The value, or the newest accepted one moved towards it where both are small and near; none for a failure."""
    if not ok:
        return None
    if accepted and value < rules.far and abs(value - accepted[-1][1]) <= rules.smooth:
        return accepted[-1][1] + rules.alpha * (value - accepted[-1][1])
    return value


def predicted(accepted: list, t: float) -> float | None:
    """Where two accepted observations lead at constant velocity; the newest alone if it is the only one or both are of one time."""
    if not accepted:
        return None
    t1, x1 = accepted[-1]
    t0, x0 = accepted[0]
    return x1 if t1 == t0 else x1 + (x1 - x0) / (t1 - t0) * (t - t1)


@dataclass
class Point:
    """All that is known of a point between two rows."""

    life: Life
    accepted: list  # (t, x) of the two newest successes
    x: list | None = None  # places, then speeds
    p: list | None = None  # variance of a place, its covariance with the speed, variance of a speed
    newest: tuple[float, int] | None = None
    heard: int | None = None  # event time in milliseconds

    def silent(self, point_id: int, rules: Rules) -> tuple:
        """Loses the point; the row of `OUT` that says so has no frame."""
        c = self.life
        c.failures, c.silent = max(c.failures, rules.lost_after), True
        if c.started is None and self.newest is not None:
            c.started = self.newest[1]
        return point_id, None, "lost", c.failures, c.recoveries, c.recovery_frames, "LOST", c.low_frames, None, None, None, None, "silent"

    def row(self, point_id: int, r, rules: Rules, model: Filter) -> tuple:
        """Takes a row (frame, t, x, y, z, score, ok) and returns one of `OUT`."""
        s = self.life
        z = (r.x, r.y, r.z)
        ok = bool(r.ok) and all(map(math.isfinite, z))
        guess, steady = predicted(self.accepted, r.t), stabilised(self.accepted, r.x, ok, rules)
        s.predictions += bool(self.accepted)
        if self.x is None:
            status = "initialized" if ok else "not_initialized"
            if ok:
                self.x, self.p = model.begin_one(z)
        else:
            self.x, self.p, status = model.step_one(self.x, self.p, z if ok else None, max(r.t - self.newest[0], 1e-3), rules.noise)
        s.silent = False
        state, confidence = live(s, r.frame, ok, rules), grade(s, r.score, rules)
        if ok:
            self.accepted = [*self.accepted, (r.t, r.x)][-2:]
        self.newest = (r.t, r.frame)
        est = None if self.x is None else self.x[0]
        return point_id, r.frame, state, s.failures, s.recoveries, s.recovery_frames, confidence, s.low_frames, steady, guess, 1.0 + rules.spread * s.predictions, est, status


def _seen(r: Row) -> _Seen:
    """A row whose missing numbers are NaN."""
    point_id, frame, *numbers, ok = r[:8]
    return _Seen(point_id, frame, *(math.nan if v is None else v for v in numbers), ok, *r[8:])


class Tracker(StatefulProcessor):
    """Points of (point_id, frame, t, x, y, z, score, ok).

    A batch's rows of a point are taken in order of (t, frame); rows that aren't behind what the
    point has seen are late and skipped. With `silence`, rows also hold `at`, the event
    time, and a point without rows for that long is lost, once: one row without a frame, given when
    the watermark has passed, or before the point's next row if that comes first.
    """

    def __init__(self, rules: Rules = Rules(), model: Filter = Filter()):
        self.rules, self.model = rules, model

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", LIFE)
        self.accepted = handle.getListState("accepted", "t double, x double")
        self.filter = handle.getValueState("filter", "x array<double>, p array<double>")
        self.newest = handle.getValueState("newest", "t double, frame bigint, heard bigint")

    def _load(self) -> Point:
        # each call asks the JVM, so that nothing is asked for twice
        life, newest = self.life.get(), self.newest.get()
        s = Point(Life(*life) if life else Life(), [])
        if newest:  # without a row before there are no observations, nor a filter
            t, frame, s.heard = newest
            s.newest = (t, frame)
            s.accepted = [tuple(o) for o in self.accepted.get()]
            if held := self.filter.get():
                x, p = map(list, held)
                # checkpoints of older versions hold the whole matrix of three coordinates
                s.x, s.p = x, p if len(p) == 3 else [p[0], p[3], p[21]]
        return s

    def _keep(self, s: Point, accepted: list) -> None:
        self.life.update(astuple(s.life))
        if s.accepted != accepted:
            self.accepted.put(s.accepted)
        if s.x is not None:
            self.filter.update((s.x, s.p))
        if s.newest is not None:
            self.newest.update((*s.newest, s.heard))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """Counters as a table of (point_id, failures, recoveries, recovery_frames, started, low_frames) has them."""
        r = initialState
        self.life.update(astuple(Life(r.failures, r.recoveries, r.recovery_frames, r.started, r.low_frames)))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        s, silence = self._load(), self.rules.silence
        accepted, heard = s.accepted, False
        for r in sorted((_seen(r) for r in rows), key=lambda r: (math.isnan(r.t), r.t, r.frame)):
            if s.newest is not None and (r.t, r.frame) <= s.newest:
                continue
            if silence is not None:
                at = int(r.at.timestamp() * 1000)
                if s.heard is not None and at > s.heard + silence and not s.life.silent:
                    yield _Out(*s.silent(key[0], self.rules))
                s.heard, heard = at if s.heard is None else max(at, s.heard), True
            yield _Out(*s.row(key[0], r, self.rules, self.model))
        self._keep(s, accepted)
        if heard:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(s.heard + silence)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s = self._load()
        if not s.life.silent:
            yield _Out(*s.silent(key[0], self.rules))
        self.life.update(astuple(s.life))

    def close(self) -> None:
        pass


def track(df: DataFrame, rules: Rules = Rules(), model: Filter = Filter(), initial: DataFrame | None = None) -> DataFrame:
    """`OUT` of a stream of observations; see `Tracker`.

    `initial` is a table of counters to begin with, one row a point. With `rules.silence`
    the stream needs a watermark on `at`. What a point gets in one batch is held at once;
    the source's trigger limits it.
    """
    mode, columns = ("none", _COLUMNS) if rules.silence is None else ("eventTime", [*_COLUMNS, "at"])
    begin = None if initial is None else initial.groupBy("point_id")
    # most points have few rows in a batch, for which a table of their own would cost more than the rows
    return df.select(*columns).groupBy("point_id").transformWithState(Tracker(rules, model), OUT, "append", mode, begin)


#: Several state variables need this store; it uploads what changed in a batch, and a partition's local files go with its commit.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """Settings of the state store, for streams that start inside."""
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what a stream gives now to the table at `path`; a later call goes on from the checkpoint."""
    with state_store(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    if query.exception():
        raise query.exception()
