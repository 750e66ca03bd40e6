"""Ordered-series operators: innovations, jumps, drift, jitter, first events."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from metrilith.functions.kernels import dominant


def series(by: Sequence[str], order: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def norm(parts: Sequence[Column]) -> Column:
    return F.sqrt(sum((p * p for p in parts), F.lit(0.0)))


def innovation(xyz: Sequence[str], w: WindowSpec, frame: str | None = None) -> Column:
    """Distance from the constant-velocity prediction of the two rows before.

    With `frame`, only where the three frames follow one another by one.
    """
    parts = [F.col(c) - (2 * F.lag(c, 1).over(w) - F.lag(c, 2).over(w)) for c in xyz]
    d = norm(parts)
    if frame is None:
        return d
    step = lambda k: F.lag(frame, k).over(w)
    return F.when((F.col(frame) - step(1) == 1) & (step(1) - step(2) == 1), d)


def jumps(df: DataFrame, by: Sequence[str], frame: str, xyz: Sequence[str], fraction: float, floor: float = 0.05) -> DataFrame:
    """checks and jumps of each key: an innovation over max(floor, fraction * |middle z|) is a jump."""
    w = series(by, frame)
    d = df.withColumn("__d", innovation(xyz, w, frame)).withColumn("__z", F.abs(F.lag(xyz[-1], 1).over(w)))
    limit = F.greatest(F.lit(floor), fraction * F.col("__z"))
    return d.groupBy(*by).agg(F.count("__d").alias("checks"), F.count_if(F.col("__d") > limit).alias("jumps"))


def from_start(c: str, w: WindowSpec) -> Column:
    return F.col(c) - F.first(c).over(w)


def mean_step(df: DataFrame, by: Sequence[str], order: str, c: str) -> DataFrame:
    """Mean absolute change from row to row; zero for a single row."""
    step = F.abs(F.col(c) - F.lag(c).over(series(by, order)))
    return df.withColumn("__s", step).groupBy(*by).agg(F.coalesce(F.avg("__s"), F.lit(0.0)).alias("jitter"))


def first_after_last(df: DataFrame, by: Sequence[str], frame: str, event: Column, clear: Column) -> DataFrame:
    """The first frame at which `clear` holds after the last one at which `event` does."""
    w = Window.partitionBy(*by)
    d = df.withColumn("__last", F.max(F.when(event, F.col(frame))).over(w))
    return d.groupBy(*by).agg(F.max("__last").alias("last_event"), F.min(F.when(clear & (F.col(frame) > F.col("__last")), F.col(frame))).alias("recovered_at"))


def held_counter(df: DataFrame, by: Sequence[str], order: str, score: str, low: float, medium: float, lost_after: int) -> DataFrame:
    """Confidence states with a counter of very low scores, without a loop.

    A score of at least `low` sets the counter to zero, one below it adds one; the counter
    is the number of very low scores since the last other one.
    """
    w = series(by, order)
    d = df.withColumn("__island", F.count_if(F.col(score) >= low).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.count_if(F.col(score) < low).over(Window.partitionBy(*by, "__island").orderBy(order))
    state = F.when(F.col(score) >= medium, "ACCEPTED").when(F.col(score) >= low, "LOW").when(run >= lost_after, "LOST").otherwise("LOW")
    return d.withColumn("very_low_frames", run).withColumn("state", state).drop("__island")


def gap_prediction(c: str, t: str, w: WindowSpec, longest: float) -> Column:
    """Constant-velocity prediction over uneven times; the row before alone where a gap is too long or there is no second row."""
    x1, x2, t1, t2 = F.lag(c, 1).over(w), F.lag(c, 2).over(w), F.lag(t, 1).over(w), F.lag(t, 2).over(w)
    fine = (F.col(t) - t1 <= longest) & (t1 - t2 <= longest) & (t1 > t2)
    return F.when(fine, x1 + F.try_divide((x1 - x2) * (F.col(t) - t1), t1 - t2)).otherwise(x1)


def evenly(i: Column, n: Column, count: int) -> Column:
    """Whether place i of n (from 0) is one of `count` places at equal distances, cut to whole numbers; all are if n <= count."""
    k = F.ceil(i * (count - 1) / (n - 1))
    hit = F.when(n > count, F.floor(k * (n - 1) / (count - 1)) == i)
    return F.coalesce(hit, n <= count)


def spectral(df: DataFrame, by: Sequence[str], order: str, c: str, fs: float, most: int = 64, least: int = 16) -> DataFrame:
    """Dominant frequency, its amplitude and band energy over the last `most` rows, where there are `least`."""
    @F.pandas_udf("frequency double, amplitude double, energy double")
    def found(series: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dominant(v, fs) for v in series], columns=["frequency", "amplitude", "energy"])

    last = F.collect_list(F.col(c).cast("double")).over(Window.partitionBy(*by).orderBy(order).rowsBetween(1 - most, 0))
    rows = df.select(*by, order, last.alias("__w")).filter(F.size("__w") >= least)
    return rows.withColumn("__s", found("__w")).select(*by, order, "__s.*")
