"""Trajectories, scenarios and faults as expressions over ranges: any length, no data on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrilith.functions.rules import first_rule

#: Kinds of injected faults, and how much stronger each severity is.
FAULT_KINDS = ["occlusion", "tracking_loss", "blur", "camera_motion", "extrinsic_drift", "stereo_mismatch", "flow_drift"]
SEVERITIES = {"low": 1.0, "medium": 2.0, "high": 4.0}
SCENARIOS = ["clean", "single_jump", "drift", "missing", "synchronous"]


def frames(spark: SparkSession, n: int, rate: float) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("frame"), (F.col("id") / rate).alias("t"))


def sines(parts: Sequence[tuple[float, float]], t: str = "t") -> Column:
    """Sum of amplitude * sin(2 pi frequency t)."""
    return sum((a * F.sin(2 * F.pi() * f * F.col(t)) for a, f in parts), F.lit(0.0))


def impact(amplitude: float, frequency: float, decay: float, at: float, t: str = "t") -> Column:
    """Zero before `at`, a decaying oscillation from there on."""
    s = F.col(t) - at
    return F.when(s >= 0, amplitude * F.exp(-decay * s) * F.sin(2 * F.pi() * frequency * s)).otherwise(0.0)


def scenarios(spark: SparkSession, n: int, points: int, jump: float = 80.0) -> DataFrame:
    """One sinusoid for each point in each scenario; faults are in the second point, unless all move together."""
    names = spark.createDataFrame([(s,) for s in SCENARIOS], "scenario string")
    rows = frames(spark, n, 30.0).crossJoin(F.broadcast(spark.range(points).withColumnRenamed("id", "point_id"))).crossJoin(F.broadcast(names))
    s, p, f = F.col("scenario"), F.col("point_id") == 1, F.col("frame")
    mid = n // 2
    off = F.when((s == "single_jump") & p & (f == mid), jump).when((s == "drift") & p & (f >= mid - 8), 0.5 * (f - (mid - 8))).when((s == "synchronous") & (f >= mid), 15.0).otherwise(0.0)
    gone = (s == "missing") & p & f.between(mid - 8, mid - 4)
    return rows.withColumn("y", F.when(~gone, sines([(5, 2)]) + off))


def observations(spark: SparkSession, n: int = 12) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(i.alias("frame"), (100.0 + i).alias("x_left"), (80.0 + i).alias("x_right"), F.lit(50.0).alias("y_left"), F.lit(50.0).alias("y_right"))


def faults(rows: DataFrame, first: int = 4, last: int = 8) -> DataFrame:
    """Every fault of every severity put into frames first to last of the rows."""
    kinds = rows.sparkSession.createDataFrame([(k, s, m) for k in FAULT_KINDS for s, m in SEVERITIES.items()], "fault string, severity string, m double")
    hit, m = F.col("frame").between(first, last), F.col("m")
    at = lambda *k: hit & F.col("fault").isin(*k)

    def shift(c: str, *rules: tuple[Column, Column]) -> Column:
        off = F.lit(0.0)
        for cond, by in reversed(rules):
            off = F.when(cond, by).otherwise(off)
        return F.col(c) + off

    move = (at("camera_motion"), 2 * m)
    return rows.crossJoin(F.broadcast(kinds)).select(
        "fault", "severity", "frame",
        F.when(~at("tracking_loss"), shift("x_left", move, (at("flow_drift"), 0.5 * m * (F.col("frame") - first + 1)))).alias("x_left"),
        shift("x_right", move, (at("stereo_mismatch"), 3 * m)).alias("x_right"),
        shift("y_left", move).alias("y_left"),
        shift("y_right", move, (at("extrinsic_drift"), 1.5 * m)).alias("y_right"),
        (~at("occlusion", "tracking_loss")).alias("observed"),
        F.when(at("blur"), 0.8 / m).otherwise(1.0).alias("blur"),
    )


def case_windows(spark: SparkSession, cases: int = 32, first: int = 20, step: int = 14, length: int = 10) -> DataFrame:
    """Frames of cases that start at equal distances, each frame with its phase."""
    c = spark.range(cases).select(F.concat(F.lit("P45-"), F.lpad((F.col("id") + 1).cast("string"), 2, "0")).alias("case_id"), (first + step * F.col("id")).alias("start"))
    o = F.col("o")
    rows = c.select("case_id", "start", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("o"))
    return rows.select("case_id", (F.col("start") + o).alias("frame"), first_rule([(o < 3, "warmup"), (o < 5, "exposure"), (o < 8, "recovery")], "stability").alias("phase"))


def grid(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "gx").crossJoin(spark.range(n).withColumnRenamed("id", "gy"))
