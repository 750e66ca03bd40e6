"""The shapes in which queries see the tables: measurements with truth, and trajectories.

`MEASURES` and `TRACKS` are the same shapes in SQL, to begin a WITH clause.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MEASURES = """m AS (SELECT l_returnflag AS method, l_linestatus AS status, l_orderkey AS frame, l_linenumber AS point_id, l_partkey AS part,
 l_suppkey AS source, l_extendedprice AS pred, l_quantity * p_retailprice AS truth, l_extendedprice - l_quantity * p_retailprice AS err,
 100 * abs(l_extendedprice - l_quantity * p_retailprice) / (l_quantity * p_retailprice) AS rel, l_discount * 10 AS confidence, l_tax AS margin, l_quantity AS qty
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""

TRACKS = """t AS (SELECT user_id AS point_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
 epoch(ts) AS t, value AS x, value * 0.5 + event_id % 7 AS y, 100 + value * 0.1 AS z, event_type FROM events),
 g AS (SELECT * FROM t WHERE event_type <> 'error')"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column | str, places: int) -> Column:
    """A double rounded as the SQL does it: half away from zero after it is multiplied by the power of ten.

    Spark's own rounding goes by the decimal digits of the number itself: 1.005 (which times 100
    is less than 100.5) becomes 1.01 there. What the power takes out of range stays as it is.
    """
    c = F.col(c) if isinstance(c, str) else c
    scaled = c * 10.0**places
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / 10.0**places).otherwise(c)


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted against true price of each order line."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    line = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    truth = F.col("l_quantity") * F.col("p_retailprice")
    return line.select(
        F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("status"), F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("point_id"), F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("source"), F.col("l_extendedprice").alias("pred"), truth.alias("truth"), (F.col("l_extendedprice") - truth).alias("err"),
        F.try_divide(100 * F.abs(F.col("l_extendedprice") - truth), truth).alias("rel"), (F.col("l_discount") * 10).alias("confidence"), F.col("l_tax").alias("margin"), F.col("l_quantity").alias("qty"),
    )


def tracks(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """Each user's events as a trajectory; with gaps, error events are missing frames."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    out = e.select(
        F.col("user_id").alias("point_id"), "event_id", (F.row_number().over(w) - 1).alias("frame"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
        F.col("value").alias("x"), (F.col("value") * 0.5 + F.col("event_id") % 7).alias("y"), (100 + F.col("value") * 0.1).alias("z"), "event_type",
    )
    return out.filter(F.col("event_type") != "error") if gaps else out
