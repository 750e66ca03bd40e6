"""Generated trajectories and faults, built from ranges and expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from metrilith.operators import generators as gen
from metrilith.plans.registry import register
from metrilith.plans.views import rounded


def r(c, name, n=6):
    return rounded(c, n).alias(name)


@register("g1_trajectories", "WITH f AS (SELECT i AS frame, i/30.0 AS t FROM range(90) r(i)) SELECT frame, round(5*sin(2*pi()*2*t),6) AS sine, round(5*sin(2*pi()*2*t)+2*sin(2*pi()*5*t),6) AS multi, round(CASE WHEN t>=1 THEN 20*exp(-3*(t-1))*sin(2*pi()*8*(t-1)) ELSE 0 END,6) AS impact FROM f")
def g1(spark, d):
    f = gen.frames(spark, 90, 30.0)
    return f.select("frame", r(gen.sines([(5, 2)]), "sine"), r(gen.sines([(5, 2), (2, 5)]), "multi"), r(gen.impact(20, 8, 3, 1), "impact"))


@register("g3_g7_temporal_scenarios", "WITH f AS (SELECT i AS frame, i/30.0 AS t, p AS point_id FROM range(96) r(i), range(3) q(p)), s AS (SELECT v.s AS scenario FROM (VALUES ('clean'),('single_jump'),('drift'),('missing'),('synchronous')) v(s)) SELECT scenario, point_id, frame, CASE WHEN scenario='missing' AND point_id=1 AND frame BETWEEN 40 AND 44 THEN NULL ELSE round(5*sin(2*pi()*2*t)+CASE WHEN scenario='single_jump' AND point_id=1 AND frame=48 THEN 80 WHEN scenario='drift' AND point_id=1 AND frame>=40 THEN 0.5*(frame-40) WHEN scenario='synchronous' AND frame>=48 THEN 15 ELSE 0 END,6) END AS y FROM f, s")
def g3(spark, d):
    return gen.scenarios(spark, 96, 3).select("scenario", "point_id", "frame", r(F.col("y"), "y"))


@register("g4_g8_tabular_faults", "WITH b AS (SELECT i AS frame, 100.0+i AS x_left, 80.0+i AS x_right, 50.0 AS y_left, 50.0 AS y_right FROM range(12) r(i)), k AS (SELECT f.f AS fault, s.s AS severity, CASE s.s WHEN 'low' THEN 1.0 WHEN 'medium' THEN 2.0 ELSE 4.0 END AS m FROM (VALUES ('occlusion'),('tracking_loss'),('blur'),('camera_motion'),('extrinsic_drift'),('stereo_mismatch'),('flow_drift')) f(f), (VALUES ('low'),('medium'),('high')) s(s)) SELECT fault, severity, frame, CASE WHEN frame<4 OR frame>8 THEN x_left WHEN fault='tracking_loss' THEN NULL WHEN fault='camera_motion' THEN x_left+2*m WHEN fault='flow_drift' THEN x_left+0.5*m*(frame-3) ELSE x_left END::DOUBLE AS x_left, CASE WHEN frame BETWEEN 4 AND 8 AND fault='stereo_mismatch' THEN x_right+3*m WHEN frame BETWEEN 4 AND 8 AND fault='camera_motion' THEN x_right+2*m ELSE x_right END::DOUBLE AS x_right, CASE WHEN frame BETWEEN 4 AND 8 AND fault='camera_motion' THEN y_left+2*m ELSE y_left END::DOUBLE AS y_left, CASE WHEN frame BETWEEN 4 AND 8 AND fault='camera_motion' THEN y_right+2*m WHEN frame BETWEEN 4 AND 8 AND fault='extrinsic_drift' THEN y_right+1.5*m ELSE y_right END::DOUBLE AS y_right, NOT (frame BETWEEN 4 AND 8 AND fault IN ('occlusion','tracking_loss')) AS observed, CASE WHEN frame BETWEEN 4 AND 8 AND fault='blur' THEN round(0.8/m,6) ELSE 1.0 END::DOUBLE AS blur FROM b, k")
def g4(spark, d):
    return gen.faults(gen.observations(spark)).withColumn("blur", rounded("blur", 6))


@register("g9_g10_case_windows", "WITH c AS (SELECT i AS k, 'P45-'||lpad((i+1)::VARCHAR,2,'0') AS case_id, 20+14*i AS start FROM range(32) r(i)) SELECT case_id, start+o AS frame, CASE WHEN o<3 THEN 'warmup' WHEN o<5 THEN 'exposure' WHEN o<8 THEN 'recovery' ELSE 'stability' END AS phase, gx, gy FROM c, range(10) r(o), range(3) a(gx), range(3) b(gy) WHERE gx=gy")
def g9(spark, d):
    return gen.case_windows(spark).crossJoin(F.broadcast(gen.grid(spark, 3))).filter("gx = gy").select("case_id", "frame", "phase", "gx", "gy")  # nine cells
