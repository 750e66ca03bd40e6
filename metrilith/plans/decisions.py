"""Decisions over single measurements: stages, gates, evidence, arbitration, search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from metrilith.functions import decisions as ds
from metrilith.functions import rules
from metrilith.plans.registry import register
from metrilith.plans.views import TRACKS, rounded, table, tracks

EV = "e AS (SELECT event_id AS id, value AS v, (event_id%7)::INTEGER AS k, event_type AS kind, user_id FROM events)"


def r(c, name, n=6):
    return rounded(c, n).alias(name)


def events(spark, d):
    """Event rows under short names; k is the id's remainder by seven."""
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("v"), (F.col("event_id") % 7).cast("int").alias("k"), F.col("event_type").alias("kind"), "user_id")


def v():
    return F.col("v")


def k():
    return F.col("k")


@register("p1_p3_sample_filter", "WITH f AS (SELECT event_id AS id, CASE WHEN event_id%3=0 THEN 'f'||user_id ELSE user_id::VARCHAR END AS frame FROM events WHERE event_type='view') SELECT id, frame FROM f WHERE TRY_CAST(frame AS BIGINT) IS NULL OR TRY_CAST(frame AS BIGINT) BETWEEN 5 AND 60")
def p3(spark, d):
    """Views in a range of frames; frames that are no numbers pass."""
    frame = F.when(F.col("id") % 3 == 0, F.concat(F.lit("f"), F.col("user_id").cast("string"))).otherwise(F.col("user_id").cast("string"))
    n = F.col("frame").try_cast("bigint")
    return events(spark, d).filter("kind = 'view'").select("id", frame.alias("frame")).filter(n.isNull() | n.between(5, 60))


@register("p4_p6_p7_stage_fallback", f"WITH {EV} SELECT id, CASE WHEN k=0 THEN v+2 WHEN k IN (2,4) THEN v+1 WHEN k<>1 THEN v END AS x, CASE WHEN k=0 THEN 'compensated' WHEN k IN (2,4) THEN 'estimated' WHEN k<>1 THEN 'measured' ELSE 'UNAVAILABLE' END AS source FROM e")
def p4(spark, d):
    comp = [F.when(k() == 0, v() + 2)] * 3
    est = [v() + 1, F.when(k().isin(0, 2, 4), v()), v()]
    meas = [v(), F.when(k() != 1, v()), v()]
    xyz, source = ds.first_stage({"compensated": comp, "estimated": est, "measured": meas})
    return events(spark, d).select("id", xyz["x"].alias("x"), source.alias("source"))


@register("p5_stage_selection", "SELECT event_id AS id, value+1 AS x, value*2 AS y, value AS z FROM events")
def p5(spark, d):
    e = events(spark, d).select("id", *(c.alias(f"{s}_{n}") for s, o in (("measured", 0), ("final", 1)) for n, c in (("x", v() + o), ("y", v() * (1 + o)), ("z", v()))))
    return ds.stage(e, "final")


@register("p8_p10_pixel_error_and_disparity", f"WITH {EV} SELECT id, round(sqrt((v-50)**2+(k-3)**2),6) AS pixel_error, round(CASE WHEN k%2=0 THEN v ELSE 100-v*0.5 END,6) AS disparity FROM e")
def p8(spark, d):
    return events(spark, d).select("id", r(F.hypot(v() - 50, k() - 3), "pixel_error"), r(F.coalesce(F.when(k() % 2 == 0, v()), 100 - v() * 0.5), "disparity"))


@register("p12_k16_projected_flow", f"WITH {EV}, p AS (SELECT id, k, CASE WHEN v>20 THEN 700*k/(v-20)+320 END AS u0, CASE WHEN v>20 THEN 700*2.0/(v-20)+240 END AS v0, CASE WHEN v>19 THEN 700*(k+1)/(v-19)+320 END AS u1, CASE WHEN v>19 THEN 700*2.0/(v-19)+240 END AS v1 FROM e) SELECT id, round(u0,5) AS u, round(v0,5) AS v, round(sqrt((u1-u0-k)**2+(v1-v0)**2),4) AS flow_residual FROM p")
def p12(spark, d):
    """Image points of a moving point, and how far its projected motion is from a measured one."""
    p = [[700, 0, 320, 0], [0, 700, 240, 0], [0, 0, 1, 0]]
    e = events(spark, d).select("id", "k", *(c.alias(n) for n, c in zip(("u0", "v0", "u1", "v1"), [*ds.projected(p, k(), F.lit(2.0), v() - 20), *ds.projected(p, k() + 1, F.lit(2.0), v() - 19)], strict=True)))
    return e.select("id", r(F.col("u0"), "u", 5), r(F.col("v0"), "v", 5), r(F.hypot(F.col("u1") - F.col("u0") - k(), F.col("v1") - F.col("v0")), "flow_residual", 4))


@register("p14_euler_angles", f"WITH {EV}, a AS (SELECT id, 0.2+least(v,250)/100 AS a, k/10.0 AS b FROM e) SELECT id, round(degrees(b),4) AS about_y, round(degrees(a),4) AS about_z, round(degrees(acos(greatest(-1,least(1,(cos(a)*cos(b)+cos(a)+cos(b)-1)/2)))),4) AS turn FROM a")
def p14(spark, d):
    a, b, o = 0.2 + F.least(v(), F.lit(250.0)) / 100, k() / 10, F.lit(0.0)
    m = [[F.cos(a) * F.cos(b), -F.sin(a), F.cos(a) * F.sin(b)], [F.sin(a) * F.cos(b), F.cos(a), F.sin(a) * F.sin(b)], [-F.sin(b), o, F.cos(b)]]
    _, y, z = ds.euler_degrees(m)
    return events(spark, d).select("id", r(y, "about_y", 4), r(z, "about_z", 4), r(ds.turn_degrees(m), "turn", 4))


@register("p15_rigid_transform", "SELECT c_custkey, round(cos(n_nationkey*0.1)*c_acctbal - sin(n_nationkey*0.1)*10 + n_regionkey,4) AS x, round(sin(n_nationkey*0.1)*c_acctbal + cos(n_nationkey*0.1)*10 - n_regionkey,4) AS y FROM customer JOIN nation ON c_nationkey=n_nationkey")
def p15(spark, d):
    """Each nation is a frame with its own rotation and shift."""
    a, o, one = F.col("n_nationkey") * 0.1, F.lit(0.0), F.lit(1.0)
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    x, y, _ = ds.moved([[F.cos(a), -F.sin(a), o], [F.sin(a), F.cos(a), o], [o, o, one]], [F.col("n_regionkey"), -F.col("n_regionkey"), o], [F.col("c_acctbal"), F.lit(10.0), o])
    return c.select("c_custkey", r(x, "x", 4), r(y, "y", 4))


@register("p21_confidence_modes", f"WITH {EV} SELECT id, CASE WHEN id%5=0 THEN 'HIGH' WHEN id%5 IN (1,2) THEN CASE WHEN k*0.03>=0.1 THEN 'HIGH' ELSE 'LOW' END WHEN v>=75 THEN 'HIGH' WHEN v>=50 THEN 'MEDIUM' WHEN v>=25 THEN 'LOW' WHEN k%4+1>=3 THEN 'LOST' ELSE 'LOW' END AS state FROM e")
def p21(spark, d):
    i = F.col("id") % 5
    mode = F.when(i == 0, "none").when(i == 1, "lr_only").when(i == 2, "single_margin").when(i == 3, "score_only").otherwise("closed_loop")
    return events(spark, d).select("id", ds.confidence_state(mode, v(), k() * 0.03, k() % 4, 75, 50, 25, 3).alias("state"))


@register("p22_match_uncertainty", f"WITH {EV}, c AS (SELECT id, least(3, 8/greatest(v,1e-9)) AS a, CASE WHEN k%2=0 THEN least(3, v/50) END AS b, CASE WHEN k>2 THEN least(3, 0.1/greatest(k*0.05,1e-9)) END AS c FROM e), w AS (SELECT id, (a*0.3+coalesce(b*0.2,0)+coalesce(c*0.1,0))/(0.3+CASE WHEN b IS NULL THEN 0 ELSE 0.2 END+CASE WHEN c IS NULL THEN 0 ELSE 0.1 END) AS risk FROM c) SELECT id, round(greatest(0.3,least(1.5,0.25*(1+risk))),6) AS variance, round(1/(1+risk),6) AS quality FROM w")
def p22(spark, d):
    risks = [(ds.inverse_risk(v(), 8), 0.3), (ds.ratio_risk(F.when(k() % 2 == 0, v()), 50), 0.2), (ds.inverse_risk(F.when(k() > 2, k() * 0.05), 0.1), 0.1)]
    variance, quality = ds.match_uncertainty(risks, 0.25, 0.3, 1.5)
    return events(spark, d).select("id", r(variance, "variance"), r(quality, "quality"))


@register("p25_transient_gate", f"WITH {EV}, c AS (SELECT id, CASE WHEN k<6 THEN v END AS t, CASE WHEN k%2=0 THEN v/100 END AS f, v/80 AS s, CASE WHEN k<>4 THEN k/6.0 END AS y FROM e), g AS (SELECT *, coalesce(f, 0.7) AS u FROM c) SELECT id, CASE WHEN t IS NULL THEN 'temporal_residual_unavailable' WHEN t<10 THEN 'not_a_fast_transient' WHEN u>=0.6 AND s>=0.6 AND y>=0.6 THEN 'supported_synchronous_motion' WHEN u<=0.35 AND s<=0.35 AND y<0.6 THEN 'isolated_multisource_measurement_error' ELSE 'insufficient_evidence_for_safe_correction' END AS reason FROM g")
def p25(spark, d):
    return events(spark, d).select("id", ds.transient(F.when(k() < 6, v()), F.when(k() % 2 == 0, v() / 100), F.lit(0.7), v() / 80, F.when(k() != 4, k() / 6)).alias("reason"))


@register("p29_st11_recovery_verified", "WITH o AS (SELECT l_orderkey, max(l_discount) FILTER (l_linenumber=1) AS c0, max(l_discount) FILTER (l_linenumber=2) AS c1, max(l_tax) FILTER (l_linenumber=1) AS r0, max(l_tax) FILTER (l_linenumber=2) AS r1 FROM lineitem GROUP BY 1) SELECT l_orderkey, round(c1-c0,6) AS gain, round(r0-r1,6) AS drop, c1-c0>0 AND r0-r1>0 AS success FROM o WHERE c0 IS NOT NULL AND c1 IS NOT NULL")
def p29(spark, d):
    """Remeasured (second line) against measured (first line): confidence up and residual down."""
    at = lambda c, n: F.max(F.when(F.col("l_linenumber") == n, F.col(c)))
    o = table(spark, d, "lineitem").filter("l_linenumber <= 2").groupBy("l_orderkey").agg(at("l_discount", 1).alias("c0"), at("l_discount", 2).alias("c1"), at("l_tax", 1).alias("r0"), at("l_tax", 2).alias("r1")).filter("c0 is not null and c1 is not null")
    c, e = F.col("c1") - F.col("c0"), F.col("r0") - F.col("r1")
    return o.select("l_orderkey", r(c, "gain"), r(e, "drop"), ((c > 0) & (e > 0)).alias("success"))


FAULT = "CASE k WHEN 0 THEN '' WHEN 1 THEN ' normal' WHEN 2 THEN 'stereo_mismatch' ELSE 'OCCLUSION' END"
RISK = "CASE WHEN v>95 THEN 'BLOCKING' WHEN k<2 THEN 'NORMAL' WHEN v/100>=0.8 THEN 'BLOCKING' ELSE 'WARNING' END"
ACTION = "CASE WHEN v>95 THEN 'BLOCK_FINAL' WHEN k<2 THEN 'NONE' WHEN v/100>=0.8 THEN 'BLOCK_FINAL' WHEN k=2 THEN 'ALLOW_CORRECTION' ELSE 'WARN' END"


def _diagnosis():
    fault = F.when(k() == 0, "").when(k() == 1, " normal").when(k() == 2, "stereo_mismatch").otherwise("OCCLUSION")
    return ds.recommendation(v() > 95, fault, v() / 100)


@register("p30_recommendation", f"WITH {EV} SELECT risk, action, count(*) AS n FROM (SELECT {RISK} AS risk, {ACTION} AS action FROM e) GROUP BY ALL")
def p30(spark, d):
    risk, action = _diagnosis()
    return events(spark, d).select(risk.alias("risk"), action.alias("action")).groupBy("risk", "action").agg(F.count("*").alias("n"))


@register(
    "p31_p32_final_arbitration",
    f"WITH {EV}, s AS (SELECT id, v, k, id%2=0 AS may_write, v>3 AS valid, {RISK} AS risk, {ACTION} AS action, concat_ws('+', CASE WHEN v>90 THEN 'candidate_not_finite' END, CASE WHEN NOT v>3 THEN 'geometry_invalid' END, CASE WHEN NOT v<60 THEN 'correction_unauthorized' END, CASE WHEN id%11=0 THEN 'evidence_insufficient' END, CASE WHEN id%13=0 THEN 'post_correction_unsafe' END, CASE WHEN kind NOT IN ('view','click') THEN 'i2_state_disallows_candidate' END) AS reasons FROM e), p AS (SELECT *, CASE WHEN NOT valid THEN 'REJECT' WHEN risk='BLOCKING' THEN 'REJECT' WHEN reasons='' AND action='ALLOW_CORRECTION' THEN 'USE_CORRECTED' WHEN risk='WARNING' THEN 'ACCEPT_WITH_WARNING' ELSE 'ACCEPT' END AS proposed FROM s) SELECT id, reasons, proposed, CASE WHEN may_write AND proposed IN ('USE_CORRECTED','REJECT') THEN proposed WHEN NOT valid THEN 'REJECT' WHEN proposed='ACCEPT' THEN proposed ELSE 'ACCEPT_WITH_WARNING' END AS committed FROM p",
)
def p31(spark, d):
    i = F.col("id")
    state = F.when(F.col("kind") == "view", "QUARANTINED").when(F.col("kind") == "click", "RECOVERY").otherwise("NORMAL")
    risk, action = _diagnosis()
    reasons = ds.safety_reasons(F.when(v() <= 90, v()), v() > 3, v() < 60, i % 11 != 0, i % 13 != 0, state)
    e = events(spark, d).select("id", (i % 2 == 0).alias("may_write"), (v() > 3).alias("valid"), risk.alias("risk"), action.alias("action"), reasons.alias("reasons"))
    e = e.withColumn("proposed", ds.proposed(F.col("valid"), F.col("risk"), F.col("reasons") == "", F.col("action")))
    return e.select("id", "reasons", "proposed", ds.committed(F.col("proposed"), F.col("valid"), F.col("may_write")).alias("committed"))


@register("p33_evidence", f"WITH {EV} SELECT id, coalesce(v<=95 AND kind='error' AND k<>5 AND v/100<0.55, false) AS confirmed_anomaly, kind='error' AS suspicious FROM e")
def p33(spark, d):
    fault = F.col("kind") == "error"
    c = F.when(k() != 5, v() / 100)
    return events(spark, d).select("id", F.coalesce(~(v() > 95) & fault & (c < 0.55), F.lit(False)).alias("confirmed_anomaly"), fault.alias("suspicious"))


@register("p39_adaptive_radius", f"WITH {EV}, c AS (SELECT id, 0.25*(1-least(1,v/100))+0.2*CASE WHEN k%2=0 THEN least(2,v/40)/2 ELSE 1 END+0.25*(least(2,k/2.0)/2)+0.2*(1-k/6.0)+0.1*(least(3,0.1/greatest(v/200,1e-6))/3) AS risk FROM e) SELECT id, round(risk,6) AS risk, round_even(4+risk*20,0)::INTEGER AS radius FROM c")
def p39(spark, d):
    risk, radius = ds.adaptive_radius(v() / 100, F.when(k() % 2 == 0, v() / 40), k() / 2, k() / 6, v() / 200, 4, 24)
    return events(spark, d).select("id", r(risk, "risk"), radius.alias("radius"))


@register("p40_search_radius", f"WITH {EV}, c AS (SELECT *, CASE WHEN k<>3 THEN v/10-5 END AS s, CASE WHEN k>1 THEN k/2.0 END AS q FROM e) SELECT id, CASE WHEN id%10=0 THEN 'fixed' WHEN kind='error' THEN 'base_recovery' WHEN (s IS NULL OR abs(s)<=1) AND (q IS NULL OR q<=1) THEN 'stable_prediction' WHEN abs(s)>1.5 THEN 'high_motion' WHEN q>1 THEN 'prediction_error' ELSE 'normal' END AS reason FROM c")
def p40(spark, d):
    return events(spark, d).select("id", ds.search_reason(F.col("id") % 10 != 0, F.col("kind") == "error", F.when(k() != 3, v() / 10 - 5), F.when(k() > 1, k() / 2), 3.0).alias("reason"))


@register("p41_frame_phase", f"WITH {TRACKS} SELECT event_id, CASE WHEN frame<3 THEN 'warmup' WHEN frame IN (3,4) THEN 'exposure' WHEN frame IN (5,6,7) THEN 'recovery' ELSE 'stability' END AS phase FROM t")
def p41(spark, d):
    """The frames of each phase are lists; the first list that holds a frame names its phase."""
    f = F.col("frame")
    inside = lambda *n: F.array_contains(F.array(*map(F.lit, n)), f.cast("int"))
    return tracks(spark, d).select("event_id", rules.first_rule([(inside(0, 1, 2), "warmup"), (inside(3, 4), "exposure"), (inside(5, 6, 7), "recovery")], "stability").alias("phase"))


@register("p44_constraint_cost", "SELECT l_orderkey, l_linenumber, round((0.6*l_discount+CASE WHEN l_linenumber%2=0 THEN 0.3*l_tax ELSE 0 END+0.2*l_quantity/50)/(0.8+CASE WHEN l_linenumber%2=0 THEN 0.3 ELSE 0 END),6) AS cost FROM lineitem")
def p44(spark, d):
    cost = ds.weighted_mean([(F.col("l_discount"), 0.6), (F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax")), 0.3), (F.col("l_quantity") / 50, 0.2)])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(cost, "cost"))


@register("p46_predicted_disparity", f"WITH {TRACKS}, l AS (SELECT event_id, x, lag(x) OVER (PARTITION BY point_id ORDER BY frame) AS p FROM t) SELECT event_id, round(x+CASE WHEN p IS NULL THEN 0 ELSE greatest(-3,least(3,x-p)) END,6) AS predicted FROM l")
def p46(spark, d):
    step = F.col("x") - F.lag("x").over(Window.partitionBy("point_id").orderBy("frame"))
    return tracks(spark, d).select("event_id", r(F.col("x") + F.coalesce(ds.clip(step, -3, 3), F.lit(0.0)), "predicted"))


@register("p49_truth_from_disparity", f"WITH {EV}, c AS (SELECT id, k, v, CASE WHEN v>10 THEN 700/(0.01*(v-10)) END AS z FROM e) SELECT id, round(z,4) AS z, round(z*sqrt((k*10-320)**2+(v-240)**2+700**2)/700,3) AS distance FROM c")
def p49(spark, d):
    q = [[1, 0, 0, -320], [0, 1, 0, -240], [0, 0, 0, 700], [0, 0, 0.01, 0]]
    x, y, z = rules.reprojected(q, k() * 10, v(), v() - 10)
    return events(spark, d).select("id", r(z, "z", 4), r(F.sqrt(x * x + y * y + z * z), "distance", 3))


@register("p50_p58_result_assembly", f"WITH {TRACKS}, s AS (SELECT event_id, frame, point_id, x AS m, 0.8*x+0.2*avg(x) OVER (PARTITION BY point_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS est FROM t) SELECT event_id, round(m,6) AS measured_x, round(est,6) AS final_x, round(est-first_value(est) OVER (PARTITION BY point_id ORDER BY frame),6) AS delta_x FROM s")
def p58(spark, d):
    """The published value is the filtered one, the raw match stays beside it; change counts from the first."""
    w = Window.partitionBy("point_id").orderBy("frame")
    s = tracks(spark, d).withColumn("est", 0.8 * F.col("x") + 0.2 * F.avg("x").over(w.rowsBetween(-2, 0)))
    return s.select("event_id", r(F.col("x"), "measured_x"), r(F.col("est"), "final_x"), r(F.col("est") - F.first("est").over(w), "delta_x"))


@register("p51_retry_acceptance", "WITH o AS (SELECT l_orderkey, max(l_discount) FILTER (l_linenumber=1) AS now, max(l_discount) FILTER (l_linenumber=2) AS candidate, max(l_tax) FILTER (l_linenumber=2) AS cycle FROM lineitem GROUP BY 1) SELECT l_orderkey, now>0.03 AS retried, coalesce(now>0.03 AND candidate<=now AND NOT cycle>0.06, false) AS accepted FROM o WHERE now IS NOT NULL")
def p51(spark, d):
    """A retry is tried where the precision asks for it, and taken if its noise isn't larger and its cycle holds."""
    at = lambda c, n: F.max(F.when(F.col("l_linenumber") == n, F.col(c)))
    o = table(spark, d, "lineitem").filter("l_linenumber <= 2").groupBy("l_orderkey").agg(at("l_discount", 1).alias("now"), at("l_discount", 2).alias("candidate"), at("l_tax", 2).alias("cycle")).filter("now is not null")
    retried = F.col("now") > 0.03
    better = F.col("now").isNull() | (F.col("candidate") <= F.col("now"))
    return o.select("l_orderkey", retried.alias("retried"), F.coalesce(retried & better & ~(F.col("cycle") > 0.06), F.lit(False)).alias("accepted"))


@register("p52_component_confidence", f"WITH {EV}, c AS (SELECT id, 0.3*least(1,v/100)+0.25*exp(-k/3.0)+0.15*CASE WHEN k%2=0 THEN exp(-v/50) ELSE 0 END+0.15*exp(-v/100)+0.1*exp(-k)+0.05*exp(-v/25) AS s FROM e) SELECT id, round(s,6) AS score, CASE WHEN s>=0.5 THEN 'HIGH' WHEN s>=0.35 THEN 'MEDIUM' ELSE 'LOW' END AS state FROM c")
def p52(spark, d):
    lr = F.coalesce(F.exp(-F.when(k() % 2 == 0, v() / 50)), F.lit(0.0))
    s = 0.3 * ds.clip(v() / 100, 0, 1) + 0.25 * F.exp(-k() / 3) + 0.15 * lr + 0.15 * F.exp(-v() / 100) + 0.1 * F.exp(-k()) + 0.05 * F.exp(-v() / 25)
    e = events(spark, d).select("id", s.alias("s"))
    return e.select("id", r(F.col("s"), "score"), rules.first_rule([(F.col("s") >= 0.5, "HIGH"), (F.col("s") >= 0.35, "MEDIUM")], "LOW").alias("state"))


@register("p53_visual_evidence", f"WITH {EV} SELECT id, round(exp(-greatest(CASE WHEN k%2=0 THEN v/50 END, CASE WHEN k%3=0 THEN k/4.0 END, CASE WHEN k>4 THEN abs(v-50)/20 END)),6) AS evidence FROM e")
def p53(spark, d):
    return events(spark, d).select("id", r(ds.visual_evidence(F.when(k() % 2 == 0, v() / 50), F.when(k() % 3 == 0, k() / 4), F.when(k() > 4, F.abs(v() - 50) / 20)), "evidence"))


@register("p54_runtime_confidence", f"WITH {EV} SELECT id, round(greatest(0,least(1,v/80*exp(-coalesce(CASE WHEN k>0 THEN k END,0)/8.0))),6) AS score, round(1-least(3,v/30)/3,6) AS component FROM e")
def p54(spark, d):
    decay = F.exp(-F.coalesce(F.when(k() > 0, k()), F.lit(0)) / 8)
    return events(spark, d).select("id", r(ds.clip(v() / 80 * decay, 0, 1), "score"), r(1 - ds.ratio_risk(v(), 30) / 3, "component"))


@register("p55_validity_gates", f"WITH {TRACKS}, l AS (SELECT event_id, CASE WHEN event_type<>'error' THEN x END AS z, abs(x-lag(x) OVER (PARTITION BY point_id ORDER BY frame)) AS motion FROM t) SELECT CASE WHEN z IS NULL THEN 'ambiguous' WHEN z<5 OR z>90 THEN 'depth_out_of_range' WHEN motion>40 THEN 'motion_rejected' ELSE 'valid' END AS status, count(*) AS n FROM l GROUP BY 1")
def p55(spark, d):
    motion = F.abs(F.col("x") - F.lag("x").over(Window.partitionBy("point_id").orderBy("frame")))
    t = tracks(spark, d).select(F.when(F.col("event_type") != "error", F.col("x")).alias("z"), motion.alias("motion"))
    return t.groupBy(ds.validity(F.col("z"), F.col("motion"), 5, 90, 40).alias("status")).agg(F.count("*").alias("n"))


@register("p56_src14_timestamps", "WITH h AS (SELECT o_custkey AS frame, min(o_totalprice)/1000 AS l, max(o_totalprice)/1000 AS r FROM orders GROUP BY 1) SELECT c_custkey, round(CASE WHEN l IS NOT NULL THEN (l+r)/2 WHEN c_nationkey<20 THEN c_custkey/25.0 END,6) AS t, round(abs(l-r)*1000,4) AS sync_ms, CASE WHEN l IS NOT NULL THEN 'hardware' WHEN c_nationkey<20 THEN 'frame_rate' ELSE 'unavailable' END AS source FROM customer LEFT JOIN h ON frame=c_custkey")
def p56(spark, d):
    """A frame's time: the mean of both hardware stamps, else frame over rate, else none."""
    h = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.min("o_totalprice") / 1000).alias("l"), (F.max("o_totalprice") / 1000).alias("r"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(h, "c_custkey", "left")
    hard, rate = F.col("l").isNotNull(), F.col("c_nationkey") < 20
    t = F.when(hard, (F.col("l") + F.col("r")) / 2).when(rate, F.col("c_custkey") / 25)
    return c.select("c_custkey", r(t, "t"), r(F.abs(F.col("l") - F.col("r")) * 1000, "sync_ms", 4), rules.first_rule([(hard, "hardware"), (rate, "frame_rate")], "unavailable").alias("source"))


@register("p17_p57_accuracy_annotation", f"WITH {EV}, c AS (SELECT id, CASE WHEN k>0 THEN 10.0 END AS target, CASE WHEN v-30>0 THEN (v-30)*100 WHEN k>3 THEN v*100 END AS z, CASE WHEN k<>5 THEN k/10.0+0.01 END AS s FROM e), n AS (SELECT *, target*700*120/(z*z) AS need FROM c) SELECT id, round(need,4) AS need, CASE WHEN target IS NOT NULL THEN round(z*z*s/84000,4) END AS sigma_z, coalesce(s<=need,false) AS feasible, CASE WHEN target IS NULL THEN 'z_target_unavailable_x_y_partial_not_controlling' WHEN s<=need THEN 'uncertainty_floor_within_target' WHEN s IS NOT NULL THEN 'required_sigma_d_below_uncertainty_floor' ELSE 'estimated_uncertainty_unavailable' END AS reason FROM n")
def p17(spark, d):
    """Depth is the first positive one of two stages; the plan follows from it."""
    z = F.coalesce(F.when(v() - 30 > 0, (v() - 30) * 100), F.when(k() > 3, v() * 100))
    e = events(spark, d).select("id", F.when(k() > 0, 10.0).alias("target"), z.alias("z"), F.when(k() != 5, k() / 10 + 0.01).alias("s"))
    plan = ds.precision_plan(F.col("target"), F.col("z"), 700.0, 120.0, F.col("s"), F.lit(None).cast("double"))
    return e.select("id", r(plan["need"], "need", 4), r(plan["sigma_z"], "sigma_z", 4), plan["feasible"].alias("feasible"), plan["reason"].alias("reason"))


@register("st10_low_count_action", f"WITH {TRACKS}, i AS (SELECT *, count(*) FILTER (x>=40) OVER (PARTITION BY point_id ORDER BY frame) AS island FROM t), k AS (SELECT *, count(*) FILTER (x<40) OVER (PARTITION BY point_id, island ORDER BY frame) AS run FROM i) SELECT event_id, CASE WHEN run=0 THEN 'none' WHEN run>=3 THEN 'reinitialize' WHEN event_type='error' THEN 'predict_only' ELSE 'fallback' END AS action FROM k")
def st10(spark, d):
    """What to do after so many low scores in a row."""
    t = tracks(spark, d)
    w = Window.partitionBy("point_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("island", F.count_if(F.col("x") >= 40).over(w))
    run = F.count_if(F.col("x") < 40).over(Window.partitionBy("point_id", "island").orderBy("frame"))
    action = rules.first_rule([(F.col("run") == 0, "none"), (F.col("run") >= 3, "reinitialize"), (F.col("event_type") == "error", "predict_only")], "fallback")
    return t.withColumn("run", run).select("event_id", action.alias("action"))
