"""Alignment joins, ordered-series metrics and state machines over trajectories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from metrilith.operators import align, stats, temporal
from metrilith.operators.components import connected_components
from metrilith.operators.tables import Scratch
from metrilith.plans.registry import register
from metrilith.plans.views import MEASURES, TRACKS, measures, rounded, table, tracks
from metrilith.streaming import state, tracked

XYZ = ["x", "y", "z"]


def r(c, name, n=6):
    return rounded(c, n).alias(name)


# --- joins -------------------------------------------------------------------------------


@register("j1_truth_with_fallback", "WITH g AS (SELECT user_id AS point_id, CASE WHEN event_type='error' THEN -1 ELSE event_id END AS frame, arg_max(value, event_id) AS truth FROM events WHERE event_type IN ('error','click') GROUP BY 1,2) SELECT e.event_id, round(e.value,6) AS value, round(coalesce(a.truth,b.truth),6) AS truth FROM events e LEFT JOIN g a ON a.point_id=e.user_id AND a.frame=e.event_id AND a.frame>=0 LEFT JOIN g b ON b.point_id=e.user_id AND b.frame<0")
def j1(spark, d):
    e = table(spark, d, "events")
    truth = e.filter(F.col("event_type").isin("error", "click")).select(F.col("user_id").alias("point_id"), F.when(F.col("event_type") == "error", F.lit(-1)).otherwise(F.col("event_id")).alias("frame"), F.col("value").alias("truth"), F.col("event_id").alias("row_no"))
    truth = align.last_of(truth, ["point_id", "frame"], "row_no")
    rows = e.select(F.col("user_id").alias("point_id"), F.col("event_id").alias("frame"), "value")
    out = align.with_fallback(rows, truth, "point_id", "frame", ["truth"])
    return out.select(F.col("frame").alias("event_id"), r(F.col("value"), "value"), r(F.col("truth"), "truth"))


@register("j2_truth_override", "WITH u AS (SELECT p_partkey AS k, p_retailprice AS v, 0 AS pri FROM part UNION ALL SELECT s_suppkey, s_acctbal, 1 FROM supplier WHERE s_acctbal>0) SELECT k, round(arg_max(v, pri),4) AS v FROM u GROUP BY 1")
def j2(spark, d):
    base = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"), F.lit(0).alias("pri"))
    over = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"), F.lit(1).alias("pri"))
    return align.last_of(base.unionByName(over), ["k"], "pri").select("k", r(F.col("v"), "v", 4))


@register(
    "j3_frame_alignment",
    """WITH g AS (SELECT l_orderkey AS frame, CASE WHEN l_linenumber%3=0 THEN '' ELSE l_returnflag END AS point, l_extendedprice AS truth, (l_linenumber, l_extendedprice) AS row_no FROM lineitem WHERE l_linenumber>1),
 p AS (SELECT row_number() OVER () AS id, l_orderkey AS frame, l_linenumber, l_returnflag AS point, l_extendedprice FROM lineitem)
 SELECT p.frame, p.l_linenumber, round(p.l_extendedprice,4) AS measured, round(arg_min(g.truth, g.row_no),4) AS truth
 FROM p LEFT JOIN g ON g.frame=p.frame AND (g.point=p.point OR g.point='') GROUP BY p.id, 1, 2, 3""",
)
def j3(spark, d):
    """Each line with the first truth of its frame that is of its point or of any."""
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame"), "l_linenumber", F.col("l_returnflag").alias("point"), "l_extendedprice")
    point = F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("point"))
    g = line.filter("l_linenumber > 1").select("frame", point.alias("point"), F.col("l_extendedprice").alias("truth"), F.struct("l_linenumber", "l_extendedprice").alias("row_no"))
    out = align.truth_of_frame(line, g, "point", "frame", "row_no", ["truth"])
    return out.select("frame", "l_linenumber", r(F.col("l_extendedprice"), "measured", 4), r(F.col("truth"), "truth", 4))


NEAR = "WITH p AS (SELECT event_id, user_id, epoch(ts) AS t FROM events WHERE event_type='purchase'), e AS (SELECT event_id AS other, user_id, epoch(ts) AS t, value FROM events WHERE event_type='error'), n AS (SELECT p.event_id, e.other, e.value, abs(e.t-p.t) AS distance, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(e.t-p.t), e.other) AS k FROM p JOIN e ON p.user_id=e.user_id AND abs(e.t-p.t)<=86400)"


def _near(spark, d):
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "t")
    right = e.filter("event_type = 'error'").select(F.col("event_id").alias("other"), "user_id", "t", "value")
    return align.nearest_in_time(left, right, ["user_id"], "t", 86400.0, "event_id", "other", ["other", "value"])


@register(
    "j4_nearest_in_time",
    """WITH p AS (SELECT event_id, user_id, epoch(ts) AS t FROM events WHERE event_type='purchase'),
 e AS (SELECT event_id AS other, CASE WHEN event_id%5=0 THEN NULL ELSE user_id END AS point, epoch(ts) AS t, value FROM events WHERE event_type='error'),
 n AS (SELECT p.event_id, e.other, e.value, abs(e.t-p.t) AS distance, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(e.t-p.t), e.other) AS k
 FROM p JOIN e ON (p.user_id=e.point OR e.point IS NULL) AND abs(e.t-p.t)<=86400)
 SELECT p.event_id, n.other, round(n.value,6) AS value, round(n.distance,3) AS distance FROM p LEFT JOIN n ON p.event_id=n.event_id AND n.k=1""",
)
def j4(spark, d):
    """Each purchase with the error nearest in time of its user, or of none: one in five errors has no user."""
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "t")
    right = e.filter("event_type = 'error'").select(F.col("event_id").alias("other"), F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("user_id"), "t", "value")
    out = align.nearest_truth(left, right, "user_id", "t", 86400.0, "event_id", "other", ["other", "value"])
    return out.select("event_id", "other", r(F.col("value"), "value"), r(F.col("distance"), "distance", 3))


@register("j5_alignment_rate", f"{NEAR} SELECT count(*) AS n, count(n.other) AS aligned, round(100.0*count(n.other)/count(*),6) AS rate FROM p LEFT JOIN n ON p.event_id=n.event_id AND n.k=1")
def j5(spark, d):
    return _near(spark, d).agg(F.count("*").alias("n"), F.count("other").alias("aligned"), r(100.0 * F.try_divide(F.count("other"), F.count("*")), "rate"))


@register("j6_interpolated_truth", "WITH p AS (SELECT event_id, user_id, epoch(ts) AS t FROM events WHERE event_type='purchase'), s AS (SELECT user_id, epoch(ts) AS t, avg(value) AS v FROM events WHERE event_type='view' GROUP BY ALL), b AS (SELECT p.event_id, p.t, max(s.t) FILTER (s.t<=p.t) AS t0, min(s.t) FILTER (s.t>=p.t) AS t1, arg_max(s.v, s.t) FILTER (s.t<=p.t) AS v0, arg_min(s.v, s.t) FILTER (s.t>=p.t) AS v1 FROM p LEFT JOIN s ON p.user_id=s.user_id GROUP BY 1,2) SELECT event_id, round(CASE WHEN t0=t1 THEN v0 ELSE v0+(v1-v0)*(t-t0)/(t1-t0) END,6) AS value FROM b")
def j6(spark, d):
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "t")
    return align.interpolated(left, e.filter("event_type = 'view'").select("user_id", "t", "value"), ["user_id"], "t", "value", "event_id").select("event_id", r(F.col("value"), "value"))


@register("j8_neighbour_median", "SELECT a.c_custkey, round(quantile_cont(b.c_acctbal,0.5),4) AS others FROM customer a LEFT JOIN customer b ON a.c_nationkey=b.c_nationkey AND a.c_custkey<>b.c_custkey GROUP BY 1")
def j8(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return align.neighbour_median(c, ["c_nationkey"], "c_acctbal", "others").select("c_custkey", r(F.col("others"), "others", 4))


@register("j9_mode_comparison", "WITH b AS (SELECT l_partkey, avg(l_extendedprice) AS base FROM lineitem WHERE l_returnflag='N' GROUP BY 1) SELECT l_returnflag AS method, count(*) AS n, round(avg(l_extendedprice-base),4) AS over_base FROM lineitem LEFT JOIN b USING (l_partkey) GROUP BY 1")
def j9(spark, d):
    m = table(spark, d, "lineitem").select("l_partkey", F.col("l_returnflag").alias("method"), F.col("l_extendedprice").alias("v"))
    base = F.avg(F.when(F.col("method") == "N", F.col("v"))).over(Window.partitionBy("l_partkey"))
    return m.withColumn("base", base).groupBy("method").agg(F.count("*").alias("n"), r(F.avg(F.col("v") - F.col("base")), "over_base", 4))


@register("j12_before_and_after", "WITH k AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS v FROM lineitem GROUP BY ALL) SELECT count(*) AS pairs, count(*) FILTER (b.v<a.v) AS improved, round(avg(a.v-b.v),4) AS gain FROM k a JOIN k b ON a.l_orderkey=b.l_orderkey AND a.l_linenumber=1 AND b.l_linenumber=2")
def j12(spark, d):
    m = table(spark, d, "lineitem").filter("l_linenumber <= 2").groupBy("l_orderkey").agg(F.max(F.when(F.col("l_linenumber") == 1, F.col("l_extendedprice"))).alias("a"), F.max(F.when(F.col("l_linenumber") == 2, F.col("l_extendedprice"))).alias("b")).filter("a is not null and b is not null")
    return m.agg(F.count("*").alias("pairs"), F.count_if(F.col("b") < F.col("a")).alias("improved"), r(F.avg(F.col("a") - F.col("b")), "gain", 4))


@register("j13_semi_join", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity>45) GROUP BY 1")
def j13(spark, d):
    keys = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(keys, "o_orderkey", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@register("j14_snk3_not_completed", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus='F')")
def j14(spark, d):
    done = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(done, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@register(
    "j16_duplicate_components",
    """WITH RECURSIVE d AS (SELECT doc_id, lower(trim(text)) AS a, lang||':'||n_chars AS b, source||':'||lang||':'||left(text, 24) AS c FROM documents),
 k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY a) AS v FROM d UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY b) FROM d UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY c) FROM d),
 e AS (SELECT doc_id AS u, v FROM k UNION SELECT v, doc_id FROM k), reach(a,b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.v FROM reach r JOIN e ON r.b=e.u)
 SELECT a AS doc_id, min(b) AS component FROM reach GROUP BY 1""",
)
def j16(spark, d):
    """Documents joined by any of three composite keys, over any chain of them: text, language and length, or source, language and beginning."""
    text = F.sha2(F.lower(F.trim("text")), 256)
    docs = table(spark, d, "documents").select("doc_id", text.alias("a"), F.concat_ws(":", "lang", "n_chars").alias("b"), F.concat_ws(":", "source", "lang", F.left("text", F.lit(24))).alias("c"))
    edges = None
    for key in ("a", "b", "c"):
        low = docs.groupBy(key).agg(F.min("doc_id").alias("v"))
        e = docs.join(low, key).select(F.col("doc_id").alias("u"), "v")
        edges = e if edges is None else edges.union(e)
    comps = connected_components(edges)
    return comps.select(F.col("node").alias("doc_id"), "component")


# --- series ------------------------------------------------------------------------------


@register("w1_innovations", f"WITH {TRACKS}, l AS (SELECT *, lag(x,1) OVER w x1, lag(x,2) OVER w x2, lag(y,1) OVER w y1, lag(y,2) OVER w y2, lag(z,1) OVER w z1, lag(z,2) OVER w z2, lag(frame,1) OVER w f1, lag(frame,2) OVER w f2 FROM g WINDOW w AS (PARTITION BY point_id ORDER BY frame)) SELECT event_id, round(sqrt((x-2*x1+x2)**2+(y-2*y1+y2)**2+(z-2*z1+z2)**2),6) AS innovation FROM l WHERE frame-f1=1 AND f1-f2=1")
def w1(spark, d):
    t = tracks(spark, d, gaps=True)
    w = temporal.series(["point_id"], "frame")
    return t.withColumn("i", temporal.innovation(XYZ, w, "frame")).filter("i is not null").select("event_id", r(F.col("i"), "innovation"))


@register("w2_jumps", f"WITH {TRACKS}, l AS (SELECT *, lag(x,1) OVER w x1, lag(x,2) OVER w x2, lag(y,1) OVER w y1, lag(y,2) OVER w y2, lag(z,1) OVER w z1, lag(z,2) OVER w z2, lag(frame,1) OVER w f1, lag(frame,2) OVER w f2 FROM g WINDOW w AS (PARTITION BY point_id ORDER BY frame)), i AS (SELECT point_id, CASE WHEN frame-f1=1 AND f1-f2=1 THEN sqrt((x-2*x1+x2)**2+(y-2*y1+y2)**2+(z-2*z1+z2)**2) END AS d, greatest(0.05, 0.9*abs(z1)) AS lim FROM l) SELECT point_id, count(d) AS checks, count(*) FILTER (d>lim) AS jumps FROM i GROUP BY 1")
def w2(spark, d):
    return temporal.jumps(tracks(spark, d, gaps=True), ["point_id"], "frame", XYZ, 0.9)


@register("w4_displacement", f"WITH {TRACKS} SELECT event_id, round(x-first_value(x) OVER (PARTITION BY point_id ORDER BY frame),6) AS dx, round(z-first_value(z) OVER (PARTITION BY point_id ORDER BY frame),6) AS dz FROM t")
def w4(spark, d):
    w = temporal.series(["point_id"], "frame")
    return tracks(spark, d).select("event_id", r(temporal.from_start("x", w), "dx"), r(temporal.from_start("z", w), "dz"))


@register("w5_volatility_and_drift", f"WITH {TRACKS}, c AS (SELECT *, avg(x) OVER (PARTITION BY point_id) cx, avg(y) OVER (PARTITION BY point_id) cy FROM t) SELECT point_id, round(sqrt(avg((x-cx)**2+(y-cy)**2)),6) AS volatility, round(sqrt((arg_max(x,frame)-arg_min(x,frame))**2+(arg_max(y,frame)-arg_min(y,frame))**2),6) AS drift FROM c GROUP BY 1")
def w5(spark, d):
    t = tracks(spark, d)
    ends = [F.max_by(c, "frame") - F.min_by(c, "frame") for c in "xy"]
    return t.groupBy("point_id").agg(r(F.sqrt(F.var_pop("x") + F.var_pop("y")), "volatility"), r(temporal.norm(ends), "drift"))


@register("w6_jitter", f"WITH {TRACKS}, s AS (SELECT point_id, abs(x-lag(x) OVER (PARTITION BY point_id ORDER BY event_id)) AS s FROM t) SELECT point_id, round(coalesce(avg(s),0),6) AS jitter FROM s GROUP BY 1")
def w6(spark, d):
    return temporal.mean_step(tracks(spark, d), ["point_id"], "event_id", "x").select("point_id", r(F.col("jitter"), "jitter"))


@register("w7_stability", f"WITH {TRACKS}, p AS (SELECT point_id, stddev_pop(x) sd, max(x)-min(x) AS ptp, arg_max(x,frame)-arg_min(x,frame) AS drift FROM t GROUP BY 1) SELECT round(avg(sd),6) AS sd, round(avg(ptp),6) AS ptp, round(avg(drift),6) AS drift, round((SELECT stddev_pop(y) FROM t),6) AS pooled_sd FROM p")
def w7(spark, d):
    t = tracks(spark, d)
    p = t.groupBy("point_id").agg(F.stddev_pop("x").alias("sd"), (F.max("x") - F.min("x")).alias("ptp"), (F.max_by("x", "frame") - F.min_by("x", "frame")).alias("drift"))
    pooled = t.agg(r(F.stddev_pop("y"), "pooled_sd"))
    return p.agg(*(r(F.avg(c), c) for c in ("sd", "ptp", "drift"))).crossJoin(pooled)  # one row each


@register("w11_synchrony", f"WITH {TRACKS}, s AS (SELECT frame, point_id, x-lag(x) OVER (PARTITION BY point_id ORDER BY frame) AS step FROM t), k AS (SELECT frame, quantile_cont(step,0.5) AS med, count(step) AS n FROM s GROUP BY 1) SELECT k.frame, k.n, round(med,6) AS median_step, count(*) FILTER (abs(step-med)<=50) AS in_step FROM s JOIN k ON s.frame=k.frame WHERE step IS NOT NULL GROUP BY ALL")
def w11(spark, d):
    t = tracks(spark, d)
    s = t.withColumn("step", F.col("x") - F.lag("x").over(temporal.series(["point_id"], "frame"))).filter("step is not null").select("frame", "step")
    k = s.groupBy("frame").agg(F.percentile("step", F.lit(0.5)).alias("med"), F.count("*").alias("n"))
    return s.join(k, "frame").groupBy("frame", "n", "med").agg(F.count_if(F.abs(F.col("step") - F.col("med")) <= 50).alias("in_step")).select("frame", "n", r(F.col("med"), "median_step"), "in_step")


@register("w16_first_after_event", f"WITH {TRACKS}, l AS (SELECT *, max(frame) FILTER (event_type='error') OVER (PARTITION BY point_id) AS le FROM t) SELECT point_id, max(le) AS last_event, min(frame) FILTER (event_type='view' AND frame>le) AS recovered_at FROM l GROUP BY 1")
def w16(spark, d):
    kind = F.col("event_type")
    return temporal.first_after_last(tracks(spark, d), ["point_id"], "frame", kind == "error", kind == "view")


@register("w17_first_two", f"WITH {TRACKS}, k AS (SELECT point_id, x, row_number() OVER (PARTITION BY point_id ORDER BY frame) AS k FROM t WHERE event_type='purchase') SELECT point_id, round(max(x) FILTER (k=1),6) AS first_x, round(max(x) FILTER (k=2),6) AS second_x FROM k GROUP BY 1")
def w17(spark, d):
    t = tracks(spark, d).filter("event_type = 'purchase'")
    k = t.withColumn("k", F.row_number().over(temporal.series(["point_id"], "frame"))).filter("k <= 2")
    return k.groupBy("point_id").agg(*(r(F.max(F.when(F.col("k") == i, F.col("x"))), n) for i, n in ((1, "first_x"), (2, "second_x"))))


@register("w19_w20_order_and_key_issues", "WITH l AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS p, count(*) OVER (PARTITION BY user_id, ts) AS n FROM events) SELECT 'TIME_NOT_INCREASING' AS issue, count(*) FILTER (p>=ts) AS n FROM l UNION ALL SELECT 'DUPLICATE_KEY', count(*) FILTER (n>1) FROM l")
def w19(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    late = e.withColumn("p", F.lag("ts").over(temporal.series(["user_id"], "event_id"))).agg(F.count_if(F.col("p") >= F.col("ts")).alias("n")).select(F.lit("TIME_NOT_INCREASING").alias("issue"), "n")
    twice = e.groupBy("user_id", "ts").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("n")).select(F.lit("DUPLICATE_KEY").alias("issue"), "n")
    return late.unionByName(twice)


@register("st7_stabilised_series", f"WITH {TRACKS}, l AS (SELECT event_id, x, lag(CASE WHEN event_type<>'error' THEN x END IGNORE NULLS) OVER (PARTITION BY point_id ORDER BY frame) AS p FROM t) SELECT event_id, round(CASE WHEN abs(x-p)<=30 AND x<80 THEN p+0.2*(x-p) ELSE x END,6) AS x FROM l")
def st7(spark, d):
    w = temporal.series(["point_id"], "frame").rowsBetween(Window.unboundedPreceding, -1)
    t = tracks(spark, d).withColumn("p", F.last(F.when(F.col("event_type") != "error", F.col("x")), True).over(w))
    step = F.col("x") - F.col("p")
    return t.select("event_id", r(F.when((F.abs(step) <= 30) & (F.col("x") < 80), F.col("p") + 0.2 * step).otherwise(F.col("x")), "x"))


@register("st5_confidence_states", f"WITH {TRACKS}, i AS (SELECT *, count(*) FILTER (x>=20) OVER (PARTITION BY point_id ORDER BY frame) AS island FROM t), k AS (SELECT *, count(*) FILTER (x<20) OVER (PARTITION BY point_id, island ORDER BY frame) AS run FROM i) SELECT event_id, run AS very_low_frames, CASE WHEN x>=50 THEN 'ACCEPTED' WHEN x>=20 THEN 'LOW' WHEN run>=3 THEN 'LOST' ELSE 'LOW' END AS state FROM k")
def st5(spark, d):
    return temporal.held_counter(tracks(spark, d), ["point_id"], "frame", "x", 20, 50, 3).select("event_id", "very_low_frames", "state")


@register("st1_lifecycle", f"WITH {TRACKS}, i AS (SELECT *, count(*) FILTER (event_type<>'error') OVER (PARTITION BY point_id ORDER BY frame) AS island FROM t), k AS (SELECT *, count(*) FILTER (event_type='error') OVER (PARTITION BY point_id, island ORDER BY frame) AS run FROM i) SELECT event_id, run AS failures, CASE WHEN run=0 THEN 'tracking' WHEN run<3 THEN 'recovering' ELSE 'lost' END AS state FROM k")
def st1(spark, d):
    return state.lifecycle(tracks(spark, d).withColumn("ok", F.col("event_type") != "error")).select("event_id", "failures", "state")


@register("st2_adaptive_kalman")
def st2(spark, d):
    return state.kalman(tracks(spark, d).select("point_id", "frame", "t", *XYZ), noise=100.0)


@register("st3_quarantine")
def st3(spark, d):
    t = tracks(spark, d).select("point_id", "frame", F.col("frame").cast("double").alias("t"), *XYZ, F.lit(False).alias("hard"), (F.col("event_type") == "error").alias("anomaly"), (F.col("x") > 90).alias("suspicious"))
    return state.quarantine(t, state.Limits(correction=500.0, consistency=60.0, gap=2.0))


@register(
    "st1_st8_tracker_stream",
    f"""WITH {TRACKS}, o AS (SELECT point_id, frame, t, x, event_type<>'error' AS ok, CASE WHEN event_type<>'error' THEN t END AS tok, CASE WHEN event_type<>'error' THEN x END AS xo FROM t),
 l AS (SELECT *, lag(tok, 1 IGNORE NULLS) OVER w AS t1, lag(xo, 1 IGNORE NULLS) OVER w AS x1, lag(tok, 2 IGNORE NULLS) OVER w AS t0, lag(xo, 2 IGNORE NULLS) OVER w AS x0,
  count(*) FILTER (ok) OVER w AS good, count(*) FILTER (x>=20) OVER w AS shown FROM o WINDOW w AS (PARTITION BY point_id ORDER BY frame)),
 c AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY point_id, good ORDER BY frame) AS failures, count(*) FILTER (x<20) OVER (PARTITION BY point_id, shown ORDER BY frame) AS low_frames,
  min(frame) FILTER (NOT ok) OVER (PARTITION BY point_id, good ORDER BY frame) AS started FROM l),
 d AS (SELECT *, lag(started) OVER (PARTITION BY point_id ORDER BY frame) AS since FROM c),
 e AS (SELECT *, CASE WHEN ok AND since IS NOT NULL THEN greatest(1, frame - since) END AS took FROM d)
 SELECT point_id, frame, CASE WHEN failures=0 THEN 'tracking' WHEN failures<3 THEN 'recovering' ELSE 'lost' END AS state, failures::INT AS failures,
  (count(took) OVER w)::INT AS recoveries, (coalesce(sum(took) OVER w, 0))::BIGINT AS recovery_frames,
  CASE WHEN x>=80 THEN 'HIGH' WHEN x>=50 THEN 'MEDIUM' WHEN x>=20 THEN 'LOW' WHEN low_frames>=3 THEN 'LOST' ELSE 'LOW' END AS confidence, low_frames::INT AS low_frames,
  round(CASE WHEN ok AND x1 IS NOT NULL AND x<60 AND abs(x-x1)<=15 THEN x1+0.2*(x-x1) WHEN ok THEN x END, 6) AS stabilised,
  round(CASE WHEN t0 IS NULL OR t0=t1 THEN x1 ELSE x1+(x1-x0)/(t1-t0)*(t-t1) END, 6) AS predicted, round(1+0.01::DOUBLE*count(x1) OVER w, 6) AS spread
 FROM e WINDOW w AS (PARTITION BY point_id ORDER BY frame)""",
)
def st1_st8(spark, d):
    """All states of tracked points from a stream that stops twice and goes on from its checkpoint."""
    kept = Scratch(spark, "tracker")
    root = kept.root
    t = tracks(spark, d).select("point_id", "frame", "t", *XYZ, F.col("x").alias("score"), (F.col("event_type") != "error").alias("ok"))
    t = kept.write(t, "rows")
    first, second = t.agg(F.percentile_approx("t", [0.3, 0.7])).first()[0] or (0.0, 0.0)  # a stop may be anywhere, so about there will do
    rules = tracked.Rules(low=20, medium=50, high=80, smooth=15, far=60, noise=100)
    for k, part in enumerate([t.filter(F.col("t") <= first), t.filter((F.col("t") > first) & (F.col("t") <= second)), t.filter(F.col("t") > second)]):
        part.write.parquet(f"{root}/in/batch={k}")
        stream = spark.readStream.schema(t.schema).option("recursiveFileLookup", True).parquet(f"{root}/in")
        tracked.run(tracked.track(stream, rules), f"{root}/out", f"{root}/checkpoint")
    kept.drop(t)
    plain = ["point_id", "frame", "state", "failures", "recoveries", "recovery_frames", "confidence", "low_frames"]
    return spark.read.schema(tracked.OUT).parquet(f"{root}/out").select(*plain, *(r(F.col(c), c) for c in ("stabilised", "predicted", "spread")))


@register("w21_every_kth", f"WITH {MEASURES}, k AS (SELECT method, frame, point_id, row_number() OVER (PARTITION BY method ORDER BY frame, point_id) AS k FROM m) SELECT method, frame, point_id FROM k WHERE (k-1)%50=0")
def w21(spark, d):
    m = measures(spark, d).select("method", "frame", "point_id")
    return stats.placed(m, ["method"], ["frame", "point_id"], "k").filter("(k - 1) % 50 = 0").drop("k")
