"""Summaries over groups: scenario and sequence blocks, recovery classes, resampling, audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from metrilith.functions import rules
from metrilith.operators import stats, temporal
from metrilith.plans.registry import register
from metrilith.plans.views import MEASURES, TRACKS, measures, rounded, table, tracks


def r(c, name, n=6):
    return rounded(c, n).alias(name)


def valid():
    return F.col("status") == "F"


@register("a4_stage_substrings", "SELECT o_orderstatus AS status, count(*) FILTER (contains(lower(o_orderpriority),'urgent')) AS urgent, count(*) FILTER (contains(lower(o_orderpriority),'low')) AS low FROM orders GROUP BY 1")
def a4(spark, d):
    has = lambda x: F.count_if(F.contains(F.lower("o_orderpriority"), F.lit(x))).alias(x)
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(has("urgent"), has("low"))


@register("a8_radial_distance_error", "WITH e AS (SELECT label, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE))) - 1 AS e FROM embeddings) SELECT label, round(avg(abs(e)),6) AS mae, round(sqrt(avg(e*e)),6) AS rmse FROM e GROUP BY 1")
def a8(spark, d):
    """How far the length of each vector is from one."""
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    e = table(spark, d, "embeddings").select("label", (length - 1).alias("e"))
    return e.groupBy("label").agg(r(stats.mae(F.col("e")), "mae"), r(stats.rmse(F.col("e")), "rmse"))


#: What stands for "nothing was done" in a status.
SENTINELS = ["", "none", "not_attempted", "not_run", "disabled"]


@register("a11_quality_block", "WITH q AS (SELECT user_id, value, CASE event_id%6 WHEN 0 THEN '' WHEN 1 THEN 'none' WHEN 2 THEN 'Not_Attempted ' WHEN 3 THEN 'cycle_valid' WHEN 4 THEN 'cycle_soft' ELSE 'cycle_failed' END AS status FROM events), a AS (SELECT *, lower(trim(status)) NOT IN ('','none','not_attempted','not_run','disabled') AS tried FROM q) SELECT user_id, count(*) FILTER (tried) AS attempts, round(100.0*count(*) FILTER (tried AND status='cycle_valid')/nullif(count(*) FILTER (tried),0),6) AS valid_rate, round(100.0*count(*) FILTER (tried AND status='cycle_failed')/nullif(count(*) FILTER (tried),0),6) AS failed_rate, round(avg(value) FILTER (tried),6) AS mean_error, round(max(value) FILTER (tried),6) AS worst, round(avg(value) FILTER (status='cycle_soft'),6) AS soft_error FROM a GROUP BY 1")
def a11(spark, d):
    """Rates and errors of attempts; statuses that stand for nothing are no attempts."""
    k = F.col("event_id") % 6
    status = F.when(k == 0, "").when(k == 1, "none").when(k == 2, "Not_Attempted ").when(k == 3, "cycle_valid").when(k == 4, "cycle_soft").otherwise("cycle_failed")
    tried = ~F.lower(F.trim("status")).isin(SENTINELS)
    q = table(spark, d, "events").select("user_id", "value", status.alias("status"))
    rate = lambda s: r(stats.share(F.col("status") == s, tried), f"{s[6:]}_rate")
    val = F.when(tried, F.col("value"))
    return q.groupBy("user_id").agg(F.count_if(tried).alias("attempts"), rate("cycle_valid"), rate("cycle_failed"), r(F.avg(val), "mean_error"), r(F.max(val), "worst"), r(F.avg(F.when(F.col("status") == "cycle_soft", F.col("value"))), "soft_error"))


UNIFORM = "('0x'||substr(md5({}),1,8))::BIGINT/4294967296.0"
POISSON = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]


def uniform(key):
    """A number in [0, 1) from the hash of a key: the same on every run and every executor."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / 4294967296.0


@register(
    "a15_a16_paired_bootstrap",
    f"WITH {MEASURES}, s AS (SELECT source, avg(abs(err)) FILTER (status='O') - avg(abs(err)) FILTER (status='F') AS diff FROM m GROUP BY 1), u AS (SELECT i AS round_no, diff, {UNIFORM.format(chr(39) + '2026:' + chr(39) + '||source||' + chr(39) + ':' + chr(39) + '||i')} AS u FROM s, range(10000) r(i) WHERE diff IS NOT NULL), w AS (SELECT round_no, diff, CASE {' '.join(f'WHEN u<{p:.8f} THEN {k}' for k, p in enumerate(POISSON))} ELSE 6 END AS w FROM u), b AS (SELECT round_no, sum(diff*w)/nullif(sum(w),0) AS mean FROM w GROUP BY 1) SELECT (SELECT count(diff) FROM s) AS pairs, (SELECT round(avg(diff),4) FROM s) AS mean, round(quantile_cont(mean,0.025),4) AS low, round(quantile_cont(mean,0.975),4) AS high FROM b",
)
def a15(spark, d, rounds: int = 10_000):
    """Mean paired difference of sequences and the 95 % interval of its resamples.

    Each sequence counts in each round as often as a Poisson variable of mean one, so a
    round's sums add up over partitions; resampling without the whole list in one place.
    """
    m = measures(spark, d)
    part = lambda s: F.avg(F.when(F.col("status") == s, F.abs("err")))
    s = m.groupBy("source").agg((part("O") - part("F")).alias("diff")).filter("diff is not null")
    u = s.select("source", "diff", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round_no"))
    x = uniform(F.concat(F.lit("2026:"), F.col("source").cast("string"), F.lit(":"), F.col("round_no").cast("string")))
    u = u.withColumn("u", x).withColumn("w", rules.first_rule([(F.col("u") < p, k) for k, p in enumerate(POISSON)], 6))
    b = u.groupBy("round_no").agg(F.try_divide(F.sum(F.col("diff") * F.col("w")), F.sum("w")).alias("mean"))
    ends = b.agg(r(F.percentile("mean", F.lit(0.025)), "low", 4), r(F.percentile("mean", F.lit(0.975)), "high", 4))
    return s.agg(F.count("*").alias("pairs"), r(F.avg("diff"), "mean", 4)).crossJoin(ends)  # one row each


@register("a18_disparity_metrics", "WITH e AS (SELECT event_type, value AS p, event_id%50-5.0 AS g FROM events) SELECT event_type, count(*) FILTER (g>0) AS n, round(avg(abs(p-g)) FILTER (g>0),6) AS mae, round(sqrt(avg((p-g)**2) FILTER (g>0)),6) AS rmse, round(100.0*count(*) FILTER (g>0 AND abs(p-g)>3)/count(*) FILTER (g>0),6) AS bad_3 FROM e GROUP BY 1")
def a18(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("value").alias("p"), (F.col("event_id") % 50 - 5.0).alias("g"))
    good = (F.col("g") > 0) & ~F.isnan("p")
    err = F.when(good, F.col("p") - F.col("g"))
    return e.groupBy("event_type").agg(F.count_if(good).alias("n"), r(stats.mae(err), "mae"), r(stats.rmse(err), "rmse"), r(stats.share(F.abs(F.col("p") - F.col("g")) > 3, good), "bad_3"))


@register("a20_sequence_summary", f"WITH {TRACKS}, s AS (SELECT point_id%5 AS seq, point_id, x, event_type, CASE WHEN event_type<>'error' THEN abs(x-lag(CASE WHEN event_type<>'error' THEN x END IGNORE NULLS) OVER (PARTITION BY point_id ORDER BY frame)) END AS step FROM t) SELECT seq, count(*) AS n, round(1.0*count(*) FILTER (event_type<>'error')/count(*),6) AS coverage, round(1.0*count(*) FILTER (event_type='purchase')/count(*),6) AS loss_rate, round(coalesce(avg(step),0),6) AS jitter, round(avg(x),6) AS mae, round(1.0*count(*) FILTER (x>10)/count(*),6) AS cer_10 FROM s GROUP BY 1")
def a20(spark, d):
    """Steps run from one valid row of a point to its next valid one."""
    w = temporal.series(["point_id"], "frame")
    fine = F.col("event_type") != "error"
    good = tracks(spark, d).withColumn("seq", F.col("point_id") % 5)
    before = F.last(F.when(fine, F.col("x")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = good.withColumn("step", F.when(fine, F.abs(F.col("x") - before)))
    part = lambda c: F.try_divide(F.count_if(c), F.count("*"))
    return s.groupBy("seq").agg(F.count("*").alias("n"), r(part(fine), "coverage"), r(part(F.col("event_type") == "purchase"), "loss_rate"), r(F.coalesce(F.avg("step"), F.lit(0.0)), "jitter"), r(F.avg("x"), "mae"), r(part(F.col("x") > 10), "cer_10"))


@register("a27_a60_r3_method_summary", f"WITH {MEASURES} SELECT method, round(100.0*count(*) FILTER (status='F')/count(*),6) AS coverage, round(avg(abs(err)) FILTER (status='F'),4) AS mae, coalesce(round(avg(qty) FILTER (qty>60),4)::VARCHAR,'') AS blank_mean, 'N/A' AS temporal FROM m GROUP BY 1")
def a27(spark, d):
    """Means over blanks alone are blank, and what a method can't have is N/A."""
    blank = F.coalesce(rounded(F.avg(F.when(F.col("qty") > 60, F.col("qty"))), 4).cast("string"), F.lit(""))
    return measures(spark, d).groupBy("method").agg(r(stats.share(valid()), "coverage"), r(stats.mae(F.when(valid(), F.col("err"))), "mae", 4), blank.alias("blank_mean"), F.lit("N/A").alias("temporal"))


@register("a29_a33_quality_means_and_states", f"WITH {MEASURES} SELECT method, CASE WHEN confidence>0.75 THEN 'HIGH' WHEN confidence>0.5 THEN 'MEDIUM' ELSE 'LOW' END AS state, count(*) AS n, round(avg(confidence),6) AS confidence, round(avg(margin),6) AS margin FROM m GROUP BY ALL")
def a29(spark, d):
    state = rules.first_rule([(F.col("confidence") > 0.75, "HIGH"), (F.col("confidence") > 0.5, "MEDIUM")], "LOW")
    return measures(spark, d).groupBy("method", state.alias("state")).agg(F.count("*").alias("n"), r(F.avg("confidence"), "confidence"), r(F.avg("margin"), "margin"))


OUTCOME = "CASE WHEN {0}<b-1e-6 THEN 'BENEFICIAL' WHEN {0}>b+1e-6 THEN 'HARMFUL' ELSE 'NEUTRAL' END"
ARMS = f"WITH {MEASURES}, a AS (SELECT status AS arm, part, truth*0.3 AS b, abs(err) AS e0, abs(err)*0.9 AS e1 FROM m), o AS (SELECT *, {OUTCOME.format('e0')} AS o0, {OUTCOME.format('e1')} AS o1, b-e0 AS g0, b-e1 AS g1 FROM a)"


def _arms(spark, d):
    m = measures(spark, d).select(F.col("status").alias("arm"), "part", (F.col("truth") * 0.3).alias("b"), F.abs("err").alias("e0"), (F.abs("err") * 0.9).alias("e1"))
    out = lambda c: F.when(F.col(c) < F.col("b") - 1e-6, "BENEFICIAL").when(F.col(c) > F.col("b") + 1e-6, "HARMFUL").otherwise("NEUTRAL")
    return m.withColumns({"o0": out("e0"), "o1": out("e1"), "g0": F.col("b") - F.col("e0"), "g1": F.col("b") - F.col("e1")})


@register("a31_candidate_quality", f"{ARMS} SELECT arm, count(*) AS n, count(*) FILTER (o0='BENEFICIAL') AS beneficial, count(*) FILTER (o0='HARMFUL') AS harmful, round(quantile_cont(g0,0.5),4) AS median_gain FROM o GROUP BY 1")
def a31(spark, d):
    is_ = lambda x: F.count_if(F.col("o0") == x)
    o = _arms(spark, d)
    counts = o.groupBy("arm").agg(F.count("*").alias("n"), is_("BENEFICIAL").alias("beneficial"), is_("HARMFUL").alias("harmful"))
    return counts.join(stats.quantiles(o, ["arm"], "g0", {"median_gain": 0.5}), "arm", "left").withColumn("median_gain", rounded("median_gain", 4))


@register("a50_predictor_acceptance", f"{ARMS}, c AS (SELECT count(*) FILTER (arm='F' AND o0='HARMFUL') AS h0, count(*) FILTER (arm='F' AND o1='HARMFUL') AS h1, count(*) FILTER (arm='F' AND o0='BENEFICIAL') AS b0, count(*) FILTER (arm='F' AND o1='BENEFICIAL') AS b1, count(*) FILTER (arm='O' AND o0='HARMFUL') AS c0, count(*) FILTER (arm='O' AND o1='HARMFUL') AS c1, quantile_cont(g0,0.5) FILTER (arm='F') AS m0, quantile_cont(g1,0.5) FILTER (arm='F') AS m1 FROM o) SELECT h0-h1 AS harmful_reduction, round(m0,4) AS median_0, round(m1,4) AS median_1, h0-h1>=2 AS less_harm, b1>=b0 AS no_less_good, m1>m0 AS better_median, c1<=c0 AS clean_kept, h0-h1>=2 AND b1>=b0 AND m1>m0 AND c1<=c0 AS accepted FROM c")
def a50(spark, d):
    o = _arms(spark, d)
    n = lambda arm, c, x: F.count_if((F.col("arm") == arm) & (F.col(c) == x))
    c = o.agg(n("F", "o0", "HARMFUL").alias("h0"), n("F", "o1", "HARMFUL").alias("h1"), n("F", "o0", "BENEFICIAL").alias("b0"), n("F", "o1", "BENEFICIAL").alias("b1"), n("O", "o0", "HARMFUL").alias("c0"), n("O", "o1", "HARMFUL").alias("c1"))
    hit = o.filter("arm = 'F'")
    for name in ("0", "1"):
        c = c.crossJoin(stats.quantiles(hit, ["arm"], f"g{name}", {f"m{name}": 0.5}).drop("arm"))  # one row each
    less, good, med, clean = F.col("h0") - F.col("h1") >= 2, F.col("b1") >= F.col("b0"), F.col("m1") > F.col("m0"), F.col("c1") <= F.col("c0")
    return c.select((F.col("h0") - F.col("h1")).alias("harmful_reduction"), r(F.col("m0"), "median_0", 4), r(F.col("m1"), "median_1", 4), less.alias("less_harm"), good.alias("no_less_good"), med.alias("better_median"), clean.alias("clean_kept"), (less & good & med & clean).alias("accepted"))


@register("a35_distinct_sizes", "SELECT count(*) AS files, round(sum(n)/1024.0/1024/1024,9) AS gib FROM (SELECT url, max(length(html)) AS n FROM pages WHERE url IS NOT NULL GROUP BY 1)")
def a35(spark, d):
    f = table(spark, d, "pages").filter("url is not null").groupBy("url").agg(F.max(F.length("html")).alias("n"))
    return f.agg(F.count("*").alias("files"), r(F.sum("n") / 1024.0**3, "gib", 9))


@register("a42_retry_effect", "WITH o AS (SELECT l_orderkey, max(l_quantity) FILTER (l_linenumber=1) AS a, max(l_quantity) FILTER (l_linenumber=2) AS b FROM lineitem GROUP BY 1 HAVING a IS NOT NULL AND b IS NOT NULL) SELECT CASE WHEN a>30 THEN 'high' WHEN a>15 THEN 'medium' ELSE 'low' END AS stratum, count(*) AS pairs, count(*) FILTER (b<a) AS improved, count(*) FILTER (b>a) AS worsened, count(*) FILTER (b=a) AS same, round(avg(a-b),6) AS mean_gain FROM o GROUP BY 1")
def a42(spark, d):
    at = lambda n: F.max(F.when(F.col("l_linenumber") == n, F.col("l_quantity")))
    o = table(spark, d, "lineitem").filter("l_linenumber <= 2").groupBy("l_orderkey").agg(at(1).alias("a"), at(2).alias("b")).filter("a is not null and b is not null")
    a, b = F.col("a"), F.col("b")
    return o.groupBy(rules.first_rule([(a > 30, "high"), (a > 15, "medium")], "low").alias("stratum")).agg(F.count("*").alias("pairs"), F.count_if(b < a).alias("improved"), F.count_if(b > a).alias("worsened"), F.count_if(a == b).alias("same"), r(F.avg(a - b), "mean_gain"))


NORMAL = "sqrt(-2*ln(greatest({0},1e-12)))*cos(2*pi()*{1})"


@register(
    "a43_a55_g2_noise_table",
    f"WITH c AS (SELECT n.v AS noise, b.v AS baseline, z.v AS depth, i FROM (VALUES (0.1),(0.5)) n(v), (VALUES (60.0),(120.0)) b(v), (VALUES (1000.0),(3000.0)) z(v), range(500) r(i)), u AS (SELECT *, {UNIFORM.format(chr(39) + 'u' + chr(39) + '||i')} AS u0, {UNIFORM.format(chr(39) + 'w' + chr(39) + '||i')} AS u1 FROM c), e AS (SELECT noise, baseline, depth, 700*baseline/(700*baseline/depth + noise*{NORMAL.format('u0', 'u1')}) - depth AS err FROM u) SELECT noise::DOUBLE AS noise, baseline::DOUBLE AS baseline, depth::DOUBLE AS depth, round(sqrt(avg(err*err)),3) AS rmse, round(avg(err),3) AS bias, round(any_value(depth*depth*noise/(700*baseline)),6) AS theory FROM e GROUP BY ALL",
)
def a55(spark, d, rounds: int = 500):
    """Depth error under disparity noise against its first-order theory, for a grid of conditions."""
    grid = spark.createDataFrame([(n, b, z) for n in (0.1, 0.5) for b in (60.0, 120.0) for z in (1000.0, 3000.0)], "noise double, baseline double, depth double")
    i = F.col("id").cast("string")
    u0, u1 = uniform(F.concat(F.lit("u"), i)), uniform(F.concat(F.lit("w"), i))
    g = F.sqrt(-2 * F.log(F.greatest(u0, F.lit(1e-12)))) * F.cos(2 * F.pi() * u1)
    e = spark.range(rounds).select(g.alias("g")).crossJoin(F.broadcast(grid))  # eight conditions
    f = 700 * F.col("baseline")
    e = e.withColumn("err", f / (f / F.col("depth") + F.col("noise") * F.col("g")) - F.col("depth"))
    return e.groupBy("noise", "baseline", "depth").agg(r(stats.rmse(F.col("err")), "rmse", 3), r(F.avg("err"), "bias", 3), r(F.first(F.col("depth") ** 2 * F.col("noise") / f), "theory"))


@register("a47_w15_scenario_metrics", f"WITH {TRACKS}, c AS (SELECT point_id%3 AS scenario, point_id, frame, abs(x-50) AS raw, abs(0.5*(x-50)) AS cor, x-50 AS e, event_type='error' AS fault FROM t), j AS (SELECT *, e-lag(e) OVER (PARTITION BY point_id ORDER BY frame) AS step FROM c), p AS (SELECT scenario, point_id, coalesce(stddev_pop(step),0) AS jitter FROM j GROUP BY ALL), q AS (SELECT scenario, avg(jitter) AS jitter FROM p GROUP BY 1) SELECT j.scenario, count(*) AS n, round(avg(raw),6) AS raw_mae, round(sqrt(avg(cor*cor)),6) AS corrected_rmse, round(any_value(jitter),6) AS jitter, count(*) FILTER (raw>10) AS raw_jumps, round(1-sum(cor) FILTER (fault)/nullif(sum(raw) FILTER (fault),0),6) AS suppression, round(1.0*count(*) FILTER (NOT fault AND raw>40)/greatest(count(*) FILTER (NOT fault),1),6) AS false_correction_rate FROM j JOIN q USING (scenario) GROUP BY 1")
def a47(spark, d):
    """Errors before and after correction; jitter is the mean over points of the spread of an error's steps."""
    e, fault = F.col("x") - 50, F.col("event_type") == "error"
    c = tracks(spark, d).select((F.col("point_id") % 3).alias("scenario"), "point_id", "frame", e.alias("e"), F.abs(e).alias("raw"), F.abs(0.5 * e).alias("cor"), fault.alias("fault"))
    j = c.withColumn("step", F.col("e") - F.lag("e").over(temporal.series(["point_id"], "frame")))
    raw, cor, hit = F.col("raw"), F.col("cor"), F.col("fault")
    p = j.groupBy("scenario", "point_id").agg(F.coalesce(F.stddev_pop("step"), F.lit(0.0)).alias("jitter"), F.count("*").alias("n"), F.sum("raw").alias("s_raw"), F.sum(cor * cor).alias("s_cor"), F.count_if(raw > 10).alias("jumps"), F.sum(F.when(hit, cor)).alias("f_cor"), F.sum(F.when(hit, raw)).alias("f_raw"), F.count_if(~hit & (raw > 40)).alias("wrong"), F.count_if(~hit).alias("clean"))
    n = F.sum("n")
    return p.groupBy("scenario").agg(n.alias("n"), r(F.sum("s_raw") / n, "raw_mae"), r(F.sqrt(F.sum("s_cor") / n), "corrected_rmse"), r(F.avg("jitter"), "jitter"), F.sum("jumps").alias("raw_jumps"), r(1 - F.try_divide(F.sum("f_cor"), F.sum("f_raw")), "suppression"), r(F.sum("wrong") / F.greatest(F.sum("clean"), F.lit(1)), "false_correction_rate"))


@register("a48_lag_estimate", f"WITH {TRACKS}, l AS (SELECT i::INTEGER-3 AS lag FROM range(7) r(i)), s AS (SELECT a.point_id, l.lag, avg((a.x-b.y)**2) AS mse FROM t a, l JOIN t b ON b.point_id=a.point_id AND b.frame=a.frame-l.lag GROUP BY ALL) SELECT point_id, arg_min(lag, (round(mse,9), lag)) AS lag FROM s GROUP BY 1")
def a48(spark, d, most: int = 3):
    """The shift in frames at which two series of a point differ least; ties go to the smallest shift.

    Each row is sent to the few frames it can meet, so the shifted series are equi-joined.
    """
    t = tracks(spark, d)
    a = t.select("point_id", F.col("frame").alias("f"), "x", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag")).withColumn("frame", F.col("f") - F.col("lag"))
    s = a.join(t.select("point_id", "frame", "y"), ["point_id", "frame"]).groupBy("point_id", "lag").agg(F.avg((F.col("x") - F.col("y")) ** 2).alias("mse"))
    return s.groupBy("point_id").agg(F.min_by("lag", F.struct(rounded("mse", 9), "lag")).alias("lag"))


CLEAN = f"WITH {TRACKS}, e AS (SELECT *, max(frame) FILTER (event_type='error') OVER (PARTITION BY point_id) AS ended FROM t)"


@register("a51_recovery_classes", f"{CLEAN}, f AS (SELECT point_id, x, ended, row_number() OVER (PARTITION BY point_id ORDER BY frame) AS k FROM e WHERE frame>ended AND event_type IN ('view','purchase')), h AS (SELECT p.point_id, p.ended, count(f.k) AS n, min(f.k) FILTER (f.x<60) AS first_normal FROM (SELECT DISTINCT point_id, ended FROM e WHERE ended IS NOT NULL) p LEFT JOIN f ON f.point_id=p.point_id AND f.k<=2 GROUP BY ALL) SELECT point_id, ended, CASE WHEN n=0 THEN 'I1_BASELINE_NOT_RECOVERED' WHEN n<2 THEN 'I2_RECOVERY_INSUFFICIENT_VALID_OBSERVATIONS' WHEN first_normal IS NOT NULL THEN 'I2_RECOVERY_CONFIRMED' ELSE 'I2_RECOVERY_FAILURE' END AS recovery_class, CASE WHEN n=2 THEN first_normal END AS observations_to_normal FROM h")
def a51(spark, d):
    """What the first two valid rows after a point's last fault say; points without a fault have no class."""
    t = tracks(spark, d)
    e = t.withColumn("ended", F.max(F.when(F.col("event_type") == "error", F.col("frame"))).over(Window.partitionBy("point_id"))).filter("ended is not null")
    good = (F.col("frame") > F.col("ended")) & F.col("event_type").isin("view", "purchase")
    k = F.count_if(good).over(temporal.series(["point_id"], "frame"))
    e = e.withColumn("good", good).withColumn("k", k)
    among = F.col("good") & (F.col("k") <= 2)
    g = e.groupBy("point_id", "ended").agg(F.count_if(among).alias("n"), F.min(F.when(among & (F.col("x") < 60), F.col("k"))).alias("first"))
    kind = rules.first_rule([(F.col("n") == 0, "I1_BASELINE_NOT_RECOVERED"), (F.col("n") < 2, "I2_RECOVERY_INSUFFICIENT_VALID_OBSERVATIONS"), (F.col("first").isNotNull(), "I2_RECOVERY_CONFIRMED")], "I2_RECOVERY_FAILURE")
    return g.select("point_id", "ended", kind.alias("recovery_class"), F.when(F.col("n") == 2, F.col("first")).alias("observations_to_normal"))


@register("a52_stale_predictions", f"WITH {TRACKS}, f AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY frame) AS k FROM t WHERE frame>=3 AND event_type<>'error'), h AS (SELECT point_id, count(*) FILTER (k<=2) AS n, max(x) FILTER (k=1) AS x1, max(x) FILTER (k=2) AS x2, max(y) FILTER (k=1) AS p FROM f GROUP BY 1) SELECT point_id, round(CASE WHEN n=2 THEN abs(x1-x2) END,6) AS pair_distance, CASE WHEN n<2 THEN 'INSUFFICIENT_CLEAN_OBSERVATIONS' WHEN abs(x1-x2)<=10 AND abs(x1-p)>10 AND abs(x2-p)>10 THEN 'STALE_PREDICTION' ELSE 'NOT_STALE' END AS pattern FROM h")
def a52(spark, d):
    """Two clean rows that agree with each other and not with the old prediction."""
    f = tracks(spark, d).filter("frame >= 3 and event_type <> 'error'").withColumn("k", F.row_number().over(temporal.series(["point_id"], "frame"))).filter("k <= 2")
    at = lambda c, n: F.max(F.when(F.col("k") == n, F.col(c)))
    g = f.groupBy("point_id").agg(F.count("*").alias("n"), at("x", 1).alias("x1"), at("x", 2).alias("x2"), at("y", 1).alias("p"))
    far = lambda a, b: F.abs(F.col(a) - F.col(b))
    pattern = rules.first_rule([(F.col("n") < 2, "INSUFFICIENT_CLEAN_OBSERVATIONS"), ((far("x1", "x2") <= 10) & (far("x1", "p") > 10) & (far("x2", "p") > 10), "STALE_PREDICTION")], "NOT_STALE")
    return g.select("point_id", r(far("x1", "x2"), "pair_distance"), pattern.alias("pattern"))


@register("a53_geometry_health", "WITH e AS (SELECT event_type, value-event_id%100 AS dy FROM events) SELECT event_type, round(quantile_cont(abs(dy),0.5),6) AS median, round(quantile_cont(abs(dy),0.95),6) AS p95, round(sqrt(avg(dy*dy)),6) AS rms, round(exp(-sqrt(avg(dy*dy))/50),6) AS health FROM e GROUP BY 1")
def a53(spark, d):
    e = table(spark, d, "events").select("event_type", (F.col("value") - F.col("event_id") % 100).alias("dy")).withColumn("a", F.abs("dy"))
    rms = stats.rmse(F.col("dy"))
    q = stats.quantiles(e, ["event_type"], "a", {"median": 0.5, "p95": 0.95})
    return e.groupBy("event_type").agg(r(rms, "rms"), r(F.exp(-rms / 50), "health")).join(q, "event_type").withColumns({c: rounded(c, 6) for c in ("median", "p95")})


@register("a54_w9_displacement_error", f"WITH {TRACKS}, s AS (SELECT x-first_value(x) OVER w AS dx, y-first_value(y) OVER w AS dy FROM t WINDOW w AS (PARTITION BY point_id ORDER BY frame)) SELECT round(sqrt(avg((dx-dy)**2)),6) AS rmse, round(100*abs(max(abs(dx))-max(abs(dy)))/max(abs(dy)),6) AS peak_error_percent FROM s")
def a54(spark, d):
    """x measures y: both count from a point's first frame."""
    w = temporal.series(["point_id"], "frame")
    s = tracks(spark, d).select(temporal.from_start("x", w).alias("dx"), temporal.from_start("y", w).alias("dy"))
    peak = lambda c: F.max(F.abs(c))
    return s.agg(r(stats.rmse(F.col("dx") - F.col("dy")), "rmse"), r(F.coalesce(100 * F.try_divide(F.abs(peak("dx") - peak("dy")), peak("dy")), F.lit(0.0)), "peak_error_percent"))


@register("a56_fault_features", f"WITH {TRACKS}, c AS (SELECT point_id, event_type, CASE WHEN event_type<>'error' THEN x END AS x, y, first_value(x) OVER (PARTITION BY point_id ORDER BY frame) AS x0 FROM t) SELECT point_id, bool_or(x IS NULL) AS tracking_loss, bool_or(event_type='purchase') AND NOT bool_or(x IS NULL) AS occluded, round(min(y),6) AS blur, round(max(abs(x-x0)),6) AS flow, count(DISTINCT x) AS distinct_x FROM c GROUP BY 1")
def a56(spark, d):
    w = temporal.series(["point_id"], "frame")
    lost = F.col("x").isNull()
    c = tracks(spark, d).withColumn("x0", F.first("x").over(w)).withColumn("x", F.when(F.col("event_type") != "error", F.col("x")))
    return c.groupBy("point_id").agg(F.bool_or(lost).alias("tracking_loss"), (F.bool_or(F.col("event_type") == "purchase") & ~F.bool_or(lost)).alias("occluded"), r(F.min("y"), "blur"), r(F.max(F.abs(F.col("x") - F.col("x0"))), "flow"), F.count_distinct("x").alias("distinct_x"))


@register("a61_r4_failure_summary", f"WITH {MEASURES} SELECT CASE WHEN truth<=0 THEN 'Unassessable' WHEN rel>50 THEN 'Good Reject' ELSE 'Potential Over-Reject' END AS label, count(*) AS n, count(*) FILTER (rel>20) AS over_20, count(*) FILTER (rel>50) AS over_50 FROM m WHERE status='O' GROUP BY 1")
def a61(spark, d):
    label = rules.first_rule([(~(F.col("truth") > 0), "Unassessable"), (F.col("rel") > 50, "Good Reject")], "Potential Over-Reject")
    return measures(spark, d).filter("status = 'O'").groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("rel") > 20).alias("over_20"), F.count_if(F.col("rel") > 50).alias("over_50"))


@register("a62_dataset_info", "SELECT count(*) AS samples, count(DISTINCT source) AS sources, array_to_string(list_sort(list(DISTINCT lang)),';') AS langs, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents")
def a62(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("samples"), F.count_distinct("source").alias("sources"), F.array_join(F.array_sort(F.collect_set("lang")), ";").alias("langs"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@register("a65_j15_late_recoveries", f"{CLEAN}, h AS (SELECT point_id, ended, min(frame) FILTER (frame>ended AND event_type='view') AS back FROM e WHERE ended IS NOT NULL GROUP BY ALL) SELECT count(*) AS cases, count(*) FILTER (back IS NULL OR back-ended>2) AS failures FROM h")
def a65(spark, d):
    """Points that aren't back within two frames of their last fault."""
    kind = F.col("event_type")
    g = temporal.first_after_last(tracks(spark, d), ["point_id"], "frame", kind == "error", kind == "view").filter("last_event is not null")
    late = F.col("recovered_at").isNull() | (F.col("recovered_at") - F.col("last_event") > 2)
    return g.agg(F.count("*").alias("cases"), F.count_if(late).alias("failures"))


@register("a66_j7_prediction_accuracy", f"WITH {TRACKS} SELECT count(*) AS n, round(sqrt(avg((x-50)**2)),6) AS raw_rmse, round(sqrt(avg((y-50)**2)),6) AS candidate_rmse, round(sqrt(avg((x-50)**2))-sqrt(avg((y-50)**2)),6) AS improvement FROM t")
def a66(spark, d):
    """Two tables of the same rows are matched one to one first; a key that repeats on a side is an error."""
    from metrilith.operators.align import one_to_one

    t = tracks(spark, d)
    m = one_to_one(t.select("point_id", "frame", "x"), t.select("point_id", "frame", "y"), ["point_id", "frame"])
    a, b = stats.rmse(F.col("x") - 50), stats.rmse(F.col("y") - 50)
    return m.agg(F.count("*").alias("n"), r(a, "raw_rmse"), r(b, "candidate_rmse"), r(a - b, "improvement"))


@register("a67_w14_jump_counts", f"WITH {TRACKS}, s AS (SELECT point_id, abs(x-lag(x) OVER (PARTITION BY point_id ORDER BY frame)) AS step FROM t) SELECT point_id, count(step) AS steps, count(*) FILTER (step>10) AS jumps, round(max(step),6) AS largest FROM s GROUP BY 1")
def a67(spark, d):
    s = tracks(spark, d).withColumn("step", F.abs(F.col("x") - F.lag("x").over(temporal.series(["point_id"], "frame"))))
    return s.groupBy("point_id").agg(F.count("step").alias("steps"), F.count_if(F.col("step") > 10).alias("jumps"), r(F.max("step"), "largest"))
