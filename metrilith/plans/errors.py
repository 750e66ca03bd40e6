"""Error summaries, calibration, sweeps and classification reports over measurements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from metrilith.functions import rules
from metrilith.operators import stats
from metrilith.plans.registry import register
from metrilith.plans.views import MEASURES, measures, rounded, table

def valid():
    return F.col("status") == "F"


def r(c, name, n=4):
    return rounded(c, n).alias(name)


def quantiles(df, by, value, at, digits):
    q = stats.quantiles(df, by, value, at)
    return q.select(*by, *(r(F.col(c), c, digits) for c in at))


@register("a1_mae_rmse", f"WITH {MEASURES} SELECT method, status, round(avg(abs(err)),4) AS mae, round(sqrt(avg(err*err)),4) AS rmse, round(avg(err),4) AS bias FROM m GROUP BY ALL")
def a1(spark, d):
    e = F.col("err")
    return measures(spark, d).groupBy("method", "status").agg(r(stats.mae(e), "mae"), r(stats.rmse(e), "rmse"), r(F.avg(e), "bias"))


@register("a2_coverage", "SELECT l_returnflag AS method, count(*) AS n, count(*) FILTER (l_linestatus='F') AS n_valid, round(100.0*count(*) FILTER (l_linestatus='F')/count(*),6) AS coverage FROM lineitem GROUP BY 1")
def a2(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("status"))
    return m.groupBy("method").agg(F.count("*").alias("n"), F.count_if(valid()).alias("n_valid"), r(stats.share(valid()), "coverage", 6))


@register("a3_status_histogram", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS points, round(avg(value),6) AS mean_value FROM events GROUP BY 1")
def a3(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("points"), r(F.avg("value"), "mean_value", 6))


@register("a5_runtime_per_frame", "WITH f AS (SELECT l_returnflag AS method, l_orderkey, arg_max(l_extendedprice, (l_linenumber, l_extendedprice)) AS ms FROM lineitem GROUP BY 1,2) SELECT method, round(avg(ms),4) AS mean_ms, round(quantile_cont(ms,0.5),4) AS median_ms, round(quantile_cont(ms,0.95),4) AS p95_ms FROM f GROUP BY 1")
def a5(spark, d):
    f = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("method"), "l_orderkey").agg(F.max_by("l_extendedprice", F.struct("l_linenumber", "l_extendedprice")).alias("ms"))
    q = quantiles(f, ["method"], "ms", {"median_ms": 0.5, "p95_ms": 0.95}, 4)
    return f.groupBy("method").agg(r(F.avg("ms"), "mean_ms")).join(q, "method", "left")


@register("a6_false_match_and_tracking", f"WITH {MEASURES} SELECT method, round(100.0*count(*) FILTER (rel>50 AND status='F')/count(*) FILTER (status='F'),6) AS false_match, round(100.0*count(*) FILTER (rel<=20 AND status='F')/count(*),6) AS accurate FROM m GROUP BY 1")
def a6(spark, d):
    wrong, fine = F.col("rel") > 50, (F.col("rel") <= 20) & valid()
    return measures(spark, d).groupBy("method").agg(r(stats.share(wrong, valid()), "false_match", 6), r(stats.share(fine), "accurate", 6))


@register("a7_vector_rmse", "WITH e AS (SELECT label, embedding[1] AS x, embedding[2] AS y, embedding[3] AS z FROM embeddings) SELECT label, round(avg(abs(x)),8) AS mae_x, round(avg(abs(y)),8) AS mae_y, round(avg(abs(z)),8) AS mae_z, round(sqrt(avg(x*x+y*y+z*z)),6) AS rmse_3d FROM (SELECT label, x::DOUBLE x, y::DOUBLE y, z::DOUBLE z FROM e) GROUP BY 1")
def a7(spark, d):
    e = table(spark, d, "embeddings").select("label", *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")))
    return e.groupBy("label").agg(*(r(F.avg(F.abs(c)), f"mae_{c}", 8) for c in "xyz"), r(F.sqrt(F.avg(sum((F.col(c) ** 2 for c in "xyz"), F.lit(0.0)))), "rmse_3d", 6))


@register("a9_recovery_counts", "WITH p AS (SELECT l_returnflag AS method, l_orderkey, max(l_linenumber) AS top FROM lineitem GROUP BY 1,2) SELECT method, sum(top)::BIGINT AS recoveries, count(*) AS points FROM p GROUP BY 1")
def a9(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("method"), "l_orderkey").agg(F.max("l_linenumber").alias("top"))
    return p.groupBy("method").agg(F.sum("top").cast("bigint").alias("recoveries"), F.count("*").alias("points"))


@register("a10_weighted_mean", "SELECT l_returnflag AS method, round(sum(l_extendedprice*l_quantity)/sum(l_quantity),4) AS weighted_mean FROM lineitem GROUP BY 1")
def a10(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(r(F.try_divide(F.sum(F.col("l_extendedprice") * q), F.sum(q)), "weighted_mean"))


@register("a12_a13_group_spread", "WITH s AS (SELECT user_id, stddev_pop(value) AS sd FROM events GROUP BY 1 HAVING count(*)>=2) SELECT count(*) AS groups, round(avg(sd),6) AS mean_sd, round(quantile_cont(sd,0.5),6) AS median_sd, round(quantile_cont(sd,0.95),6) AS p95_sd FROM s")
def a12(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(F.stddev_pop("value").alias("sd"), F.count("*").alias("n")).filter("n >= 2")
    q = quantiles(s, [], "sd", {"median_sd": 0.5, "p95_sd": 0.95}, 6)
    return s.agg(F.count("*").alias("groups"), r(F.avg("sd"), "mean_sd", 6)).crossJoin(q)  # one row each


@register("a14_amplitude_ratio", f"WITH {MEASURES}, a AS (SELECT method, part, (max(pred)-min(pred))/(max(truth)-min(truth)) AS ratio FROM m GROUP BY ALL HAVING count(*)>=3 AND max(truth)-min(truth)>2e-12) SELECT method, round(avg(ratio),6) AS ratio FROM a GROUP BY 1")
def a14(spark, d):
    spread = lambda c: F.max(c) - F.min(c)
    a = measures(spark, d).groupBy("method", "part").agg(F.count("*").alias("n"), spread("pred").alias("p"), spread("truth").alias("t")).filter("n >= 3 and t > 2e-12")
    return a.groupBy("method").agg(r(F.avg(F.try_divide("p", "t")), "ratio", 6))


@register(
    "a17_error_summary",
    f"WITH {MEASURES} SELECT method, count(*) AS n, count(*) FILTER (status='F') AS n_valid, round(avg(abs(err)) FILTER (status='F'),4) AS mae, round(sqrt(avg(err*err) FILTER (status='F')),4) AS rmse, round(quantile_cont(rel,0.9) FILTER (status='F'),6) AS p90, round(100.0*count(*) FILTER (status='F' AND rel>20)/count(*) FILTER (status='F'),6) AS bad_20, round(100.0*count(*) FILTER (status='F' AND rel>50)/count(*) FILTER (status='F'),6) AS bad_50 FROM m GROUP BY 1",
)
def a17(spark, d):
    e = F.when(valid(), F.col("err"))
    bad = lambda k: r(stats.share(F.col("rel") > k, valid()), f"bad_{k}", 6)
    m = measures(spark, d)
    q = quantiles(m.filter(valid()), ["method"], "rel", {"p90": 0.9}, 6)
    return m.groupBy("method").agg(F.count("*").alias("n"), F.count_if(valid()).alias("n_valid"), r(stats.mae(e), "mae"), r(stats.rmse(e), "rmse"), bad(20), bad(50)).join(q, "method", "left")


@register("a19_depth_percentiles", f"WITH {MEASURES} SELECT status, round(quantile_cont(abs(err),0.5),4) AS p50, round(quantile_cont(abs(err),0.9),4) AS p90, round(quantile_cont(abs(err),0.95),4) AS p95, round(max(abs(err)),4) AS worst, round(avg(rel),6) AS relative FROM m GROUP BY 1")
def a19(spark, d):
    m = measures(spark, d).select("status", "rel", F.abs("err").alias("e"))
    q = quantiles(m, ["status"], "e", {f"p{k}": k / 100 for k in (50, 90, 95)}, 4)
    return m.groupBy("status").agg(r(F.max("e"), "worst"), r(F.avg("rel"), "relative", 6)).join(q, "status", "left")


SWEEP = f"WITH {MEASURES}, g AS (SELECT a.v AS min_margin, b.v AS min_confidence FROM (VALUES (0.0),(0.02),(0.04),(0.06)) a(v), (VALUES (0.0),(0.25),(0.55),(0.75)) b(v)), s AS (SELECT min_margin, min_confidence, count(*) FILTER (ok) AS kept, round(100.0*count(*) FILTER (ok)/count(*),6) AS coverage, round(100.0*count(*) FILTER (ok AND rel>50)/count(*) FILTER (ok),6) AS cer, round(sqrt(avg(err*err) FILTER (ok)),4) AS rmse FROM (SELECT *, margin>=min_margin-1e-9 AND confidence>=min_confidence-1e-9 AS ok FROM m, g) GROUP BY ALL)"


def gate_sweep(spark, d):
    grid = spark.createDataFrame([(a, b) for a in (0.0, 0.02, 0.04, 0.06) for b in (0.0, 0.25, 0.55, 0.75)], "min_margin double, min_confidence double")
    ok = (F.col("margin") >= F.col("min_margin") - 1e-9) & (F.col("confidence") >= F.col("min_confidence") - 1e-9)
    return stats.sweep(measures(spark, d), grid, ["min_margin", "min_confidence"], F.count_if(ok).alias("kept"), r(stats.share(ok), "coverage", 6), r(stats.share(F.col("rel") > 50, ok), "cer", 6), r(stats.rmse(F.when(ok, F.col("err"))), "rmse"))


@register("a21_a22_gate_sweep", f"{SWEEP} SELECT min_margin::DOUBLE AS min_margin, min_confidence::DOUBLE AS min_confidence, kept, coverage, cer, rmse FROM s")
def a22(spark, d):
    return gate_sweep(spark, d)


@register("a23_operating_point", f"{SWEEP} SELECT min_margin::DOUBLE AS min_margin, min_confidence::DOUBLE AS min_confidence, coverage, cer FROM s WHERE kept>0 ORDER BY cer, coverage DESC, min_margin, min_confidence LIMIT 1")
def a23(spark, d):
    return gate_sweep(spark, d).filter("kept > 0").orderBy("cer", F.desc("coverage"), "min_margin", "min_confidence").limit(1).select("min_margin", "min_confidence", "coverage", "cer")


@register("a24_threshold_curve", f"WITH {MEASURES}, g AS (SELECT i/20.0 AS level FROM range(21) r(i)) SELECT round(level,2)::DOUBLE AS level, count(*) FILTER (confidence>=level-1e-9) AS kept, round(avg(abs(err)) FILTER (confidence>=level-1e-9),4) AS mae FROM m, g GROUP BY level")
def a24(spark, d):
    ok = F.col("confidence") >= F.col("level") - 1e-9
    grid = spark.createDataFrame([(k / 20,) for k in range(21)], "level double")
    return stats.sweep(measures(spark, d), grid, ["level"], F.count_if(ok).alias("kept"), r(F.avg(F.when(ok, F.abs("err"))), "mae"))


BIN = "CASE WHEN rel>=0 AND rel<20 THEN 0 WHEN rel>=20 AND rel<40 THEN 1 WHEN rel>=40 AND rel<80 THEN 2 WHEN rel>=80 THEN 3 END"


@register("a25_half_open_bins", f"WITH {MEASURES} SELECT {BIN} AS bin, count(*) AS n, round(avg(abs(err)),4) AS mae FROM m GROUP BY 1")
def a25(spark, d):
    m = measures(spark, d).withColumn("bin", rules.bins(F.col("rel"), [0, 20, 40, 80, float("inf")]))
    return m.groupBy("bin").agg(F.count("*").alias("n"), r(stats.mae(F.col("err")), "mae"))


@register("a26_strata_with_empty_bins", f"WITH {MEASURES}, b AS (SELECT i AS bin, f AS method FROM range(6) r(i), (VALUES ('A'),('N'),('R')) v(f)), c AS (SELECT {BIN} AS bin, method, count(*) AS n FROM m GROUP BY ALL) SELECT b.bin::INTEGER AS bin, b.method, coalesce(n,0)::BIGINT AS n FROM b LEFT JOIN c ON b.bin=c.bin AND b.method=c.method")
def a26(spark, d):
    dim = spark.createDataFrame([(k, f) for k in range(6) for f in "ANR"], "bin int, method string")
    counts = measures(spark, d).groupBy(rules.bins(F.col("rel"), [0, 20, 40, 80, float("inf")]).alias("bin"), "method").agg(F.count("*").alias("n"))
    return dim.join(counts, ["bin", "method"], "left").select("bin", "method", F.coalesce("n", F.lit(0)).alias("n"))


@register("a28_failure_distribution", "SELECT lang, CASE WHEN n_chars>4000 THEN NULL ELSE source END AS reason, count(*) AS n FROM documents GROUP BY ALL")
def a28(spark, d):
    return table(spark, d, "documents").groupBy("lang", F.when(F.col("n_chars") > 4000, None).otherwise(F.col("source")).alias("reason")).agg(F.count("*").alias("n"))


@register("a30_scenario_summary", "SELECT event_type, count(*) AS n, round(sum(value),4) AS total, round(avg(value),6) AS mean, round(quantile_cont(value,0.5),6) AS median, round(max(value),6) AS top, count(DISTINCT user_id) AS points FROM events GROUP BY 1")
def a30(spark, d):
    v = "value"
    e = table(spark, d, "events")
    q = quantiles(e, ["event_type"], v, {"median": 0.5}, 6)
    return e.groupBy("event_type").agg(F.count("*").alias("n"), r(F.sum(v), "total"), r(F.avg(v), "mean", 6), r(F.max(v), "top", 6), F.count_distinct("user_id").alias("points")).join(q, "event_type", "left")


@register("a32_shadow_summary", f"WITH {MEASURES} SELECT method, count(*) AS n, round(100.0*count(*) FILTER (status='F')/count(*),6) AS coverage, round(100.0*count(*) FILTER (rel<=10)/count(*),6) AS cer_10 FROM m GROUP BY 1")
def a32(spark, d):
    """cer_10 is the share within ten, as its source names it."""
    return measures(spark, d).groupBy("method").agg(F.count("*").alias("n"), r(stats.share(valid()), "coverage", 6), r(stats.share(F.col("rel") <= 10), "cer_10", 6))


@register("a34_dataset_audit", "SELECT lang, count(*) AS n, CASE WHEN bool_and(n_chars>500) THEN 'Yes' WHEN bool_or(n_chars>500) THEN 'Partial' ELSE 'No' END AS long_texts, array_to_string(list_sort(list(DISTINCT source)),';') AS sources FROM documents GROUP BY 1")
def a34(spark, d):
    long = F.col("n_chars") > 500
    kind = F.when(F.bool_and(long), "Yes").when(F.bool_or(long), "Partial").otherwise("No")
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), kind.alias("long_texts"), F.array_join(F.array_sort(F.collect_set("source")), ";").alias("sources"))


CAL = f"WITH {MEASURES}, c AS (SELECT method, status, abs(err) AS e, 5000+truth*0.4 AS s FROM m)"


@register("a36_uncertainty_calibration", f"{CAL} SELECT method, count(*) AS n, round(sqrt(avg(e*e)),4) AS rmse, round(avg(s),4) AS mean_sigma, round(100.0*count(*) FILTER (e<=s)/count(*),6) AS within_1, round(100.0*count(*) FILTER (e<=2*s)/count(*),6) AS within_2, round(100.0*count(*) FILTER (e<=3*s)/count(*),6) AS within_3, round(sqrt(avg(e*e)/avg(s*s)),6) AS ratio, round(corr(e,s),6) AS pearson FROM c GROUP BY 1")
def a36(spark, d):
    c = measures(spark, d).select("method", F.abs("err").alias("e"), (5000 + F.col("truth") * 0.4).alias("s")).filter("s > 0")
    e, s = F.col("e"), F.col("s")
    return c.groupBy("method").agg(F.count("*").alias("n"), r(stats.rmse(e), "rmse"), r(F.avg(s), "mean_sigma"), *(r(stats.share(e <= k * s), f"within_{k}", 6) for k in (1, 2, 3)), r(F.sqrt(F.try_divide(F.avg(e * e), F.avg(s * s))), "ratio", 6), r(stats.pearson(e, s), "pearson", 6))


@register("a36_w18_spearman", f"{CAL}, k AS (SELECT method, rank() OVER (PARTITION BY method ORDER BY e) + (count(*) OVER (PARTITION BY method, e) - 1)/2.0 AS re, rank() OVER (PARTITION BY method ORDER BY s) + (count(*) OVER (PARTITION BY method, s) - 1)/2.0 AS rs FROM c) SELECT method, round(corr(re, rs),6) AS spearman FROM k GROUP BY 1")
def a36s(spark, d):
    c = measures(spark, d).select("method", F.abs("err").alias("e"), (5000 + F.col("truth") * 0.4).alias("s"))
    k = stats.with_ranks(c, ["method"], ["e", "s"])
    return k.groupBy("method").agg(r(stats.pearson(F.col("rank_e"), F.col("rank_s")), "spearman", 6))


@register("a37_scale_fit", f"{CAL} SELECT status, round(sqrt(avg(e*e)/avg(s*s)),6) AS scale FROM c GROUP BY 1")
def a37(spark, d):
    c = measures(spark, d).select("status", F.abs("err").alias("e"), (5000 + F.col("truth") * 0.4).alias("s"))
    return c.groupBy("status").agg(r(F.sqrt(F.try_divide(F.avg(F.col("e") ** 2), F.avg(F.col("s") ** 2))), "scale", 6))


@register("a38_a39_sequence_metrics", f"WITH {MEASURES}, q AS (SELECT method, source, avg(err) AS bias, sqrt(avg(err*err)) AS rmse, stddev_pop(err) AS sd FROM m GROUP BY ALL) SELECT method, count(*) AS sequences, round(avg(bias),4) AS mean_bias, round(stddev_pop(bias),4) AS sd_bias, round(avg(rmse),4) AS mean_rmse, round(stddev_pop(rmse),4) AS sd_rmse, round(avg(sd),4) AS mean_sd FROM q GROUP BY 1")
def a38(spark, d):
    e = F.col("err")
    q = measures(spark, d).groupBy("method", "source").agg(F.avg(e).alias("bias"), stats.rmse(e).alias("rmse"), F.stddev_pop(e).alias("sd"))
    return q.groupBy("method").agg(F.count("*").alias("sequences"), r(F.avg("bias"), "mean_bias"), r(F.stddev_pop("bias"), "sd_bias"), r(F.avg("rmse"), "mean_rmse"), r(F.stddev_pop("rmse"), "sd_rmse"), r(F.avg("sd"), "mean_sd"))


@register("a40_merge_json_histograms", "SELECT event_type, sum(CAST(json_extract(props,'$.k') AS BIGINT))::BIGINT AS total, max(CAST(json_extract(props,'$.k') AS BIGINT)) AS top FROM events GROUP BY 1")
def a40(spark, d):
    e = table(spark, d, "events").select("event_type", F.explode(F.from_json("props", "map<string,bigint>")).alias("k", "v")).filter("k = 'k'")
    return e.groupBy("event_type").agg(F.sum("v").alias("total"), F.max("v").alias("top"))


@register("a41_target_attainment", f"WITH {MEASURES} SELECT part % 10 AS target_group, round(100.0*count(*) FILTER (abs(err) <= 3000*(1+part%10))/count(*),6) AS attained FROM m GROUP BY 1")
def a41(spark, d):
    g = F.col("part") % 10
    return measures(spark, d).groupBy(g.alias("target_group")).agg(r(stats.share(F.abs("err") <= 3000 * (1 + F.col("part") % 10)), "attained", 6))


@register("a44_classification_metrics", "WITH c AS (SELECT count(*) FILTER (quality=1 AND toxic=1) tp, count(*) FILTER (quality=0 AND toxic=1) fp, count(*) FILTER (quality=1 AND toxic=0) fn, count(*) FILTER (quality=0 AND toxic=0) tn FROM labels) SELECT round((tp+tn)/(tp+tn+fp+fn)::DOUBLE,6) AS accuracy, round(tp/(tp+fp)::DOUBLE,6) AS precision_1, round(tp/(tp+fn)::DOUBLE,6) AS recall_1, round(2.0*tp/(2*tp+fp+fn),6) AS f1, round(fn/(tp+fn)::DOUBLE,6) AS fnr FROM c")
def a44(spark, d):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    c = table(spark, d, "labels").agg(F.count_if(q & t).alias("tp"), F.count_if(~q & t).alias("fp"), F.count_if(q & ~t).alias("fn"), F.count_if(~q & ~t).alias("tn"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(r(div(tp + tn, tp + tn + fp + fn), "accuracy", 6), r(div(tp, tp + fp), "precision_1", 6), r(div(tp, tp + fn), "recall_1", 6), r(div(2 * tp, 2 * tp + fp + fn), "f1", 6), r(div(fn, tp + fn), "fnr", 6))


@register("a45_confusion_matrix", "SELECT v.q AS quality, count(*) FILTER (toxic=0)::BIGINT AS n_0, count(*) FILTER (toxic=1)::BIGINT AS n_1, count(*) FILTER (toxic=2)::BIGINT AS n_2 FROM (VALUES (0),(1),(2)) v(q) LEFT JOIN labels ON quality=v.q GROUP BY 1")
def a45(spark, d):
    return stats.confusion(table(spark, d, "labels").select(F.col("quality").cast("int").alias("quality"), "toxic"), "quality", "toxic", [0, 1, 2]).withColumn("quality", F.col("quality").cast("int"))


@register("a46_rates_by_severity", "SELECT source, round(100.0*count(*) FILTER (quality=0 AND toxic=1)/nullif(count(*) FILTER (quality=0),0),6) AS fpr, round(100.0*count(*) FILTER (quality=1 AND toxic=0)/nullif(count(*) FILTER (quality=1),0),6) AS fnr FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def a46(spark, d):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return j.groupBy("source").agg(r(stats.share(t, ~q), "fpr", 6), r(stats.share(~t, q), "fnr", 6))


@register("a49_gates", f"WITH {MEASURES} SELECT 'coverage' AS gate, count(*) FILTER (status='F')*2 >= count(*)*0.9 AS passed FROM m UNION ALL SELECT 'bias', abs(avg(err)) < 0.1*avg(abs(err)) FROM m UNION ALL SELECT 'worst', max(rel) < 1 FROM m")
def a49(spark, d):
    m = measures(spark, d).agg((F.count_if(valid()) * 2 >= F.count("*") * 0.9).alias("coverage"), (F.abs(F.avg("err")) < 0.1 * F.avg(F.abs("err"))).alias("bias"), (F.max("rel") < 1).alias("worst"))
    return m.unpivot([], ["coverage", "bias", "worst"], "gate", "passed")


@register("a57_weighted_median", "WITH c AS (SELECT l_returnflag AS method, l_extendedprice AS v, l_quantity AS w, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS c, sum(l_quantity) OVER (PARTITION BY l_returnflag) AS t FROM lineitem) SELECT method, round(min(v),4) AS weighted_median FROM c WHERE c >= t/2 GROUP BY 1")
def a57(spark, d):
    """The smallest value at which half the weight is reached: weights are summed by value, then run over the values of a group."""
    v = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("method"), F.col("l_extendedprice").alias("v")).agg(F.sum("l_quantity").alias("w"))
    return stats.running(v, ["method"], "v", "w").filter("upto >= total / 2").groupBy("method").agg(r(F.min("v"), "weighted_median"))


@register("a58_median_and_mad", "WITH k AS (SELECT l_returnflag AS method, quantile_cont(l_extendedprice,0.5) AS med FROM lineitem GROUP BY 1) SELECT l_returnflag AS method, round(any_value(med),4) AS median, round(quantile_cont(abs(l_extendedprice-med),0.5),4) AS mad FROM lineitem JOIN k ON l_returnflag=method GROUP BY 1")
def a58(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_extendedprice").alias("v"))
    k = stats.quantiles(m, ["method"], "v", {"med": 0.5})
    # a row for each method: joined by method, all rows of one would meet in one task
    away = m.join(F.broadcast(k), "method").select("method", F.abs(F.col("v") - F.col("med")).alias("away"))
    return k.select("method", r(F.col("med"), "median")).join(quantiles(away, ["method"], "away", {"mad": 0.5}, 4), "method")


@register("a59_best_and_second", "WITH b AS (SELECT l_orderkey, arg_min(l_linenumber, (l_extendedprice, l_linenumber)) AS best, min(l_extendedprice) AS cost FROM lineitem GROUP BY 1) SELECT l.l_orderkey, any_value(best) AS best, round(any_value(cost),4) AS cost, round(min(l_extendedprice) FILTER (abs(l_linenumber-best)>1),4) AS second FROM lineitem l JOIN b ON l.l_orderkey=b.l_orderkey GROUP BY 1")
def a59(spark, d):
    """Best cost of each curve, and the best more than one step away from it."""
    m = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    w = Window.partitionBy("l_orderkey")
    b = m.withColumn("best", F.min_by("l_linenumber", F.struct("l_extendedprice", "l_linenumber")).over(w))
    away = F.abs(F.col("l_linenumber") - F.col("best")) > 1
    return b.groupBy("l_orderkey").agg(F.first("best").alias("best"), r(F.min("l_extendedprice"), "cost"), r(F.min(F.when(away, F.col("l_extendedprice"))), "second"))


@register("a63_pair_overlaps", "WITH k AS (SELECT DISTINCT lower(trim(text)) AS t, source FROM documents) SELECT a.source AS source_a, b.source AS source_b, count(*) AS shared FROM k a JOIN k b ON a.t=b.t AND a.source<b.source GROUP BY ALL")
def a63(spark, d):
    """Texts that two sources share; a text's sources, at most as many as there are sources, are paired in place."""
    k = table(spark, d, "documents").groupBy(F.sha2(F.lower(F.trim("text")), 256).alias("t")).agg(F.array_sort(F.collect_set("source")).alias("s"))
    one = k.filter(F.size("s") > 1).select("s", F.posexplode("s").alias("i", "source_a"))
    pair = one.select("source_a", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("source_b"))
    return pair.groupBy("source_a", "source_b").agg(F.count("*").alias("shared"))


@register("a64_relations_equal", "SELECT 'status' AS relation, count(*)=0 AS equal FROM ((SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus='F' EXCEPT ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag<>'N') UNION ALL (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag<>'N' EXCEPT ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus='F'))")
def a64(spark, d):
    m = table(spark, d, "lineitem")
    a, b = m.filter("l_linestatus = 'F'").select("l_orderkey", "l_linenumber"), m.filter("l_returnflag <> 'N'").select("l_orderkey", "l_linenumber")
    return a.exceptAll(b).union(b.exceptAll(a)).agg((F.count("*") == 0).alias("equal")).select(F.lit("status").alias("relation"), "equal")
