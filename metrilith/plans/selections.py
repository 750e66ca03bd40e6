"""Further joins, windows, samples and plot data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metrilith.functions import decisions, rules
from metrilith.operators import align, constraints, motion, spectral, stats, temporal
from metrilith.operators.tables import Scratch
from metrilith.plans.registry import register
from metrilith.plans.views import MEASURES, TRACKS, measures, rounded, table, tracks
from metrilith.sources import readers

XYZ = ["x", "y", "z"]


def r(c, name, n=6):
    return rounded(c, n).alias(name)


LAGS = "l AS (SELECT *, lag(x,1) OVER w x1, lag(x,2) OVER w x2, lag(y,1) OVER w y1, lag(y,2) OVER w y2, lag(z,1) OVER w z1, lag(z,2) OVER w z2 FROM t WINDOW w AS (PARTITION BY point_id ORDER BY frame)), i AS (SELECT *, sqrt((x-2*x1+x2)**2+(y-2*y1+y2)**2+(z-2*z1+z2)**2) AS d FROM l)"


@register("j10_development_beside_holdout", f"WITH {MEASURES}, g AS (SELECT method, part%10 AS cell, status, count(*) AS n, avg(abs(err)) AS mae FROM m GROUP BY ALL) SELECT a.method, a.cell, a.n AS dev_n, b.n AS val_n, round(a.mae,4) AS dev_mae, round(b.mae,4) AS val_mae FROM g a JOIN g b ON a.method=b.method AND a.cell=b.cell WHERE a.status='F' AND b.status='O'")
def j10(spark, d):
    """Both sides come from one aggregation, set beside each other by key."""
    on = lambda s, c: F.when(F.col("status") == s, c)
    e = F.abs("err")
    g = measures(spark, d).groupBy("method", (F.col("part") % 10).alias("cell")).agg(F.count(on("F", F.lit(1))).alias("dev_n"), F.count(on("O", F.lit(1))).alias("val_n"), r(F.avg(on("F", e)), "dev_mae", 4), r(F.avg(on("O", e)), "val_mae", 4))
    return g.filter("dev_n > 0 and val_n > 0")


@register("j11_r6_positional_compare", "WITH a AS (SELECT l_orderkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS k FROM lineitem), b AS (SELECT l_orderkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) AS k FROM lineitem) SELECT count(*) AS rows_compared, count(*) FILTER (a.v=b.v) AS equal, round(avg(abs(a.v-b.v)),4) AS mean_difference FROM a JOIN b ON a.l_orderkey=b.l_orderkey AND a.k=b.k")
def j11(spark, d):
    """Row by row, by place within a sequence."""
    m = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("v"))
    w = Window.partitionBy("l_orderkey")
    a = m.select("l_orderkey", F.col("v").alias("a"), F.row_number().over(w.orderBy("l_linenumber", "v")).alias("k"))
    b = m.select("l_orderkey", F.col("v").alias("b"), F.row_number().over(w.orderBy("v", "l_linenumber")).alias("k"))
    j = a.join(b, ["l_orderkey", "k"])
    return j.agg(F.count("*").alias("rows_compared"), F.count_if(F.col("a") == F.col("b")).alias("equal"), r(F.avg(F.abs(F.col("a") - F.col("b"))), "mean_difference", 4))


@register("j17_path_states", "SELECT page_id, CASE WHEN url IS NULL OR trim(url)='' THEN 'MISSING' WHEN starts_with(url,'/') OR contains(url,'://') THEN 'ABSOLUTE' ELSE 'RELATIVE' END AS state, CASE WHEN starts_with(url,'/') OR contains(url,'://') THEN url ELSE '/base/'||url END AS path FROM pages")
def j17(spark, d):
    u = F.col("url")
    whole = u.startswith("/") | u.contains("://")
    return table(spark, d, "pages").select("page_id", rules.first_rule([(u.isNull() | (F.trim(u) == ""), "MISSING"), (whole, "ABSOLUTE")], "RELATIVE").alias("state"), F.when(whole, u).otherwise(F.concat(F.lit("/base/"), u)).alias("path"))


@register("j18_r10_calibration_identity", "SELECT s_suppkey, round(abs(s_acctbal/100-n_nationkey*4),6) AS deviation, abs(s_acctbal/100-n_nationkey*4)<=20 AS identical FROM supplier LEFT JOIN nation ON s_nationkey=n_nationkey")
def j18(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), (F.col("n_nationkey") * 4).alias("tx")), "s_nationkey", "left")
    off = F.abs(F.col("s_acctbal") / 100 - F.col("tx"))
    return s.select("s_suppkey", r(off, "deviation"), (off <= 20).alias("identical"))


@register(
    "j19_raster_lookup",
    """WITH n AS (SELECT max(vec_id)//24+1 AS maps FROM embeddings), m AS (SELECT vec_id//24 AS map, vec_id%24 AS y, i-1 AS x, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 257) r(i) WHERE i<=len(embedding)),
 p AS (SELECT event_id, event_id%(maps+1) AS map, event_id//7%30-2 AS y, round_even(value/3-1,0)::BIGINT AS x FROM events, n)
 SELECT event_id, round(v,6) AS truth FROM p LEFT JOIN m ON p.map=m.map AND p.y=m.y AND p.x=m.x AND v>0 AND isfinite(v)""",
)
def j19(spark, d):
    """Values of float maps, 24 vectors each, at rounded coordinates; none outside a map, without one, or where it isn't above zero."""

    @F.pandas_udf(T.BinaryType())
    def content(rows: pd.Series) -> pd.Series:
        return pd.Series([readers.encode_pfm(len(x), len(x[0]), np.stack(list(x))) for x in rows])

    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 24).alias("map"), F.struct("vec_id", "embedding").alias("row"))
    # 24 rows each
    maps = e.groupBy("map").agg(F.sort_array(F.collect_list("row")).alias("rows")).select(F.col("map").cast("string").alias("path"), content("rows.embedding").alias("content"))
    number = table(spark, d, "embeddings").agg(F.floor(F.max("vec_id") / 24).alias("maps"))
    events = table(spark, d, "events").select("event_id", (F.floor(F.col("event_id") / 7) % 30 - 2).alias("y"), (F.col("value") / 3 - 1).alias("x")).join(F.broadcast(number))  # one row
    points = events.select("event_id", "x", "y", (F.col("event_id") % (F.col("maps") + 2)).cast("string").alias("path"))
    return readers.map_values(points, readers.float_tiles(maps, 16), "x", "y", "truth", 16).select("event_id", r(F.col("truth"), "truth"))


@register("w3_innovation_shares", f"WITH {TRACKS}, {LAGS} SELECT point_id, count(d) AS n, round(100.0*count(*) FILTER (d>10)/nullif(count(d),0),6) AS over_10, round(100.0*count(*) FILTER (d>50)/nullif(count(d),0),6) AS over_50 FROM i GROUP BY 1")
def w3(spark, d):
    i = tracks(spark, d).withColumn("d", temporal.innovation(XYZ, temporal.series(["point_id"], "frame")))
    there = F.col("d").isNotNull()
    return i.groupBy("point_id").agg(F.count("d").alias("n"), *(r(stats.share(F.col("d") > k, there), f"over_{k}") for k in (10, 50)))


@register("w8_w13_r16_bounded_history", f"WITH {TRACKS} SELECT event_id, count(*) OVER w AS held, round(min(x) OVER w,6) AS least, round(avg(x) OVER w,6) AS mean FROM t WHERE event_type<>'error' WINDOW w AS (PARTITION BY point_id ORDER BY frame ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)")
def w13(spark, d):
    """The last sixteen rows of a point's valid series."""
    w = temporal.series(["point_id"], "frame").rowsBetween(-15, 0)
    return tracks(spark, d, gaps=True).select("event_id", F.count("*").over(w).alias("held"), r(F.min("x").over(w), "least"), r(F.avg("x").over(w), "mean"))


EVIDENCE = f"WITH {TRACKS}, {LAGS}, s AS (SELECT *, x-x1 AS step FROM i), m AS (SELECT frame, quantile_cont(step,0.5) AS med FROM s WHERE step IS NOT NULL GROUP BY 1), p AS (SELECT s.event_id, exp(-d/15) AS temporal, CASE WHEN step IS NOT NULL THEN exp(-abs(step-med)/15) END AS spatial FROM s LEFT JOIN m ON s.frame=m.frame), c AS (SELECT *, greatest(0,least(1,(coalesce(temporal*0.6,0)+coalesce(spatial*0.4,0))/nullif(CASE WHEN temporal IS NULL THEN 0 ELSE 0.6 END+CASE WHEN spatial IS NULL THEN 0 ELSE 0.4 END,0))) AS c FROM p)"


@register("st4_st6_w10_physics_confidence", f"{EVIDENCE} SELECT event_id, round(temporal,6) AS temporal, round(spatial,6) AS spatial, CASE WHEN temporal IS NOT NULL OR spatial IS NOT NULL THEN round(c,6) END AS c_phy, CASE WHEN (temporal IS NOT NULL OR spatial IS NOT NULL) AND c<0.55 THEN 'SUSPICIOUS' ELSE 'NORMAL' END AS state FROM c")
def st4(spark, d):
    """A point's own prediction and the frame's median motion as evidence, fused; windows hold all the state."""
    w = temporal.series(["point_id"], "frame")
    s = tracks(spark, d).withColumn("d", temporal.innovation(XYZ, w)).withColumn("step", F.col("x") - F.lag("x").over(w)).select("event_id", "frame", "d", "step")
    med = stats.quantiles(s, ["frame"], "step", {"med": 0.5})
    p = s.join(med, "frame", "left").select("event_id", rules.evidence(F.col("d")).alias("temporal"), rules.evidence(F.abs(F.col("step") - F.col("med"))).alias("spatial"))
    one = F.lit(1.0)
    p = p.withColumn("c", rules.fused([(F.col("temporal"), 0.6, one), (F.col("spatial"), 0.4, one)]))
    return p.select("event_id", r(F.col("temporal"), "temporal"), r(F.col("spatial"), "spatial"), r(F.col("c"), "c_phy"), rules.first_rule([(F.col("c") < 0.55, "SUSPICIOUS")], "NORMAL").alias("state"))


@register("st8_w24_gap_aware_prediction", f"WITH {TRACKS}, l AS (SELECT event_id, t, lag(x,1) OVER w x1, lag(x,2) OVER w x2, lag(t,1) OVER w t1, lag(t,2) OVER w t2 FROM t WINDOW w AS (PARTITION BY point_id ORDER BY frame)) SELECT event_id, round(CASE WHEN t-t1<=864000 AND t1-t2<=864000 AND t1>t2 THEN x1+(x1-x2)*(t-t1)/(t1-t2) ELSE x1 END,4) AS predicted FROM l")
def st8(spark, d):
    return tracks(spark, d).select("event_id", r(temporal.gap_prediction("x", "t", temporal.series(["point_id"], "frame"), 864000.0), "predicted", 4))


@register("w22_t6_evenly_spaced", "WITH k AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey)-1 AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_mktsegment, c_custkey FROM k WHERE n<=7 OR i IN (SELECT (j*(n-1))//6 FROM range(7) r(j))")
def w22(spark, d):
    """Seven rows of each segment at equal distances, the first and the last among them."""
    w = Window.partitionBy("c_mktsegment")
    k = table(spark, d, "customer").select("c_mktsegment", "c_custkey").withColumn("i", (F.row_number().over(w.orderBy("c_custkey")) - 1).cast("bigint")).withColumn("n", F.count("*").over(w))
    return k.filter(temporal.evenly(F.col("i"), F.col("n"), 7)).select("c_mktsegment", "c_custkey")


@register("w23_since_start", f"WITH {TRACKS} SELECT event_id, round(t-first_value(t) OVER (PARTITION BY point_id ORDER BY frame),3) AS since_start, count(*) FILTER (event_type='error') OVER (PARTITION BY point_id ORDER BY frame) AS recoveries FROM t")
def w23(spark, d):
    w = temporal.series(["point_id"], "frame")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return tracks(spark, d).select("event_id", r(temporal.from_start("t", w), "since_start", 3), F.count_if(F.col("event_type") == "error").over(upto).alias("recoveries"))


@register("t2_t10_all_errors", f"WITH {MEASURES} SELECT frame, point_id, part, round(abs(err),4) AS error FROM m WHERE status='F'")
def t2(spark, d):
    """All errors, largest first: a range-partitioned sort."""
    m = measures(spark, d).filter("status = 'F'").select("frame", "point_id", "part", r(F.abs("err"), "error", 4))
    return m.orderBy(F.desc("error"), "frame", "point_id")


@register("t4_first_cases", f"WITH {MEASURES}, k AS (SELECT method, frame, point_id, row_number() OVER (PARTITION BY method ORDER BY frame, point_id) AS k FROM m WHERE rel>50) SELECT method, frame, point_id FROM k WHERE k<=20")
def t4(spark, d):
    """The first twenty bad cases of each method; Spark keeps twenty for each partition before it shuffles."""
    w = Window.partitionBy("method").orderBy("frame", "point_id")
    return measures(spark, d).filter("rel > 50").select("method", "frame", "point_id").withColumn("k", F.row_number().over(w)).filter("k <= 20").drop("k")


@register("t5_r13_seeded_sample", "WITH s AS (SELECT doc_id, md5('2026:'||doc_id) AS h FROM documents ORDER BY h, doc_id LIMIT 100) SELECT doc_id FROM s")
def t5(spark, d):
    """A sample that a seed fixes: the smallest hashes of seed and id."""
    h = F.md5(F.concat(F.lit("2026:"), F.col("doc_id").cast("string")))
    return table(spark, d, "documents").select("doc_id", h.alias("h")).orderBy("h", "doc_id").limit(100).select("doc_id")


_DAMAGED = """CASE WHEN l_linenumber%7=0 THEN '' ELSE l_returnflag END AS point, CASE WHEN l_suppkey%11=0 THEN 'nan' WHEN l_suppkey%13=0 THEN '' ELSE l_quantity::VARCHAR END AS x,
 CASE WHEN l_tax=0.01 THEN '-1' WHEN l_tax=0.02 THEN '1.5' WHEN l_tax=0.03 THEN '' ELSE l_suppkey::VARCHAR END AS frame,
 CASE WHEN l_discount=0.01 THEN 'inf' WHEN l_discount=0.02 THEN '' ELSE (epoch(l_shipdate)//86400)::VARCHAR END AS t"""


@register(
    "r10_truth_data_quality",
    f"""WITH n AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)+1 AS line, l_partkey%40 AS file FROM lineitem),
 g AS (SELECT file, line, {_DAMAGED} FROM n WHERE file NOT IN (37, 39)), h AS (SELECT file, line, point, x, CASE WHEN file<>38 THEN frame END AS frame, CASE WHEN file<>38 THEN t END AS t FROM g),
 c AS (SELECT file, line, trim(point) AS point, try_cast(x AS DOUBLE) AS x, frame, try_cast(frame AS DOUBLE) AS f, t, try_cast(t AS DOUBLE) AS u FROM h),
 v AS (SELECT *, coalesce(isfinite(x), false) AS fx, CASE WHEN isfinite(f) AND f>=0 AND f=floor(f) THEN f END AS ff, CASE WHEN isfinite(u) THEN u END AS fu FROM c),
 o AS (SELECT *, row_number() OVER (PARTITION BY file, point, ff ORDER BY line) AS nf, row_number() OVER (PARTITION BY file, point, fu ORDER BY line) AS nt,
  last_value(fu IGNORE NULLS) OVER (PARTITION BY file, point ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v),
 i AS (SELECT file, 'GT_POINT_ID' AS code FROM o WHERE point='' UNION ALL SELECT file, 'GT_XYZ' FROM o WHERE NOT fx UNION ALL SELECT file, 'GT_FRAME' FROM o WHERE frame<>'' AND ff IS NULL
  UNION ALL SELECT file, 'GT_DUPLICATE_FRAME' FROM o WHERE ff IS NOT NULL AND nf>1 UNION ALL SELECT file, 'GT_TIMESTAMP' FROM o WHERE t<>'' AND fu IS NULL
  UNION ALL SELECT file, 'GT_DUPLICATE_TIMESTAMP' FROM o WHERE fu IS NOT NULL AND nt>1 UNION ALL SELECT file, 'GT_TIMESTAMP_ORDER' FROM o WHERE fu<=before
  UNION ALL SELECT 37, 'GT_FIELDS' UNION ALL SELECT 38, 'GT_ALIGNMENT_FIELD' UNION ALL SELECT 39, 'GT_EMPTY')
 SELECT file, code, count(*) AS n, 'FAIL' AS status FROM i GROUP BY 1, 2""",
)
def r10(spark, d):
    """Damaged truth tables, one for each part of a key, against the constraints on truth: issues of each code by file, and its status.

    One file lacks a coordinate, one its alignment's column, one has no rows.
    """
    n = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_quantity", "l_tax", "l_discount", "l_shipdate", (F.col("l_partkey") % 40).alias("file"))
    n = stats.numbered(n, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "line").filter("file <> 39").withColumn("line", F.col("line") + 1)
    x = F.when(F.col("l_suppkey") % 11 == 0, "nan").when(F.col("l_suppkey") % 13 == 0, "").otherwise(F.col("l_quantity").cast("string"))
    frame = F.when(F.col("l_tax") == 0.01, "-1").when(F.col("l_tax") == 0.02, "1.5").when(F.col("l_tax") == 0.03, "").otherwise(F.col("l_suppkey").cast("string"))
    t = F.when(F.col("l_discount") == 0.01, "inf").when(F.col("l_discount") == 0.02, "").otherwise(F.unix_date(F.col("l_shipdate").cast("date")).cast("string"))
    cells = {"point_id": F.when(F.col("l_linenumber") % 7 == 0, "").otherwise(F.col("l_returnflag")), "gt_x_mm": x, "gt_y_mm": x, "gt_z_mm": x, "frame": frame, "timestamp_s": t}
    pairs = lambda *less: F.create_map(*(v for k, c in cells.items() if k not in less for v in (F.lit(k), c)))
    rows = n.select("file", "line", F.when(F.col("file") == 37, pairs("gt_z_mm")).when(F.col("file") == 38, pairs("timestamp_s", "frame")).otherwise(pairs()).alias("cells"))
    files = spark.range(40).select(F.col("id").alias("file"), F.when(F.col("id") % 2 == 0, "timestamp").otherwise("frame").alias("alignment"))
    found = constraints.truth_issues(rows, files).groupBy("file", "severity", "code").agg(F.count("*").alias("n"))
    found = Scratch(spark, "issues").write(found, "counts")  # a status needs no more than the codes of its file
    return found.groupBy("file", "code").agg(F.sum("n").alias("n")).join(constraints.verdicts(found, files), "file").select("file", "code", "n", "status")


@register("r5_sensitivity_best_beside_base", f"WITH {MEASURES}, s AS (SELECT g.v AS level, count(*) FILTER (confidence>=g.v-1e-9) AS kept, avg(abs(err)) FILTER (confidence>=g.v-1e-9) AS mae FROM m, (VALUES (0.0),(0.25),(0.5),(0.75)) g(v) GROUP BY 1) SELECT level::DOUBLE AS level, kept, round(mae,4) AS mae, round(mae-(SELECT mae FROM s WHERE level=0),4) AS over_base FROM s")
def r5(spark, d):
    grid = spark.createDataFrame([(k / 4,) for k in range(4)], "level double")
    ok = F.col("confidence") >= F.col("level") - 1e-9
    s = stats.sweep(measures(spark, d), grid, ["level"], F.count_if(ok).alias("kept"), F.avg(F.when(ok, F.abs("err"))).alias("mae"))
    base = F.max(F.when(F.col("level") == 0, F.col("mae"))).over(Window.partitionBy())  # four rows
    return s.select("level", "kept", r(F.col("mae"), "mae", 4), r(F.col("mae") - base, "over_base", 4))


@register("r16_complete_series", f"WITH {TRACKS}, c AS (SELECT *, bool_and(event_type<>'error') OVER (PARTITION BY point_id) AS whole FROM t) SELECT event_id, round(x-first_value(x) OVER (PARTITION BY point_id ORDER BY frame),6) AS raw, round(y-first_value(y) OVER (PARTITION BY point_id ORDER BY frame),6) AS filtered, whole FROM c")
def r16(spark, d):
    """Displacements for a plot; `whole` marks series without a gap, the only ones that are drawn."""
    w = temporal.series(["point_id"], "frame")
    whole = F.bool_and(F.col("event_type") != "error").over(Window.partitionBy("point_id"))
    return tracks(spark, d).select("event_id", r(temporal.from_start("x", w), "raw"), r(temporal.from_start("y", w), "filtered"), whole.alias("whole"))


@register("r17_metric_bars", f"WITH {MEASURES}, a AS (SELECT method, round(avg(abs(err)),4) AS mae, round(sqrt(avg(err*err)),4) AS rmse, round(avg(confidence) FILTER (qty>60),4) AS high FROM m GROUP BY 1) SELECT method, metric, value FROM (UNPIVOT a ON mae, rmse, high INTO NAME metric VALUE value) WHERE value IS NOT NULL")
def r17(spark, d):
    """One bar for each method and metric; a missing value has none."""
    a = measures(spark, d).groupBy("method").agg(r(stats.mae(F.col("err")), "mae", 4), r(stats.rmse(F.col("err")), "rmse", 4), r(F.avg(F.when(F.col("qty") > 60, F.col("confidence"))), "high", 4))
    return a.unpivot(["method"], ["mae", "rmse", "high"], "metric", "value").filter("value is not null")


@register("r18_truth_pairs", "WITH g AS (SELECT o_orderkey AS frame, o_totalprice AS z FROM orders WHERE o_orderstatus='F') SELECT l_orderkey, l_linenumber, round(l_extendedprice,4) AS measured, round(z,4) AS truth, round(abs(l_extendedprice-z),4) AS error FROM lineitem JOIN g ON l_orderkey=frame")
def r18(spark, d):
    """Pairs for a plot: only truth of the same frame, never a point's truth for all frames."""
    g = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("z"))
    j = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").join(g, "l_orderkey")
    return j.select("l_orderkey", "l_linenumber", r(F.col("l_extendedprice"), "measured", 4), r(F.col("z"), "truth", 4), r(F.abs(F.col("l_extendedprice") - F.col("z")), "error", 4))


@register(
    "w12_k2_k3_spectral_window",
    f"""WITH {TRACKS},
 w AS (SELECT point_id, frame, row_number() OVER s AS i, list(x) OVER (s ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS v FROM t WINDOW s AS (PARTITION BY point_id ORDER BY frame)),
 a AS (SELECT *, len(v) AS n, list_avg(v) AS m FROM w WHERE i >= 16),
 b AS (SELECT *, list_sum(list_transform(range(n), lambda l: (l-(n-1)/2)*v[l+1])) / (n*(n*n-1)/12.0) AS slope FROM a),
 h AS (SELECT point_id, frame, i, n, list_transform(range(n), lambda l: (v[l+1]-m-slope*(l-(n-1)/2))*(0.5-0.5*cos(2*pi()*l/n))) AS h FROM b),
 k AS (SELECT *, unnest(range(n//2+1)) AS k FROM h),
 p AS (SELECT point_id, frame, i, n, k, (list_sum(list_transform(range(n), lambda l: h[l+1]*cos(2*pi()*k*l/n)))**2 + list_sum(list_transform(range(n), lambda l: h[l+1]*sin(2*pi()*k*l/n)))**2)
  / (30.0*3*n/8) * CASE WHEN k=0 OR 2*k=n THEN 1 ELSE 2 END AS p FROM k),
 d AS (SELECT point_id, frame, arg_max(k, (p, -k)) FILTER (k>0) AS top, max(p) FILTER (k>0) AS best FROM p GROUP BY 1, 2),
 e AS (SELECT p.point_id, p.frame, any_value(p.i) AS i, any_value(p.n) AS n, any_value(top) AS top, any_value(best) AS best,
  coalesce(sum((p.p+q.p)/2*30.0/p.n) FILTER (abs(p.k-top)*30.0/p.n<=0.5 AND abs(q.k-top)*30.0/p.n<=0.5), 0) AS energy
  FROM p JOIN d USING (point_id, frame) LEFT JOIN p q ON q.point_id=p.point_id AND q.frame=p.frame AND q.k=p.k+1 GROUP BY 1, 2),
 f AS (SELECT *, top*30.0/n AS frequency FROM e), c AS (SELECT frame, median(frequency) AS consensus FROM f GROUP BY 1)
 SELECT f.point_id, f.frame, round(frequency,6) AS frequency, round(sqrt(best),4) AS amplitude, round(energy,3) AS energy, round(consensus,6) AS consensus,
 round(exp(-abs(frequency-consensus)/greatest(30.0/i,0.1)),6) AS agreement FROM f JOIN c ON f.frame=c.frame""",
)
def w12(spark, d):
    """Dominant frequency of each point's last 64 samples, from 16 on, and how well it agrees with its frame's median."""
    found = spectral.consensus(spectral.dominant(tracks(spark, d), ["point_id"], "frame", "x", 30.0), "frame", 30.0)
    return found.select("point_id", "frame", r(F.col("frequency"), "frequency"), r(F.col("amplitude"), "amplitude", 4), r(F.col("energy"), "energy", 3), r(F.col("consensus"), "consensus"), r(F.col("agreement"), "agreement"))


@register("k1_st9_reference_motion")
def k1(spark, d):
    """Each frame's weighted rigid motion against the first place of its reference points, and the points moved back by it."""
    t = tracks(spark, d)
    w = temporal.series(["point_id"], "frame")
    ref = t.select("frame", "point_id", *(F.col(c).alias(f"p{c}") for c in XYZ), *(F.first(c).over(w).alias(f"q{c}") for c in XYZ))
    fit = motion.frame_motion(ref.join(t.select("frame", "point_id", (1.0 + F.col("event_id") % 3).alias("w")), ["frame", "point_id"]))
    q = [[F.col("rotation")[3 * i + j] for j in range(3)] for i in range(3)]
    back = decisions.moved(q, [F.col("shift")[i] for i in range(3)], [F.col(c) for c in XYZ])
    return t.join(fit, "frame").select("event_id", "status", "inliers", *(r(c, n) for c, n in zip(back, XYZ, strict=True)))


@register("r7_r8_method_occlusion_diagnostics", f"WITH {MEASURES}, k AS (SELECT method, frame, point_id, rel, row_number() OVER (PARTITION BY method ORDER BY rel DESC, frame, point_id) AS place FROM m WHERE status='O') SELECT method, place, frame, point_id, round(rel,6) AS rel FROM k WHERE place<=10")
def r8(spark, d):
    """The ten worst rows of each method."""
    w = Window.partitionBy("method").orderBy(F.desc("rel"), "frame", "point_id")
    m = measures(spark, d).filter("status = 'O'").select("method", "frame", "point_id", "rel", F.row_number().over(w).cast("bigint").alias("place"))
    return m.filter("place <= 10").select("method", "place", "frame", "point_id", r(F.col("rel"), "rel"))
