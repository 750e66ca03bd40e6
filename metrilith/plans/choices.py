"""Decisions, selections, set operations and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from metrilith.functions import parse, rules
from metrilith.operators import stats
from metrilith.plans.registry import register
from metrilith.plans.views import MEASURES, measures, rounded, table


def r(c, name, n=6):
    return rounded(c, n).alias(name)


@register("parse_clean_cells", "WITH c AS (SELECT event_id, CASE event_id%5 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN 'inf' WHEN 3 THEN ' 1.5 ' ELSE '3' END AS s FROM events) SELECT event_id, CASE event_id%5 WHEN 3 THEN 1.5::DOUBLE WHEN 4 THEN 3.0::DOUBLE END AS number, CASE event_id%5 WHEN 4 THEN 3 ELSE -1 END::INTEGER AS frame FROM c")
def cells(spark, d):
    k = F.col("event_id") % 5
    s = F.when(k == 0, "").when(k == 1, "nan").when(k == 2, "inf").when(k == 3, " 1.5 ").otherwise("3")
    e = table(spark, d, "events").select("event_id", s.alias("s"))
    return e.select("event_id", parse.clean_double(F.col("s")).alias("number"), parse.frame_or_all(F.col("s")).alias("frame"))


@register("p2_rejected", "SELECT l_orderkey, l_linenumber, l_returnflag='R' OR (l_discount<0.02 AND l_tax>0) AS rejected FROM lineitem")
def p2(spark, d):
    c = (F.col("l_returnflag") == "R") | ((F.col("l_discount") < 0.02) & (F.col("l_tax") > 0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(c, F.lit(False)).alias("rejected"))


@register("p9_vector_norm", "SELECT vec_id, round(sqrt(embedding[1]::DOUBLE**2+embedding[2]::DOUBLE**2+embedding[3]::DOUBLE**2),8) AS norm FROM embeddings")
def p9(spark, d):
    return table(spark, d, "embeddings").select("vec_id", r(F.sqrt(sum((F.col("embedding")[k].cast("double") ** 2 for k in range(3)), F.lit(0.0))), "norm", 8))


Q = [[1, 0, 0, -320], [0, 1, 0, -240], [0, 0, 0, 700], [0, 0, 0.01, 0]]


@register("p11_reprojection", "SELECT l_orderkey, l_linenumber, CASE WHEN d>0 THEN round((x-320)/(0.01*d),4) END AS px, CASE WHEN d>0 THEN round((y-240)/(0.01*d),4) END AS py, CASE WHEN d>0 THEN round(700/(0.01*d),4) END AS pz FROM (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_linenumber*10.0 AS y, l_quantity-5 AS d FROM lineitem)")
def p11(spark, d):
    x, y, z = rules.reprojected(Q, F.col("l_quantity"), F.col("l_linenumber") * 10.0, F.col("l_quantity") - 5)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(x, "px", 4), r(y, "py", 4), r(z, "pz", 4))


@register("p16_p19_precision_policy", "WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount AS sd, 10*700*0.12/(l_quantity*l_quantity) AS need FROM lineitem) SELECT l_orderkey, l_linenumber, round(need,6) AS need, CASE WHEN need<0.05 THEN 'INFEASIBLE' WHEN sd/need<=1 THEN 'MET' WHEN l_linenumber%3 < CASE WHEN sd/need<=2 THEN 1 ELSE 2 END THEN 'RETRY_STRONGER' ELSE 'VALID_BUT_PRECISION_UNMET' END AS status FROM s")
def p16(spark, d):
    need = rules.needed_sigma(F.lit(10.0), F.lit(700.0), F.lit(0.12), F.col("l_quantity"))
    m = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", need.alias("n"))
    ratio = F.try_divide("l_discount", "n")
    return m.select("l_orderkey", "l_linenumber", r(F.col("n"), "need"), rules.precision_decision(ratio, F.col("n") >= 0.05, F.col("l_linenumber") % 3).alias("status"))


@register("p18_baseline_recommendation", "WITH b(v) AS (VALUES (10.0),(20.0),(30.0),(40.0)) SELECT l_orderkey, l_linenumber, coalesce((SELECT min(v) FROM b WHERE v>=l_quantity), (SELECT max(v) FROM b))::DOUBLE AS baseline FROM lineitem")
def p18(spark, d):
    have = F.array(*(F.lit(float(v)) for v in (10, 20, 30, 40)))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(F.array_min(F.filter(have, lambda v: v >= F.col("l_quantity"))), F.array_max(have)).alias("baseline"))


@register("p20_cycle_consistency", "WITH e AS (SELECT event_id, value/25 AS e, CASE WHEN event_id%2=0 THEN value/50 END AS rec FROM events) SELECT event_id, CASE WHEN e<=0.5 THEN 'cycle_valid' WHEN e<=1.5 THEN 'cycle_soft' WHEN e>3 THEN 'cycle_failed' WHEN rec IS NULL THEN 'cycle_recovery_required' WHEN rec<=1.5 THEN 'cycle_recovered' ELSE 'cycle_failed' END AS status, round(CASE WHEN e<=0.5 THEN 1 WHEN e<=1.5 THEN 1-0.5*(e-0.5) WHEN e>3 THEN 0 WHEN rec IS NULL THEN 0.5 WHEN rec<=0.5 THEN 1 WHEN rec<=1.5 THEN 0.6 ELSE 0 END,6)::DOUBLE AS scale FROM e")
def p20(spark, d):
    e, rec = F.col("value") / 25, F.when(F.col("event_id") % 2 == 0, F.col("value") / 50)
    return table(spark, d, "events").select("event_id", rules.cycle_status(e, rec).alias("status"), r(rules.cycle_scale(e, rec), "scale"))


@register("p23_fused_confidence", "WITH e AS (SELECT event_id, exp(-value/15) AS a, CASE WHEN event_id%3>0 THEN 0.8 END AS b, CASE WHEN event_id%4>0 THEN value/100 END AS c FROM events) SELECT event_id, round(greatest(0, least(1, (a*0.5+coalesce(b*0.3*0.9,0)+coalesce(c*0.2,0))/(0.5+CASE WHEN b IS NULL THEN 0 ELSE 0.27 END+CASE WHEN c IS NULL THEN 0 ELSE 0.2 END))),6) AS c_phy, concat_ws('+', CASE WHEN b IS NULL THEN 'flow' END, CASE WHEN c IS NULL THEN 'spatial' END) AS missing FROM e")
def p23(spark, d):
    a, b, c = rules.evidence(F.col("value")), F.when(F.col("event_id") % 3 > 0, 0.8), F.when(F.col("event_id") % 4 > 0, F.col("value") / 100)
    one = F.lit(1.0)
    return table(spark, d, "events").select("event_id", r(rules.fused([(a, 0.5, one), (b, 0.3, F.lit(0.9)), (c, 0.2, one)]), "c_phy"), rules.names_of({"flow": b.isNull(), "spatial": c.isNull()}).alias("missing"))


@register("p27_p28_fault_and_recovery", "WITH f AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity/50>0.8 THEN 'TRACKING_LOSS' WHEN l_tax*20>1 AND l_discount*10>0.7 THEN 'CAMERA_MOTION' WHEN l_linenumber/3.0>2 THEN 'EXTRINSIC_DRIFT' WHEN l_tax*20<1 AND l_discount*20>1.5 AND l_quantity/10>1 THEN 'STEREO_MISMATCH' WHEN l_discount<0.025 AND l_tax<0.04 THEN 'MOTION_BLUR' WHEN l_discount<0.025 THEN 'WEAK_TEXTURE' WHEN l_quantity/20>1.5 THEN 'FLOW_DRIFT' ELSE 'NORMAL' END AS fault FROM lineitem) SELECT fault, count(*) AS n FROM f GROUP BY 1")
def p27(spark, d):
    null = F.lit(None).cast("double")
    q, tax, disc = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    c = {"tracking_loss": q / 50, "reference_motion": tax * 20, "common_motion": disc * 10, "epipolar": F.col("l_linenumber") / 3.0 - 1, "geometry": null, "lr": disc * 20 - 0.5, "neighbor": q / 10, "gradient": disc * 10, "blur": tax * 10, "flow": q / 20 - 0.5, "fb": null, "cost": null, "temporal": null, "physics": null}
    return table(spark, d, "lineitem").groupBy(rules.fault(c).alias("fault")).agg(F.count("*").alias("n"))


@register("p26_p34_bounded_correction", "WITH e AS (SELECT event_id, value AS x, 50.0 AS g FROM events) SELECT event_id, round(CASE WHEN abs(g-x)>25 THEN x+(g-x)*25/abs(g-x) ELSE g END,6) AS corrected FROM e")
def p34(spark, d):
    (x,) = rules.toward([F.col("value")], [F.lit(50.0)], 25.0)
    return table(spark, d, "events").select("event_id", r(x, "corrected"))


@register("p36_p37_root_causes", "WITH k AS (SELECT concat_ws('+', CASE WHEN l_discount<0.02 THEN 'low_confidence' END, CASE WHEN l_tax>0.06 THEN 'wide_margin' END, CASE WHEN l_quantity>45 THEN 'large' END) AS cause FROM lineitem) SELECT cause, count(*) AS n FROM k GROUP BY 1")
def p37(spark, d):
    cause = rules.names_of({"low_confidence": F.col("l_discount") < 0.02, "wide_margin": F.col("l_tax") > 0.06, "large": F.col("l_quantity") > 45})
    return table(spark, d, "lineitem").groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


@register("p35_outcome_label", f"WITH {MEASURES} SELECT CASE WHEN abs(err)<truth*0.3-1e-6 THEN 'BENEFICIAL' WHEN abs(err)>truth*0.3+1e-6 THEN 'HARMFUL' ELSE 'NEUTRAL' END AS label, count(*) AS n FROM m GROUP BY 1")
def p35(spark, d):
    e, b = F.abs("err"), F.col("truth") * 0.3
    label = F.when(e < b - 1e-6, "BENEFICIAL").when(e > b + 1e-6, "HARMFUL").otherwise("NEUTRAL")
    return measures(spark, d).groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@register("p38_least_of_terms", "SELECT l_orderkey, l_linenumber, round(least(1, l_discount*10, l_quantity/50),6) AS confidence FROM lineitem")
def p38(spark, d):
    terms = [F.lit(1.0), F.col("l_discount") * 10, F.col("l_quantity") / 50]
    there = F.greatest(*(t.isNull().cast("int") for t in terms)) == 0
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(F.when(there, F.least(*terms)).otherwise(0.0), "confidence"))


@register("p42_hash_split", "SELECT c_custkey, CASE WHEN ('0x'||substr(sha256(c_name),1,2))::INTEGER%2=0 THEN 'development' ELSE 'holdout' END AS split FROM customer")
def p42(spark, d):
    return table(spark, d, "customer").select("c_custkey", rules.hash_split(F.col("c_name")).alias("split"))


@register("p43_row_fingerprint", "SELECT n_nationkey, sha256(n_name||'|'||n_regionkey) AS fingerprint FROM nation")
def p43(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.sha2(F.concat_ws("|", "n_name", "n_regionkey"), 256).alias("fingerprint"))


@register("p45_parabolic_offset", "WITH c AS (SELECT l_orderkey, l_linenumber, lag(l_quantity) OVER w AS a, l_quantity AS b, lead(l_quantity) OVER w AS c FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_quantity)) SELECT l_orderkey, l_linenumber, CASE WHEN abs(a-2*b+c)>1e-12 THEN round(greatest(-1, least(1, 0.5*(a-c)/(a-2*b+c))),6) END AS shift FROM c")
def p45(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_quantity")
    q = F.col("l_quantity")
    m = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lag(q).over(w).alias("a"), q.alias("b"), F.lead(q).over(w).alias("c"))
    return m.select("l_orderkey", "l_linenumber", r(rules.parabola_offset(F.col("a"), F.col("b"), F.col("c")), "shift"))


@register("p47_half_even", "SELECT l_orderkey, l_linenumber, round_even(l_quantity/2, 0) AS half FROM lineitem")
def p47(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.rint(F.col("l_quantity") / 2).alias("half"))


@register("p48_speed_up", "WITH k AS (SELECT l_returnflag AS method, quantile_cont(l_extendedprice,0.5) AS med FROM lineitem GROUP BY 1) SELECT method, round((SELECT med FROM k WHERE method='A')/med,6) AS speed_up FROM k")
def p48(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), "l_extendedprice")
    k = stats.quantiles(m, ["method"], "l_extendedprice", {"med": 0.5})
    base = k.filter("method = 'A'").select(F.col("med").alias("base"))
    return k.crossJoin(F.broadcast(base)).select("method", r(F.try_divide("base", "med"), "speed_up"))  # one row


# --- selections --------------------------------------------------------------------------


@register("t1_worst_failures", f"WITH {MEASURES} SELECT frame, point_id, round(rel,6) AS rel FROM m WHERE status='O' ORDER BY m.rel DESC, frame, point_id LIMIT 300")
def t1(spark, d):
    m = measures(spark, d).filter("status = 'O'").select("frame", "point_id", "rel")
    return m.orderBy(F.desc(F.coalesce("rel", F.lit(-1.0))), "frame", "point_id").limit(300).select("frame", "point_id", r(F.col("rel"), "rel"))


@register("t3_best_corrections", "SELECT event_id, round(value,6) AS value FROM events ORDER BY events.value DESC, event_id LIMIT 20")
def t3(spark, d):
    return table(spark, d, "events").orderBy(F.desc("value"), "event_id").limit(20).select("event_id", r(F.col("value"), "value"))


@register("t7_hash_ranked_selection", "SELECT c_custkey, c_name FROM customer ORDER BY sha256(c_name), c_custkey LIMIT 50")
def t7(spark, d):
    return table(spark, d, "customer").orderBy(F.sha2("c_name", 256), "c_custkey").limit(50).select("c_custkey", "c_name")


@register("t8_priority_freeze", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 2 END, o_orderkey LIMIT 100")
def t8(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").orderBy(F.when(p.startswith("1"), 0).when(p.startswith("2"), 1).otherwise(2), "o_orderkey").limit(100).select("o_orderkey", "o_orderpriority")


@register("t9_numeric_then_text", "WITH f AS (SELECT DISTINCT CASE WHEN event_id%3=0 THEN 'f'||event_id ELSE event_id::VARCHAR END AS id FROM events) SELECT id, row_number() OVER (ORDER BY TRY_CAST(id AS BIGINT) IS NULL, TRY_CAST(id AS BIGINT), id) AS place FROM f")
def t9(spark, d):
    i = F.col("event_id")
    f = table(spark, d, "events").select(F.when(i % 3 == 0, F.concat(F.lit("f"), i)).otherwise(i.cast("string")).alias("id")).distinct()
    n = F.col("id").try_cast("bigint")
    placed = stats.numbered(f.select("id", n.isNull().alias("text"), n.alias("number")), ["text", "number", "id"], "place")
    return placed.select("id", "place")


@register("t11_argmin_first_tie", "SELECT l_orderkey, arg_min(l_linenumber, (l_discount, l_linenumber)) AS line FROM lineitem GROUP BY 1")
def t11(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct("l_discount", "l_linenumber")).alias("line"))


@register("src11_first_wins_index", "SELECT arg_min(doc_id, doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY lower(trim(text))")
def src11(spark, d):
    k = table(spark, d, "documents").groupBy(F.sha2(F.lower(F.trim("text")), 256).alias("k")).agg(F.min_by(F.struct("doc_id", "source"), "doc_id").alias("f"))
    return k.select("f.doc_id", "f.source")


@register("src7_split_violations", "SELECT l_partkey AS sequence, count(DISTINCT l_linestatus) AS splits FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus)>1")
def src7(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("sequence")).agg(F.count_distinct("l_linestatus").alias("splits")).filter("splits > 1")


@register("u1_u4_key_sets", "SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersection', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'difference', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def u1(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    count = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return count(a.union(b).distinct(), "union").unionByName(count(a.intersect(b), "intersection")).unionByName(count(a.subtract(b), "difference"))


@register(
    "j20_case_grid",
    "SELECT event_type AS mode, t.range::INT AS seed, s.x AS severity FROM (SELECT DISTINCT event_type FROM events), range(10) t, (SELECT unnest(['low','medium','high']) AS x) s",
)
def j20(spark, d):
    """Every case of a grid: modes of the data by ten seeds by three severities."""
    modes = table(spark, d, "events").select(F.col("event_type").alias("mode")).distinct()
    seeds = modes.select("mode", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("seed"))
    return seeds.select("mode", "seed", F.explode(F.array(*map(F.lit, ("low", "medium", "high")))).alias("severity"))
