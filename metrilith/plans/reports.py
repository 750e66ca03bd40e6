"""Whole reports in one query, and files written and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from metrilith.operators import stats, variants
from metrilith.operators.tables import Scratch
from metrilith.plans.registry import register
from metrilith.plans.views import MEASURES, measures, rounded, table
from metrilith.sources import calibration, index, readers
from metrilith.streaming import fan_out


def r(c, name, n=4):
    return rounded(c, n).alias(name)


def folder(spark, label):
    """A new folder in the shared one; it goes when the application ends."""
    return Scratch(spark, label).root


# --- reports -----------------------------------------------------------------------------


@register(
    "r1_method_report",
    f"""WITH {MEASURES}, a AS (SELECT method, part, (max(pred)-min(pred))/(max(truth)-min(truth)) AS ratio FROM m GROUP BY ALL HAVING count(*)>=3 AND max(truth)-min(truth)>2e-12),
 s AS (SELECT method, part, stddev_pop(err) AS sd FROM m GROUP BY ALL HAVING count(*)>=2),
 j AS (SELECT method, abs(err - lag(err) OVER (PARTITION BY method, part ORDER BY frame, point_id, err)) AS step FROM m),
 e AS (SELECT method, count(*) AS n, count(*) FILTER (status='F') AS n_valid, round(100.0*count(*) FILTER (status='F')/count(*),6) AS coverage, round(avg(abs(err)) FILTER (status='F'),4) AS mae, round(sqrt(avg(err*err) FILTER (status='F')),4) AS rmse, round(avg(err) FILTER (status='F'),4) AS bias, round(100.0*count(*) FILTER (rel>50 AND status='F')/count(*) FILTER (status='F'),6) AS false_match, round(100.0*count(*) FILTER (rel<=20 AND status='F')/count(*),6) AS accurate, round(sum(pred*qty)/sum(qty),4) AS weighted_mean, round(quantile_cont(abs(err),0.5) FILTER (status='F'),4) AS median, round(quantile_cont(abs(err),0.95) FILTER (status='F'),4) AS p95 FROM m GROUP BY 1)
 SELECT e.*, (SELECT round(avg(ratio),6) FROM a WHERE a.method=e.method) AS amplitude_ratio, (SELECT round(avg(sd),4) FROM s WHERE s.method=e.method) AS temporal_sd, (SELECT round(avg(step),4) FROM j WHERE j.method=e.method) AS jitter, (SELECT round(max(step),4) FROM j WHERE j.method=e.method) AS worst_step FROM e""",
)
def r1(spark, d):
    """One row for each method: errors, coverage, matches, spread within points, amplitude and steps between frames."""
    m = measures(spark, d)
    ok = F.col("status") == "F"
    e, q = F.when(ok, F.col("err")), F.col("qty")
    errors = m.groupBy("method").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_valid"), r(stats.share(ok), "coverage", 6), r(stats.mae(e), "mae"), r(stats.rmse(e), "rmse"), r(F.avg(e), "bias"),
        r(stats.share(F.col("rel") > 50, ok), "false_match", 6), r(stats.share((F.col("rel") <= 20) & ok), "accurate", 6), r(F.try_divide(F.sum(F.col("pred") * q), F.sum(q)), "weighted_mean"),
    )
    width = lambda c: F.max(c) - F.min(c)
    step = F.abs(F.col("err") - F.lag("err").over(Window.partitionBy("method", "part").orderBy("frame", "point_id", "err")))
    # points first: one exchange by method and point serves steps, spreads and amplitudes
    points = m.select("method", "part", "pred", "truth", "err", step.alias("step")).groupBy("method", "part").agg(
        F.count("*").alias("n"), F.stddev_pop("err").alias("sd"), width("pred").alias("p"), width("truth").alias("t"), F.sum("step").alias("steps"), F.count("step").alias("n_steps"), F.max("step").alias("top"),
    )
    series = points.groupBy("method").agg(
        r(F.avg(F.when((F.col("n") >= 3) & (F.col("t") > 2e-12), F.try_divide("p", "t"))), "amplitude_ratio", 6), r(F.avg(F.when(F.col("n") >= 2, F.col("sd"))), "temporal_sd"),
        r(F.try_divide(F.sum("steps"), F.sum("n_steps")), "jitter"), r(F.max("top"), "worst_step"),
    )
    places = stats.quantiles(m.filter(ok).select("method", F.abs("err").alias("a")), ["method"], "a", {"median": 0.5, "p95": 0.95})
    return errors.join(places.select("method", r(F.col("median"), "median"), r(F.col("p95"), "p95")), "method", "left").join(series, "method", "left")


@register(
    "r2_result_tables",
    f"""WITH {MEASURES}, q AS (SELECT method, source, source % 5 AS distance, count(*) AS n, count(*) FILTER (status='F') AS n_valid, avg(err) FILTER (status='F') AS bias, sqrt(avg(err*err) FILTER (status='F')) AS rmse FROM m GROUP BY ALL)
 SELECT method, coalesce(distance::VARCHAR, 'all') AS distance, count(*) AS sequences, round(100.0*sum(n_valid)/sum(n),6)::DOUBLE AS coverage, round(avg(bias),4) AS mean_bias, round(stddev_pop(bias),4) AS sd_bias, round(avg(rmse),4) AS mean_rmse, round(stddev_pop(rmse),4) AS sd_rmse FROM q GROUP BY ROLLUP(method, distance) HAVING method IS NOT NULL""",
)
def r2(spark, d):
    """Sequence errors by method and distance, and by method over all distances."""
    e = F.when(F.col("status") == "F", F.col("err"))
    q = measures(spark, d).groupBy("method", "source", (F.col("source") % 5).alias("distance")).agg(F.count("*").alias("n"), F.count(e).alias("n_valid"), F.avg(e).alias("bias"), stats.rmse(e).alias("rmse"))
    t = q.rollup("method", "distance").agg(
        F.count("*").alias("sequences"), r(100.0 * F.try_divide(F.sum("n_valid"), F.sum("n")), "coverage", 6), r(F.avg("bias"), "mean_bias"), r(F.stddev_pop("bias"), "sd_bias"), r(F.avg("rmse"), "mean_rmse"), r(F.stddev_pop("rmse"), "sd_rmse"),
    )
    return t.filter("method is not null").withColumn("distance", F.coalesce(F.col("distance").cast("string"), F.lit("all")))


PAIRS = [("A", "N"), ("A", "R"), ("N", "R")]


@register(
    "a16_report_pivot",
    f"""WITH {MEASURES}, p AS (SELECT source, avg(abs(err)) FILTER (method='A') AS a, avg(abs(err)) FILTER (method='N') AS n, avg(abs(err)) FILTER (method='R') AS r FROM m GROUP BY 1),
 d AS (SELECT 'A-N' AS pair, a-n AS diff FROM p UNION ALL SELECT 'A-R', a-r FROM p UNION ALL SELECT 'N-R', n-r FROM p)
 SELECT pair, count(diff) AS pairs, round(avg(diff),4) AS mean, round(stddev_samp(diff),4) AS sd, count(*) FILTER (diff<0) AS better FROM d GROUP BY 1 HAVING count(diff)>=2""",
)
def a16(spark, d):
    """Reports, one for each sequence, pivoted by method: paired differences where at least two reports hold both methods."""
    p = measures(spark, d).groupBy("source").pivot("method", ["A", "N", "R"]).agg(stats.mae(F.col("err")))
    long = p.select(F.inline(F.array(*(F.struct(F.lit(f"{a}-{b}").alias("pair"), (F.col(a) - F.col(b)).alias("diff")) for a, b in PAIRS))))
    g = long.groupBy("pair").agg(F.count("diff").alias("pairs"), r(F.avg("diff"), "mean"), r(F.stddev_samp("diff"), "sd"), F.count_if(F.col("diff") < 0).alias("better"))
    return g.filter("pairs >= 2")


# --- files -------------------------------------------------------------------------------


@register("src1_snk1_csv_round_trip", "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def src1(spark, d):
    """Fixed columns written as CSV and scanned as text, then typed."""
    path = f"{folder(spark, 'csv')}/customers"
    columns = ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"]
    readers.write_csv(table(spark, d, "customer"), path, columns)
    t = readers.csv_text(spark, path)
    return t.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"))


@register(
    "src2_snk2_method_tables",
    f"""WITH {MEASURES} SELECT CASE WHEN method='A' THEN 'first' ELSE method END AS method, count(*) AS n,
 count(confidence) FILTER (method='N') AS n_confidence, count(*) FILTER (method='R') AS n_points,
 round(avg(err),4) AS bias FROM m GROUP BY m.method""",
)
def src2(spark, d):
    """Methods written as CSV with headers that differ in order and in columns, scanned as one folder by each file's own header.

    The file of one method has no method column and takes its file's name; summary.csv and a
    file without rows play no part.
    """
    path = f"{folder(spark, 'methods')}/parts"
    m = measures(spark, d)
    quoted = F.concat(F.lit('said "so", '), "status").alias("note")
    readers.write_named_csv(m.filter("method = 'A'").select("err", "frame"), path, "first")
    readers.write_named_csv(m.filter("method = 'N'").select("frame", "confidence", quoted, "err", "method"), path, "second")
    readers.write_named_csv(m.filter("method = 'R'").select("method", "point_id", "err"), path, "third")
    readers.write_named_csv(m.filter("method = 'R'").select("method", "err").limit(3), path, "summary")
    readers.write_named_csv(m.filter("false").select("method", "err"), path, "zero")
    t = readers.method_tables(spark, path, ["err", "confidence", "point_id", "note"])
    err = F.col("err").cast("double")
    whole = F.col("note").isNull() | F.col("note").startswith('said "so", ')
    return t.filter(whole).groupBy("method").agg(F.count("*").alias("n"), F.count("confidence").alias("n_confidence"), F.count("point_id").alias("n_points"), r(F.avg(err), "bias"))


@register("src3_sample_index", "SELECT 's' || doc_id AS sample_id, source AS dataset_name, lang AS official_split, n_chars::INT AS width FROM documents")
def src3(spark, d):
    """A sample index written as JSON lines and scanned with its fixed schema."""
    path = f"{folder(spark, 'index')}/samples"
    docs = table(spark, d, "documents")
    docs.select(F.concat(F.lit("s"), "doc_id").alias("sample_id"), F.col("source").alias("dataset_name"), F.col("lang").alias("official_split"), F.col("n_chars").cast("int").alias("width")).write.json(path)
    return readers.samples(spark, path).select("sample_id", "dataset_name", "official_split", "width")


@register("src6_flat_sequences", "SELECT r_name AS sequence_name, n_nationkey::VARCHAR AS frame_id, n_name AS left_path FROM nation JOIN region ON n_regionkey=r_regionkey")
def src6(spark, d):
    """A nested manifest (one small file) written and flattened to frames."""
    path = f"{folder(spark, 'manifest')}/sequences"
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    frame = F.struct(F.col("n_nationkey").cast("string").alias("frame_id"), F.col("n_name").alias("left_path"))
    groups = n.groupBy(F.col("r_name").alias("name")).agg(F.collect_list(frame).alias("frames"))
    groups.agg(F.collect_list(F.struct("name", "frames")).alias("sequences")).write.json(path)
    return readers.flat_sequences(spark, path).select("sequence_name", "frame_id", "left_path")


@register("src16_external_truth", "SELECT epoch(ts) + event_id/1e6 AS timestamp_s, round(value/1000,9) AS z FROM events WHERE value IS NOT NULL")
def src16(spark, d):
    """Positions in millimetres along one axis, written as CSV and read as truth in metres."""
    path = f"{folder(spark, 'truth')}/truth"
    e = table(spark, d, "events").filter("value is not null")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + F.col("event_id") / 1e6
    readers.write_csv(e.select(at.alias("timestamp_s"), F.col("value").alias("position_mm")), path, ["timestamp_s", "position_mm"])
    return readers.external_truth(spark, path).select("timestamp_s", r(F.col("z"), "z", 9))


@register("snk3_st12_resumed_write", "SELECT o_orderkey, o_totalprice FROM orders")
def snk3(spark, d):
    """A write that stopped half-way and goes on: every order is there once."""
    path = f"{folder(spark, 'resumed')}/orders"
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    readers.write_remaining(table(spark, d, "orders").filter("o_orderstatus = 'F'").select(*o.columns), path, "o_orderkey")
    readers.write_remaining(o, path, "o_orderkey")
    return spark.read.parquet(path)


@register(
    "snk4_fan_out",
    """SELECT output, count(*) AS n, sum(event_id)::BIGINT AS frames, sum(user_id)::BIGINT AS points
 FROM events, (SELECT unnest(['raw_measurements','validated_measurements','final_measurements','measurement_confidence','physics_confidence','fault_log','runtime']) AS output) GROUP BY 1""",
)
def snk4(spark, d):
    """Events as facts that arrive in several files, streamed to seven outputs; the first batch has reached two of them before."""
    root = folder(spark, "facts")
    e, v = table(spark, d, "events"), F.col("value")
    facts = e.select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_id").alias("frame_id"), F.col("user_id").alias("point_id"), v.alias("x_raw"), (v / 2).alias("y_raw"), (v + 100).alias("z_raw"),
        (v % 1).alias("measurement_confidence"), (1 - v % 1).alias("physics_confidence"), F.col("event_type").alias("fault_type"), v.alias("fault_score"),
        F.when(F.col("event_type") == "error", "remeasure").otherwise("none").alias("recovery_action"), (F.col("event_type") != "error").alias("recovery_success"), (v * 10).alias("runtime_ms"),
    )
    # four batches of sixteen files, so that many tasks share each batch
    facts.repartition(64, "frame_id").write.parquet(f"{root}/in")
    fan = fan_out.FanOut(f"{root}/out")
    source = spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", 16).parquet(f"{root}/in")
    some = fan_out.FanOut(f"{root}/out", {n: fan_out.OUTPUTS[n] for n in ("raw_measurements", "runtime")})
    # as if the driver had been lost between the outputs of the first batches: another checkpoint, the same folders
    fan_out.run(source, some, f"{root}/lost")
    fan_out.run(source, fan, f"{root}/state")
    return fan_out.summary(fan, spark)


_GATES = [(margin, confidence) for margin in (0.0, 0.02, 0.04) for confidence in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)]


@register(
    "r12_snk5_variants_with_record",
    f"""WITH {MEASURES}, v AS (SELECT * FROM (VALUES {", ".join(f"('m{100 * m:.0f}_c{10 * c:.0f}', {m}, {c})" for m, c in _GATES)}) AS v(name, least_margin, least_confidence))
 SELECT name AS method, count(*) AS n, count(*) FILTER (margin>=least_margin AND confidence>=least_confidence) AS accepted,
 count(*) FILTER (margin>=least_margin AND confidence>=least_confidence AND rel<=20) AS accurate FROM m, v GROUP BY 1""",
)
def r12(spark, d):
    """Eighteen gates over the same measurements, written under their own labels; counted while they are written, and settings kept beside them."""
    m = measures(spark, d)
    root = folder(spark, "variants")
    passes = lambda margin, confidence: (F.col("margin") >= margin) & (F.col("confidence") >= confidence)
    gates = {f"m{100 * a:.0f}_c{10 * b:.0f}": {"accepted": passes(a, b), "near": passes(a, b) & (F.col("rel") <= 20)} for a, b in _GATES}
    record = variants.run(m, gates, ["frame", "point_id"], {"accepted": F.col("accepted"), "accurate": F.col("near")}, f"{root}/rows")
    variants.write_summary(m, record, f"{root}/summary", {"gates": len(gates)})
    return variants.record_table(m, record)


@register(
    "src15_snk10_calibrations",
    """WITH s AS (SELECT s_suppkey AS k, round(500 + s_acctbal / 100, 2) AS f, round(s_acctbal / 50, 2) AS b FROM supplier)
 SELECT 'camera ' || k AS name, CASE k % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'xml' ELSE 'copy' END AS form, round(f, 6) AS focal, 640 AS width, round(abs(b), 6) AS baseline, round(f * -b, 6) AS shift,
  CASE WHEN k % 3 <> 2 AND k % 11 = 0 THEN 'unit' ELSE '' END AS issues
 FROM s WHERE k % 3 <> 2 OR k % 11 <> 0""",
)
def src15(spark, d):
    """A calibration for each supplier, written as JSON lines by long names or as XML, and as JSON lines of what has been read; scanned as one folder.

    Copies are made of what was sound after reading another form.
    """
    root = folder(spark, "calibrations")
    focal, side = rounded(500 + F.col("s_acctbal") / 100, 2), rounded(F.col("s_acctbal") / 50, 2)
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("camera "), "s_suppkey").alias("name"), focal.alias("f"), side.alias("b"), F.when(F.col("s_suppkey") % 11 == 0, "inch").otherwise("mm").alias("unit"))
    zero, one = F.lit(0.0), F.lit(1.0)
    camera = F.array(F.array("f", zero, F.lit(320.0)), F.array(zero, "f", F.lit(240.0)), F.array(zero, zero, one))
    moved = F.array(-F.col("b"), zero, zero)
    plain = s.select("k", "name", "unit", F.array(F.lit(640), F.lit(480)).alias("imageSize"), camera.alias("left_camera_matrix"), camera.alias("right_camera_matrix"), moved.alias("translation"))
    # many tasks write, however few bytes they have, but no file of its own for each calibration: the driver lists files
    dealt = lambda df: df.repartition(64, "k").drop("k").write
    dealt(plain.filter("k % 3 = 0")).json(f"{root}/json.jsonl")
    cell = lambda c, rows, cols: F.struct(F.lit(rows).alias("rows"), F.lit(cols).alias("cols"), F.lit("d").alias("dt"), F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias("data"))
    coded = s.select("k", "name", "unit", cell(F.array(F.lit(640), F.lit(480)), 1, 2).alias("image_size"), cell(F.flatten(camera), 3, 3).alias("K_left"), cell(F.flatten(camera), 3, 3).alias("K_right"), cell(moved, 3, 1).alias("T"))
    store = {"rootTag": "calibrations", "rowTag": "opencv_storage"}
    dealt(coded.filter("k % 3 = 1")).format("xml").options(**store).save(f"{root}/xml")
    dealt(coded.filter("k % 3 = 2")).format("xml").options(**store).save(f"{root}/_first")
    sound = calibration.calibrations(spark, f"{root}/_first").filter(F.size("issues") == 0)
    calibration.as_json(sound).select("text").write.text(f"{root}/copy.jsonl")
    t = calibration.calibrations(spark, root)
    form = F.regexp_extract("path", r"/(json|xml|copy)(?:\.jsonl)?/[^/]+$", 1)
    p2 = F.get(F.get("P2", 0), 3)
    return t.select("name", form.alias("form"), r(F.get(F.get("K_left", 0), 0), "focal", 6), F.get("image_size", 0).alias("width"), r(F.col("baseline"), "baseline", 6), r(p2, "shift", 6), F.array_join("issues", ",").alias("issues"))


@register(
    "src9_src11_sample_index",
    """WITH e AS (SELECT event_id AS k, user_id AS u FROM events),
 a AS (SELECT 'FlyingThings3D_subset' AS dataset_name, CASE k % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS sequence_name, k::VARCHAR AS frame_id, -1.0::DOUBLE AS disparity_scale, k % 7 = 0 AS truth, 'FlyingThings3D_subset_image_clean.tar' AS top FROM e WHERE k % 4 = 0),
 g AS (SELECT CASE WHEN k % 8 = 1 THEN 'FlyingThings3D_subset' ELSE 'city' || u % 10 END AS dataset_name, CASE WHEN k % 8 = 1 THEN 'train' ELSE 'u' || u END AS sequence_name, CASE WHEN k % 8 = 1 THEN (k - 1)::VARCHAR ELSE 'd' || k % 5 || '/' || k END AS frame_id, 1.0::DOUBLE AS disparity_scale, false AS truth, CASE WHEN k % 8 = 1 THEN 'FlyingThings3D_subset' ELSE 'city' || u % 10 END AS top FROM e WHERE k % 4 <> 0 AND k % 4 <> 3)
 SELECT dataset_name || '/' || sequence_name || '/' || frame_id AS sample_id, top, disparity_scale, truth FROM
  (SELECT * FROM a UNION ALL SELECT * FROM g WHERE (dataset_name, sequence_name, frame_id) NOT IN (SELECT (dataset_name, sequence_name, frame_id) FROM a))""",
)
def src9(spark, d):
    """An index of samples over a listing with a sample of each event, by two adapters; a second build has replaced one of the second adapter alone.

    Every fourth event lies in archives, the next one of two of these in folders that give the same
    sample again or not, others in left and right folders of several namings; the last of four has no partner.
    """
    k, u = F.col("event_id"), F.col("user_id")
    text = lambda *c: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in c))
    name, split = k.cast("string"), F.when(k % 3 == 0, "train").when(k % 3 == 1, "val").otherwise("test")
    archive = lambda part, side, end: text(f"FlyingThings3D_subset_{part}.tar/FlyingThings3D_subset/", split, f"/{part}/{side}/", name, end)
    again = lambda side: text(f"FlyingThings3D_subset/train/{side}/", (k - 1).cast("string"), ".png")
    side = lambda left, right: F.array(*(text("city", (u % 10).cast("string"), "/u", u.cast("string"), f"/{s}/d", (k % 5).cast("string"), "/", name, ".png") for s in (left, right)))
    own = F.when(k % 4 == 0, F.array(archive("image_clean", "left", ".png"), archive("image_clean", "right", ".png"), F.when(k % 7 == 0, archive("disparity", "left", ".pfm"))))
    own = own.when(k % 8 == 1, F.array(again("left"), again("right"))).when(k % 4 == 1, side("Left", "right")).when(k % 4 == 2, side("image_2", "IMAGE_3")).otherwise(side("cam0", "image_1"))
    files = table(spark, d, "events").select(F.explode(own).alias("path")).filter("path is not null")
    at = index.Index(spark, f"{folder(spark, 'index')}/samples")
    found = index.discovered(files, "root")
    at.build(found.filter("adapter = 'generic'"), "root")
    at.build(found, "root")
    top = F.regexp_extract("left_path", "^[^/]+", 0)
    return at.read().select("sample_id", top.alias("top"), "disparity_scale", F.col("disparity_gt_path").isNotNull().alias("truth"))
