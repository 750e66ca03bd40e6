"""Joins of measurements to truth: by key with fallback, nearest in time, interpolated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrilith.operators.tables import join_one


def last_of(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The last row by `order` of each key."""
    keep = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*keep), order).alias("__r")).select(*by, *(F.col(f"__r.{c}").alias(c) for c in keep))


def first_of(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The first row by `order` of each key."""
    keep = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*keep), order).alias("__r")).select(*by, *(F.col(f"__r.{c}").alias(c) for c in keep))


def with_fallback(rows: DataFrame, truth: DataFrame, point: str, frame: str, values: Sequence[str]) -> DataFrame:
    """Left join on (point, frame), else on the point's truth for all frames (frame below zero)."""
    exact = truth.filter(F.col(frame) >= 0).select(point, frame, F.struct(*values).alias("__exact"))
    whole = truth.filter(F.col(frame) < 0).select(point, F.struct(*values).alias("__whole"))
    out = rows.join(exact, [point, frame], "left").join(whole, point, "left").withColumn("__t", F.coalesce("__exact", "__whole"))
    return out.select(*rows.columns, *(F.col(f"__t.{v}").alias(v) for v in values))


def nearest_in_time(left: DataFrame, right: DataFrame, by: Sequence[str], t: str, tolerance: float, row: str, order: str, values: Sequence[str]) -> DataFrame:
    """For each left row the right row of the same key with the smallest time distance, within a tolerance.

    Times are cut into buckets of the tolerance's length and each right row stands in its own
    and both neighbouring ones, so the join is an equi-join; ties go to the smaller
    `order`. `row` identifies a left row. Rows without a match keep null values.
    """
    bucket = F.floor(F.col(t) / tolerance).cast("bigint")
    r = right.select(*by, F.col(t).alias("__t"), F.col(order).alias("__o"), F.struct(*values).alias("__v"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("__b"))
    met = left.select(*by, row, t, bucket.alias("__b")).join(r, [*by, "__b"])
    distance = F.abs(F.col("__t") - F.col(t))
    best = met.filter(distance <= tolerance).groupBy(row).agg(F.min_by(F.struct(distance.alias("distance"), "__v"), F.struct(distance, "__o")).alias("__m"))
    return left.join(best, row, "left").select(*left.columns, F.col("__m.distance").alias("distance"), *(F.col(f"__m.__v.{v}").alias(v) for v in values))


#: Rows of one stretch of time that meet truth without a point in one group.
CROWD = 250_000


def _of_any(point: str):
    return F.col(point).isNull() | (F.trim(F.col(point).cast("string")) == "")


def truth_of_frame(rows: DataFrame, truth: DataFrame, point: str, frame: str, order: str, values: Sequence[str]) -> DataFrame:
    """Left join on the frame with truth of the same point, or of any where its point is null or blank: the first by `order`.

    Both ways are equi-joins of rows that are first of their key already; a row whose own
    point is blank meets blank truth only. Rows without a frame have no truth.
    """
    blank = _of_any(point)
    packed = F.struct(F.col(order).alias("__o"), F.struct(*values).alias("__v"))
    own = truth.filter(~blank).groupBy(point, frame).agg(F.min(packed).alias("__own"))
    wide = truth.filter(blank).groupBy(frame).agg(F.min(packed).alias("__wide"))
    out = rows.join(own, [point, frame], "left").join(wide, frame, "left").withColumn("__t", F.least("__own", "__wide"))
    return out.select(*rows.columns, *(F.col(f"__t.__v.{v}").alias(v) for v in values))


def _last_and_next(x: Column, by: Sequence[str], t: str) -> tuple[Column, Column]:
    """The last value of `x` that isn't null up to each row's time, and the next one from it on.

    Both frames only grow as the rows go by, the second in falling order of time: a frame
    from each row to the end would be gone through anew for every row.
    """
    grown = lambda order: Window.partitionBy(*by).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    return F.last(x, True).over(grown(F.col(t).asc())), F.last(x, True).over(grown(F.col(t).desc()))


def _beside(left: DataFrame, right: DataFrame, by: Sequence[str], t: str, tolerance: float, row: str, order: str, values: Sequence[str], deal: bool = False) -> DataFrame:
    """(row, distance, order, values): for each left row the nearest right row of its key within the tolerance, if any.

    Each key's times are cut into stretches of the tolerance's length, a right row stands in
    its own and both next to it, and the last and next right time of each left row are seen
    in two sorts of the stretch: nothing is paired. With `deal` the left rows of a stretch are dealt to groups
    of about CROWD, and right rows are repeated for the groups of the stretches that have left rows.
    """
    stretch = F.floor(F.col(t) / tolerance).cast("bigint")
    firsts = right.groupBy(*by, t).agg(F.min(F.struct(F.col(order).alias("__o"), F.struct(*values).alias("__v"))).alias("__s"))
    seen = firsts.select(*by, t, F.lit(None).cast(left.schema[row].dataType).alias(row), F.struct(F.col(t).alias("t"), "__s").alias("__x"), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("__b"))
    line = left.select(*by, t, row, F.lit(None).cast(seen.schema["__x"].dataType).alias("__x"), stretch.alias("__b"))
    if deal:
        counts = line.groupBy("__b").agg(F.count("*").alias("n")).filter("__b is not null")
        groups = counts.select("__b", F.ceil(F.col("n") / CROWD).cast("int").alias("__groups"))
        line = join_one(line, groups, ["__b"], row, counts=counts).withColumn("__salt", F.pmod(F.xxhash64(row), F.col("__groups")).cast("int")).drop("__groups")
        seen = seen.join(groups, "__b").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__groups") - 1))).drop("__groups")
        by = [*by, "__salt"]
    line = line.unionByName(seen)
    sides = _last_and_next(F.col("__x"), [*by, "__b"], t)
    found = line.select(row, t, *(x.alias(n) for x, n in zip(sides, ("__a", "__z"), strict=True))).filter(F.col(row).isNotNull())
    at = lambda x: F.when(F.abs(F.col(f"{x}.t") - F.col(t)) <= tolerance, F.struct(F.abs(F.col(f"{x}.t") - F.col(t)).alias("distance"), F.col(f"{x}.__s.__o").alias("__o"), F.col(f"{x}.__s.__v").alias("__v")))
    return found.select(row, F.least(at("__a"), at("__z")).alias("__m"))


def nearest_truth(left: DataFrame, right: DataFrame, point: str, t: str, tolerance: float, row: str, order: str, values: Sequence[str]) -> DataFrame:
    """For each left row the truth nearest in time, of its point or of any where the truth's point is null or blank.

    Ties go to the smaller `order`; rows without truth within the tolerance keep nulls. The
    two ways are searched apart and the nearer is taken. Truth for all points would put all
    rows of a stretch of time in one task: there a stretch's rows are dealt to groups by `row`,
    as many as its rows need, each with its own copy of the truth around. `row` identifies a left row. `values` have to be
    types that compare.
    """
    blank = _of_any(point)
    own = _beside(left.filter(~blank), right.filter(~blank), [point], t, tolerance, row, order, values)
    both = own.unionByName(_beside(left, right.filter(blank), [], t, tolerance, row, order, values, deal=True))
    best = both.filter("__m is not null").groupBy(row).agg(F.min("__m").alias("__m"))
    return left.join(best, row, "left").select(*left.columns, F.col("__m.distance").alias("distance"), *(F.col(f"__m.__v.{v}").alias(v) for v in values))


def interpolated(left: DataFrame, right: DataFrame, by: Sequence[str], t: str, value: str, row: str) -> DataFrame:
    """`value` of the right series at each left time, linear between the samples around it; null outside them.

    Both series stand on one timeline, where the sample before and after is the last and
    the next one that isn't null. Samples at equal times count as their mean.
    """
    samples = right.groupBy(*by, t).agg(F.avg(value).alias("__v"))
    line = left.select(*by, t, row, F.lit(None).cast("double").alias("__v")).unionByName(samples.select(*by, t, F.lit(None).cast(left.schema[row].dataType).alias(row), "__v"))
    sample = F.when(F.col("__v").isNotNull(), F.struct(F.col(t).alias("t"), F.col("__v").alias("v")))
    last, after = _last_and_next(sample, by, t)
    line = line.withColumn("__a", last).withColumn("__b", after)
    share = F.try_divide(F.col(t) - F.col("__a.t"), F.col("__b.t") - F.col("__a.t"))
    at = F.when(F.col("__a.t") == F.col("__b.t"), F.col("__a.v")).otherwise(F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * share)
    return line.filter(F.col(row).isNotNull()).select(row, at.alias(value))


def neighbour_median(df: DataFrame, frame: Sequence[str], value: str, out: str) -> DataFrame:
    """Median of the other rows of a frame, from its sorted values and a row's place among them.

    Nothing is paired: leaving out the k-th of n sorted values leaves a median that stands
    next to the middle of all. Null for a frame of one row.
    """
    w = Window.partitionBy(*frame).orderBy(value)
    whole = Window.partitionBy(*frame)
    df = df.withColumn("__k", F.row_number().over(w)).withColumn("__n", F.count("*").over(whole))
    n = F.col("__n")
    nth = lambda k: F.max(F.when(F.col("__k") == k, F.col(value))).over(whole)
    m = F.floor((n - 1) / 2).cast("int")
    for name, k in (("__a", m), ("__b", m + 1), ("__c", m + 2)):
        df = df.withColumn(name, nth(k))
    odd = (n - 1) % 2 == 1
    single = F.when(F.col("__k") <= m + 1, F.col("__c")).otherwise(F.col("__b"))
    low = F.when(F.col("__k") <= m, F.col("__b")).otherwise(F.col("__a"))
    high = F.when(F.col("__k") <= m + 1, F.col("__c")).otherwise(F.col("__b"))
    return df.withColumn(out, F.when(n > 1, F.when(odd, single).otherwise((low + high) / 2))).drop("__k", "__n", "__a", "__b", "__c")


def one_to_one(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Inner join in which a key that stands twice on either side fails the query.

    Each side is grouped by the key anyway, so the check needs no further shuffle.
    """

    def single(df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c not in by]
        g = df.groupBy(*by).agg(F.count("*").alias("__n"), F.first(F.struct(*keep)).alias("__r"))
        once = F.when(F.col("__n") == 1, F.col("__r")).otherwise(F.raise_error(F.lit(f"keys {', '.join(by)} repeat")).cast(g.schema["__r"].dataType))
        return g.select(*by, once.alias("__r")).select(*by, *(F.col(f"__r.{c}").alias(c) for c in keep))

    return single(left).join(single(right), list(by))
