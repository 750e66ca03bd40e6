"""Aggregates over error columns; all are null over no rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrilith.operators.tables import Scratch


def mae(e: Column) -> Column:
    return F.avg(F.abs(e))


def rmse(e: Column) -> Column:
    return F.sqrt(F.avg(e * e))


def share(cond: Column, among: Column | None = None) -> Column:
    """100 * rows that fulfil `cond` among those that fulfil `among`."""
    among = F.lit(True) if among is None else among
    return 100.0 * F.try_divide(F.count_if(cond & among), F.count_if(among))


def pearson(x: Column, y: Column) -> Column:
    """Null instead of an error where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def with_ranks(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Average ranks of numeric `cols` within `by`, as rank_<col>: equal values share the mean of their places.

    Rows with a null or NaN in one of the columns, or a null key, go and take no part in any rank.
    """
    for c in cols:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    out = df
    for c in cols:
        place = running(df.groupBy(*by, c).agg(F.count("*").alias("__n")), by, c, "__n")
        out = out.join(place.select(*by, c, (F.col("upto") - (F.col("__n") - 1) / 2).alias(f"rank_{c}")), [*by, c])
    return out


def sweep(df: DataFrame, grid: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
    """Aggregates of all rows for every row of a small literal grid of thresholds."""
    return df.crossJoin(F.broadcast(grid)).groupBy(*by).agg(*aggs)


def confusion(df: DataFrame, truth: str, guess: str, labels: Sequence) -> DataFrame:
    """One row for each label of `truth`, a column n_<label> for each guess; pairs that don't occur count zero."""
    dim = df.sparkSession.createDataFrame([(x,) for x in labels], [truth])
    counts = df.groupBy(truth).pivot(guess, list(labels)).count()
    out = dim.join(counts, truth, "left").fillna(0)
    return out.select(truth, *(F.col(f"`{x}`").alias(f"n_{x}") for x in labels))


def _cells(rows: DataFrame, by: Sequence[str], value: str, weight: str, then: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows with a cell number __c, and each cell's weight __s, the weight before it and of its whole key.

    One range sort by key, value and `then` cuts all rows into partitions of like size, whose numbers are
    the cells. The rows are written, so both tables see the same cuts. Only sums, one for each
    cell and key, meet in one place: at most as many for a key as there are partitions.
    """
    cut = rows.repartitionByRange(*by, value, *then).withColumn("__c", F.spark_partition_id())
    rows = Scratch(rows.sparkSession, "places").write(cut, "rows")
    w = Window.partitionBy(*by)
    sizes = rows.groupBy(*by, "__c").agg(F.sum(weight).alias("__s"))
    before = F.coalesce(F.sum("__s").over(w.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows, sizes.withColumn("__before", before).withColumn("__all", F.sum("__s").over(w))


def _with_sizes(rows: DataFrame, sizes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows beside the sums of their cell; a null key is a key."""
    sizes = sizes.select(*(F.col(c).alias(f"__key_{i}") for i, c in enumerate(by)), F.col("__c").alias("__cell"), "__s", "__before", "__all")
    same = [F.col(c).eqNullSafe(F.col(f"__key_{i}")) for i, c in enumerate(by)]
    joined = rows.join(sizes, [*same, F.col("__c") == F.col("__cell")])
    return joined.drop("__cell", *(f"__key_{i}" for i in range(len(by))))


def running(rows: DataFrame, by: Sequence[str], value: str, weight: str, then: Sequence[str] = ()) -> DataFrame:
    """Adds upto, the sum of weights up to and with each row in the order of value and `then`, and total, that of its key.

    A key may hold any number of rows: sums run inside cells of neighbouring values. Rows
    with equal places share no order; values must be numbers, neither null nor NaN.
    """
    rows, sizes = _cells(rows, by, value, weight, then)
    w = Window.partitionBy(*by, "__c").orderBy(value, *then).rowsBetween(Window.unboundedPreceding, 0)
    out = _with_sizes(rows, sizes, by).withColumn("upto", F.sum(weight).over(w) + F.col("__before"))
    return out.withColumnRenamed("__all", "total").drop("__c", "__s", "__before")


def numbered(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """`df` with each row's place in the order of columns, from 1, over range partitions: no task sorts more than its part."""
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = Scratch(df.sparkSession, "numbers").write(cut, "rows")
    part = F.shiftright("__at", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # a row for each partition
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    placed = rows.withColumn("__part", part).join(F.broadcast(before), "__part")
    return placed.select(*df.columns, (F.col("__before") + F.col("__at") - F.shiftleft("__part", 33) + 1).alias(out))


def placed(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """`df` with each row's place within its key in the order of columns, from 1; a null key is a key.

    One range sort by key and order numbers all rows; what precedes a key's rows in a partition is
    counted by key and partition, so that rows of a key don't meet, however many it holds.
    """
    cut = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__at", F.monotonically_increasing_id())
    rows = Scratch(df.sparkSession, "places").write(cut, "rows").withColumn("__c", F.shiftright("__at", 33))
    w = Window.partitionBy(*by).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*by, "__c").agg(F.min("__at").alias("__s"), F.count("*").alias("__all"))
    cells = cells.withColumn("__before", F.coalesce(F.sum("__all").over(w), F.lit(0)))
    return _with_sizes(rows, cells, by).select(*df.columns, (F.col("__at") - F.col("__s") + F.col("__before") + 1).alias(out))


def quantiles(df: DataFrame, by: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact quantiles, linear between neighbours, one row for each key; {name: share} in `at`.

    Equal values are counted first, and only cells that hold a wanted place are ranked, so a
    key may hold any number of rows. Nulls and NaN take no part; a key without other values has no row.
    """
    v = F.col(value).cast("double")
    counts = df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("__v")).agg(F.count("*").alias("__n"))
    rows, sizes = _cells(counts, by, "__v", "__n")
    spot = {n: (F.col("__all") - 1) * p for n, p in at.items()}
    places = [f(s) for s in spot.values() for f in (F.floor, F.ceil)]
    inside = lambda c: ((c >= F.col("__before")) & (c < F.col("__before") + F.col("__s"))).cast("int")
    needed = sizes.filter(F.greatest(*map(inside, places)) > 0)
    last = F.sum("__n").over(Window.partitionBy(*by, "__c").orderBy("__v")) + F.col("__before")
    ranked = _with_sizes(rows, needed, by).withColumn("__last", last).withColumn("__first", F.col("__last") - F.col("__n"))
    here = lambda c: F.max(F.when((c >= F.col("__first")) & (c < F.col("__last")), F.col("__v")))
    out = []
    for n, s in spot.items():
        out += [here(F.floor(s)).alias(f"__low_{n}"), here(F.ceil(s)).alias(f"__high_{n}"), F.max(s - F.floor(s)).alias(f"__part_{n}")]
    got = ranked.groupBy(*by).agg(*out)
    between = lambda n: F.col(f"__low_{n}") + (F.col(f"__high_{n}") - F.col(f"__low_{n}")) * F.col(f"__part_{n}")
    return got.select(*by, *(between(n).alias(n) for n in at))
