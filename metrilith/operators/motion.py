"""Rigid motion of a frame's reference points, by sums that add up over partitions.

No task sees a whole frame. Counts and sums settle which frames can be fitted; a bounded
draw of points gives triplets; each row is measured against its frame's few transforms,
and counts and squares are added up; the winners' points give the sums of the final fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metrilith.functions import kernels
from metrilith.operators.tables import Scratch, join_one

P, Q = ["px", "py", "pz"], ["qx", "qy", "qz"]
#: Three-point fits tried for a frame. They are drawn from the points with the smallest hashes of their ids.
FITS = 100
#: Parts of a hash's range, so that a draw of points needs no sort of a frame.
_RANGE = 1 << 62


def _finite(*names: str) -> Column:
    return reduce(Column.__and__, [F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) for c in names])


def _second(a: list[str], b: list[str], w: Column) -> list[Column]:
    """Sums of w * a_i * b_j about the centres, as columns named by both."""
    return [F.sum(w * (F.col(x) - F.col(f"c{x}")) * (F.col(y) - F.col(f"c{y}"))).alias(f"{x}{y}") for x in a for y in b]


def _moved(r: Column, t: Column, p: list[str]) -> list[Column]:
    return [r[3 * i] * F.col(p[0]) + r[3 * i + 1] * F.col(p[1]) + r[3 * i + 2] * F.col(p[2]) + t[i] for i in range(3)]


def _squared(fit: Column) -> Column:
    """Squared distance of a row's p, moved by a fit, from its q."""
    return reduce(Column.__add__, [(x - F.col(y)) * (x - F.col(y)) for x, y in zip(_moved(fit["r"], fit["t"], P), Q, strict=True)])


def _tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The three-point fits of each frame's drawn points; those on a line give none."""
    for pdf in batches:
        fits, known = [], []
        for points, most in zip(pdf["points"], pdf["most"], strict=True):
            x = np.array([list(row) for row in points], float)
            pick = kernels.triplets(len(x), most)
            p, q, w = x[pick][:, :, :3], x[pick][:, :, 3:6], x[pick][:, :, 6]
            fine = ~(kernels.flat(p) | kernels.flat(q))
            r, t = kernels.rigid_fits(p[fine], q[fine], w[fine])
            fits.append([{"r": a.ravel().tolist(), "t": b.tolist()} for a, b in zip(r, t, strict=True)])
            known.append(bool(fine.any()))
        yield pd.DataFrame({"frame": pdf["frame"], "fits": fits, "known": known})


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _rotation(covariance: pd.Series) -> pd.Series:
    return pd.Series([x.ravel() for x in kernels.rotations(np.stack([np.asarray(c, float).reshape(3, 3) for c in covariance]))])


@F.pandas_udf(T.IntegerType())
def _rank(scatter: pd.Series) -> pd.Series:
    """Rank of points by their centred second moments: roots of eigenvalues are singular values."""
    values = np.linalg.eigvalsh(np.stack([np.asarray(c, float).reshape(3, 3) for c in scatter]))
    return pd.Series((np.sqrt(np.maximum(values, 0)) > np.maximum(1e-10, 1e-8 * np.sqrt(np.maximum(values[:, 2:], 0)))).sum(1))


def _statistics(rows: DataFrame) -> DataFrame:
    """(frame, n, bad, centres, ranks): counts, whether a weight can't be used, centres and spread of both sides."""
    means = [F.avg(F.when(F.col("fine"), F.col(c))).alias(f"c{c}") for c in [*P, *Q]]
    bad = F.count_if(F.col("fine") & ~F.coalesce((F.col("w") > 0) & (F.col("w") < float("inf")), F.lit(False)))
    return rows.groupBy("frame").agg(F.count_if("fine").alias("n"), (bad > 0).alias("bad"), *means)

def frame_motion(rows: DataFrame, tolerance: float = 3.0, least_share: float = 0.6, least: int = 3, longest: float = 3.0, fits: int = FITS, single: bool = False) -> DataFrame:
    """(frame, status, rotation, shift, inliers, rmse) of each frame's points (px, py, pz) against (qx, qy, qz), weighted by w.

    A row with a coordinate that is null or not finite is no reference point; its frame stays. All distances are in the
    coordinates' unit. `point_id` tells points apart and settles every draw and tie, so that the order of rows changes nothing.

    Status: `insufficient_references` under `least` points; `invalid_references` if a weight
    isn't a positive number; `degenerate_references` if the points, or all triplets tried,
    lie on a line; `ransac_failed` if no fit has `least` points and `least_share` of all within `tolerance`; `rmse_exceeded` if the
    final fit's root mean square is over `longest`; else `valid`. Of the fits the one with
    most points within wins, then the one with the least squares, then the first. With
    `single` the point with the smallest id alone gives a shift: `single_reference`.
    """
    scratch = Scratch(rows.sparkSession, "motion")
    rows = rows.select("frame", "point_id", *(F.col(c).cast("double").alias(c) for c in [*P, *Q, "w"]), _finite(*P, *Q).alias("fine"))
    if single:
        shift = F.array(*(F.col(q) - F.col(p) for p, q in zip(P, Q, strict=True)))
        first = rows.groupBy("frame").agg(F.min_by(F.when(F.col("fine"), shift), F.when(F.col("fine"), F.struct("point_id", *P, *Q))).alias("shift"))
        known = F.col("shift").isNotNull()
        unit = F.when(known, F.array(*(F.lit(float(i % 4 == 0)) for i in range(9))))
        status = F.when(known, "single_reference").otherwise("insufficient_references")
        return first.select("frame", status.alias("status"), unit.alias("rotation"), "shift", known.cast("bigint").alias("inliers"), F.when(known, 0.0).alias("rmse"))

    rows = scratch.write(rows, "rows")
    frames = scratch.write(_statistics(rows), "frames")
    counts = frames.select("frame", F.col("n").alias("n"))
    possible = frames.filter((F.col("n") >= least) & ~F.col("bad"))
    centred = scratch.write(join_one(rows.filter("fine"), possible, ["frame"], "point_id", counts=counts), "centred")
    one = F.lit(1.0)
    spread = centred.groupBy("frame").agg(*_second(P, P, one), *_second(Q, Q, one))
    square = lambda side: F.array(*(F.col(f"{a}{b}") for a in side for b in side))
    flat = spread.select("frame", ((_rank(square(P)) < 2) | (_rank(square(Q)) < 2)).alias("flat"))

    # a draw of twice the points wanted, by hash, then the smallest of them: bounded for a frame of any size
    h = F.shiftrightunsigned(F.xxhash64("point_id", *P, *Q), 2)
    wanted = 3 * fits
    drawn = centred.withColumn("h", h).filter((F.col("n") <= 4 * wanted) | (F.col("h") < F.lit(float(_RANGE)) * (2.0 * wanted) / F.col("n")))
    point = F.struct("h", "point_id", *P, *Q, "w")
    few = drawn.groupBy("frame").agg(F.slice(F.sort_array(F.collect_list(point)), 1, wanted).alias("points"))
    few = few.select("frame", F.transform("points", lambda x: F.array(*(x[c] for c in [*P, *Q, "w"]))).alias("points"), F.lit(fits).alias("most"))
    tried = scratch.write(few.mapInPandas(_tried, f"frame {dict(rows.dtypes)['frame']}, fits array<struct<r:array<double>,t:array<double>>>, known boolean"), "tried")

    scored = join_one(centred, tried.select("frame", "fits"), ["frame"], "point_id", counts=counts)
    scored = scored.select("frame", *P, *Q, F.posexplode("fits").alias("k", "fit")).withColumn("e", _squared(F.col("fit")))
    within = F.when(F.col("e") <= tolerance * tolerance, F.col("e"))
    sums = scored.groupBy("frame", "k").agg(F.count(within).alias("inside"), F.sum(within).alias("squares"))
    enough = F.greatest(F.lit(least), F.ceil(least_share * F.col("n")))
    sums = sums.join(counts, "frame").filter(F.col("inside") >= enough)
    best = sums.groupBy("frame").agg(F.min(F.struct((-F.col("inside")).alias("less"), "squares", "k")).alias("b"))
    chosen = scratch.write(tried.join(best, "frame").select("frame", F.get("fits", F.col("b.k")).alias("fit")), "chosen")

    winners = join_one(centred, chosen, ["frame"], "point_id", counts=counts).filter(_squared(F.col("fit")) <= tolerance * tolerance)
    winners = scratch.write(winners.select("frame", "point_id", "w", *P, *Q, *(f"c{c}" for c in [*P, *Q])), "winners")
    w, off = F.col("w"), lambda c: F.col(c) - F.col(f"c{c}")
    total = winners.groupBy("frame").agg(
        F.count("*").alias("inliers"), F.sum("w").alias("sw"), *(F.sum(w * off(a)).alias(f"w{a}") for a in [*P, *Q]),
        *(F.sum(w * off(a) * off(b)).alias(f"w{a}{b}") for a in P for b in Q), *(F.first(f"c{a}").alias(f"c{a}") for a in [*P, *Q]),
    )
    covariance = F.array(*(F.col(f"w{a}{b}") / F.col("sw") - F.col(f"w{a}") * F.col(f"w{b}") / (F.col("sw") * F.col("sw")) for a in P for b in Q))
    centre = lambda a: F.col(f"c{a}") + F.col(f"w{a}") / F.col("sw")
    turn = lambda i: reduce(Column.__add__, [F.col("rotation")[3 * i + j] * centre(P[j]) for j in range(3)])
    fitted = total.withColumn("rotation", _rotation(covariance)).select("frame", "inliers", "rotation", F.array(*(centre(Q[i]) - turn(i) for i in range(3))).alias("shift"))
    fitted = scratch.write(fitted, "fitted")
    # squares from the points themselves: differences of large sums would hide small residuals
    last = join_one(winners, fitted.select("frame", F.struct(F.col("rotation").alias("r"), F.col("shift").alias("t")).alias("fit")), ["frame"], "point_id", counts=counts)
    final = fitted.join(last.groupBy("frame").agg(F.sqrt(F.avg(_squared(F.col("fit")))).alias("rmse")), "frame")

    out = frames.select("frame", "n", "bad").join(flat, "frame", "left").join(tried.select("frame", "known"), "frame", "left").join(final, "frame", "left")
    status = (
        F.when(F.col("n") < least, "insufficient_references").when(F.col("bad"), "invalid_references").when(F.col("flat"), "degenerate_references")
        .when(F.col("inliers").isNull(), F.when(F.col("known"), "ransac_failed").otherwise("degenerate_references")).when(F.col("rmse") > longest, "rmse_exceeded").otherwise("valid")
    )
    out = out.select("frame", status.alias("status"), "rotation", "shift", "inliers", "rmse")
    only = lambda c, *s: F.when(F.col("status").isin(*s), F.col(c)).alias(c)
    return out.select("frame", "status", only("rotation", "valid"), only("shift", "valid"), F.coalesce(only("inliers", "valid"), F.lit(0)).cast("bigint").alias("inliers"), only("rmse", "valid", "rmse_exceeded"))
