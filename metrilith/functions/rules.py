"""Decisions as column expressions: bands, ordered rules, fused evidence, geometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_rule(rules: Sequence[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first rule that holds; a null condition doesn't."""
    out = None
    for cond, value in rules:
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def bands(x: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """names[k] for the first edge with x <= edges[k], else the last name."""
    return first_rule([(x <= e, n) for e, n in zip(edges, names, strict=False)], names[len(edges)])


def bins(x: Column, edges: Sequence[float]) -> Column:
    """Index of the half-open bin [edge, next edge); null outside."""
    out = None
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        cond = (x >= a) & (x < b)
        out = F.when(cond, k) if out is None else out.when(cond, k)
    return out


def fused(terms: Sequence[tuple[Column, float, Column]]) -> Column:
    """Mean of (value, weight, reliability) terms over those that are there, clipped to [0, 1]; null if none."""
    used = lambda v, w, r: F.when(v.isNotNull(), w * r).otherwise(0.0)
    total = sum((used(*t) for t in terms), F.lit(0.0))
    weighted = sum((F.coalesce(v, F.lit(0.0)) * used(v, w, r) for v, w, r in terms), F.lit(0.0))
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(weighted, total))))


def names_of(flags: dict[str, Column], sep: str = "+") -> Column:
    """The names of flags that hold, in order, joined."""
    return F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items()))), sep)


def evidence(residual: Column, scale: float = 15.0) -> Column:
    """exp(-residual / scale) of a residual of at least zero; null without one."""
    return F.when(residual.isNotNull(), F.exp(-F.greatest(residual, F.lit(0.0)) / scale))


def needed_sigma(sigma_z: Column, focal: Column, baseline: Column, depth: Column) -> Column:
    """Disparity noise that gives sigma_z at a depth."""
    return F.try_divide(sigma_z * focal * baseline, depth * depth)


def cycle_status(error: Column, recovered: Column, soft: float = 0.5, hard: float = 1.5, recovery: float = 3.0) -> Column:
    return first_rule(
        [(error <= soft, "cycle_valid"), (error <= hard, "cycle_soft"), (error > recovery, "cycle_failed"), (error.isNotNull() & recovered.isNull(), "cycle_recovery_required"), (recovered <= hard, "cycle_recovered")],
        "cycle_failed",
    )


def cycle_scale(error: Column, recovered: Column, soft: float = 0.5, hard: float = 1.5, recovery: float = 3.0) -> Column:
    between = 1.0 - 0.5 * (error - soft) / (hard - soft)
    return F.when(error <= soft, 1.0).when(error <= hard, between).when(error > recovery, 0.0).when(error.isNotNull() & recovered.isNull(), 0.5).when(recovered <= soft, 1.0).when(recovered <= hard, 0.6).otherwise(0.0)


def precision_decision(ratio: Column, feasible: Column, refinement: Column) -> Column:
    """Status of a measurement whose noise is `ratio` times what its target allows."""
    return first_rule(
        [(~feasible, "INFEASIBLE"), (ratio.isNull(), "UNAVAILABLE"), (ratio <= 1, "MET"), (refinement < F.when(ratio <= 2, 1).otherwise(2), "RETRY_STRONGER")],
        "VALID_BUT_PRECISION_UNMET",
    )


#: Fault kinds in the order in which their rules are tried, and each one's score and recovery action.
FAULTS = [
    ("TRACKING_LOSS", 0.95, "GLOBAL_REINITIALIZE"),
    ("CAMERA_MOTION", 0.95, "REFERENCE_MOTION_COMPENSATION"),
    ("EXTRINSIC_DRIFT", 0.90, "QUICK_EXTRINSIC_UPDATE"),
    ("STEREO_MISMATCH", 0.90, "LOCAL_REMATCH"),
    ("MOTION_BLUR", 0.80, "TEMPORAL_HOLD"),
    ("WEAK_TEXTURE", 0.75, "HISTORY_WEIGHTED_CONTEXT"),
    ("FLOW_DRIFT", 0.75, "REDETECT_FEATURES"),
    ("SEARCH_RANGE_FAILURE", 0.70, "EXPAND_SEARCH"),
    ("OCCLUSION", 0.65, "KALMAN_PREDICT"),
    ("NORMAL", 0.05, "NONE"),
]


def fault(c: dict[str, Column]) -> Column:
    """The first fault whose rule the residuals `c` fulfil; nulls fulfil none."""
    conditions = [
        c["tracking_loss"] > 0.8,
        (c["reference_motion"] > 1) & (c["common_motion"] > 0.7),
        F.coalesce(c["epipolar"] > 1, F.lit(False)) | F.coalesce(c["geometry"] > 0.6, F.lit(False)),
        (c["lr"] > 1) & (c["neighbor"] > 1) & (c["reference_motion"] < 1),
        (c["gradient"] < 0.25) & (c["blur"] < 0.4),
        c["gradient"] < 0.25,
        F.coalesce(c["flow"] > 1, F.lit(False)) | F.coalesce(c["fb"] > 1, F.lit(False)),
        (c["cost"] > 1) & (c["temporal"] < 1),
        c["physics"] > 0.7,
    ]
    return first_rule(list(zip(conditions, (f[0] for f in FAULTS), strict=False)), "NORMAL")


def toward(raw: Sequence[Column], goal: Sequence[Column], most: float) -> list[Column]:
    """Each coordinate of raw moved to the goal, at most so far in all."""
    d = F.sqrt(sum(((g - r) * (g - r) for r, g in zip(raw, goal, strict=True)), F.lit(0.0)))
    share = F.when(d > most, F.try_divide(F.lit(float(most)), d)).otherwise(1.0)
    return [r + (g - r) * share for r, g in zip(raw, goal, strict=True)]


def reprojected(q: Sequence[Sequence[float]], x: Column, y: Column, d: Column) -> list[Column]:
    """Q (x, y, d, 1) divided by its last part; null without a positive disparity or a last part."""
    rows = [sum((float(q[i][j]) * v for j, v in enumerate((x, y, d))), F.lit(float(q[i][3]))) for i in range(4)]
    fine = (d > 0) & (F.abs(rows[3]) > 1e-12)
    return [F.when(fine, F.try_divide(r, rows[3])) for r in rows[:3]]


def parabola_offset(left: Column, mid: Column, right: Column) -> Column:
    """Vertex of the parabola through three costs, in [-1, 1]; null where it is flat."""
    bend = left - 2 * mid + right
    return F.when(F.abs(bend) > 1e-12, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(0.5 * (left - right), bend))))


def hash_split(key: Column) -> Column:
    """development if the first byte of the key's SHA-256 is even, else holdout."""
    byte = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 2), 16, 10).cast("int")
    return F.when(byte % 2 == 0, "development").otherwise("holdout")
