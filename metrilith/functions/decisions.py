"""Acceptance, arbitration and search decisions as column expressions.

Unless a function says otherwise, a null condition doesn't hold and a null term takes no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrilith.functions.rules import first_rule, names_of


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def whole_triple(xyz: Sequence[Column]) -> Column:
    """A struct of three coordinates; null where one is missing."""
    there = xyz[0].isNotNull() & xyz[1].isNotNull() & xyz[2].isNotNull()
    return F.when(there, F.struct(*(c.alias(n) for c, n in zip(xyz, "xyz", strict=True))))


def first_stage(stages: dict[str, Sequence[Column]]) -> tuple[Column, Column]:
    """The first complete triple, and the name of its stage (UNAVAILABLE if none)."""
    triples = {n: whole_triple(c) for n, c in stages.items()}
    return F.coalesce(*triples.values()), first_rule([(t.isNotNull(), n) for n, t in triples.items()], "UNAVAILABLE")


def stage(df: DataFrame, name: str, known: Sequence[str] = ("measured", "estimated", "compensated", "final")) -> DataFrame:
    """Columns <name>_x, _y, _z as x, y, z. An unknown stage or one without columns is an error, never another stage."""
    if name not in known:
        raise ValueError(f"unknown stage {name}")
    missing = [f"{name}_{c}" for c in "xyz" if f"{name}_{c}" not in df.columns]
    if missing:
        raise ValueError(f"{name.upper()}_XYZ_UNAVAILABLE: {missing}")
    return df.select(*(c for c in df.columns if not c.startswith(tuple(f"{k}_" for k in known))), *(F.col(f"{name}_{c}").alias(c) for c in "xyz"))


def projected(p: Sequence[Sequence[float]], x: Column, y: Column, z: Column) -> list[Column]:
    """Image point of P (x, y, z, 1); null without a positive depth."""
    u, v, w = (float(r[0]) * x + float(r[1]) * y + float(r[2]) * z + float(r[3]) for r in p)
    return [F.when(w > 0, F.try_divide(c, w)) for c in (u, v)]


def euler_degrees(r: Sequence[Sequence[Column]]) -> list[Column]:
    """Angles about x, y and z of a rotation matrix."""
    return [F.degrees(F.atan2(r[2][1], r[2][2])), F.degrees(F.atan2(-r[2][0], F.hypot(r[0][0], r[1][0]))), F.degrees(F.atan2(r[1][0], r[0][0]))]


def turn_degrees(r: Sequence[Sequence[Column]]) -> Column:
    return F.degrees(F.acos(clip((r[0][0] + r[1][1] + r[2][2] - 1) / 2, -1, 1)))


def moved(r: Sequence[Sequence[Column]], t: Sequence[Column], p: Sequence[Column]) -> list[Column]:
    """R p + t."""
    return [sum((a * b for a, b in zip(row, p, strict=True)), s) for row, s in zip(r, t, strict=True)]


def confidence_state(mode: Column, score: Column, margin: Column, very_low: Column, high: float, medium: float, low: float, lost_after: int, least_margin: float = 0.1) -> Column:
    """HIGH, MEDIUM, LOW or LOST; two modes look at the margin alone, and one accepts everything."""
    by_margin = mode.isin("lr_only", "single_margin")
    return first_rule(
        [(mode == "none", "HIGH"), (by_margin & (margin >= least_margin), "HIGH"), (by_margin, "LOW"), (score >= high, "HIGH"), (score >= medium, "MEDIUM"), (score >= low, "LOW"), (very_low + 1 >= lost_after, "LOST")],
        "LOW",
    )


def weighted_mean(terms: Sequence[tuple[Column, float]]) -> Column:
    """Mean over the terms that are there, with their weights made to sum to one; null if none is."""
    total = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in terms), F.lit(0.0))
    return F.try_divide(sum((F.coalesce(v * w, F.lit(0.0)) for v, w in terms), F.lit(0.0)), F.when(total > 0, total))


def ratio_risk(x: Column, reference: float, most: float = 3.0) -> Column:
    return clip(F.abs(x) / max(reference, 1e-9), 0, most)


def inverse_risk(x: Column, reference: float, most: float = 3.0) -> Column:
    return clip(F.try_divide(F.lit(float(reference)), F.when(x.isNotNull(), F.greatest(x, F.lit(1e-9)))), 0, most)


def match_uncertainty(risks: Sequence[tuple[Column, float]], base: float, least: float, most: float) -> tuple[Column, Column]:
    """Variance and quality from risks with weights; the risk is zero where none is there."""
    risk = F.coalesce(weighted_mean(risks), F.lit(0.0))
    return clip(base * (1 + risk), least, most), 1 / (1 + risk)


def transient(residual: Column, flow: Column, visual: Column, spatial: Column, synchrony: Column, threshold: float = 10.0, normal: float = 0.6, abnormal: float = 0.35, ratio: float = 0.6) -> Column:
    """Why a fast change is protected, corrected or left; flow supports it, or visual evidence where flow is missing."""
    support = F.coalesce(flow, visual)
    return first_rule(
        [
            (residual.isNull() | F.isnan(residual) | (residual < 0), "temporal_residual_unavailable"),
            (residual < threshold, "not_a_fast_transient"),
            ((support >= normal) & (spatial >= normal) & (synchrony >= ratio), "supported_synchronous_motion"),
            ((support <= abnormal) & (spatial <= abnormal) & (synchrony < ratio), "isolated_multisource_measurement_error"),
        ],
        "insufficient_evidence_for_safe_correction",
    )


def recommendation(hard: Column, fault: Column, confidence: Column) -> tuple[Column, Column]:
    """Risk and action of a diagnosis."""
    kind = F.upper(F.trim(fault))
    calm = kind.isin("", "NORMAL") | kind.isNull()
    sure = F.coalesce(confidence, F.lit(0.0)) >= 0.8
    risk = first_rule([(hard, "BLOCKING"), (calm, "NORMAL"), (sure, "BLOCKING")], "WARNING")
    action = first_rule([(hard, "BLOCK_FINAL"), (calm, "NONE"), (sure, "BLOCK_FINAL"), (kind == "STEREO_MISMATCH", "ALLOW_CORRECTION")], "WARN")
    return risk, action


def safety_reasons(candidate: Column, geometry: Column, authorised: Column, evidence: Column, after: Column, state: Column) -> Column:
    """What speaks against a candidate, joined by +; empty if it is safe. A null flag counts as false."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return names_of({
        "candidate_not_finite": candidate.isNull(),
        "geometry_invalid": no(geometry),
        "correction_unauthorized": no(authorised),
        "evidence_insufficient": no(evidence),
        "post_correction_unsafe": no(after),
        "i2_state_disallows_candidate": no(state.isin("QUARANTINED", "RECOVERY")),
    })


def proposed(valid: Column, risk: Column, safe: Column, action: Column) -> Column:
    return first_rule(
        [(~valid, "REJECT"), (risk == "BLOCKING", "REJECT"), (safe & (action == "ALLOW_CORRECTION"), "USE_CORRECTED"), (risk == "WARNING", "ACCEPT_WITH_WARNING")],
        "ACCEPT",
    )


def committed(decision: Column, valid: Column, may_write: Column) -> Column:
    """What a proposal comes to under an authority that may or may not write."""
    return (
        F.when(may_write & decision.isin("USE_CORRECTED", "REJECT"), decision)
        .when(~valid, F.lit("REJECT"))
        .when(decision == "ACCEPT", decision)
        .otherwise(F.lit("ACCEPT_WITH_WARNING"))
    )


def adaptive_radius(quality: Column, fb: Column, residual: Column, confidence: Column, precision: Column, least: int, most: int, fb_ref: float = 1.0, residual_ref: float = 1.0, precision_ref: float = 0.1) -> tuple[Column, Column]:
    """Risk in [0, 1] and the radius it asks for, rounded half to even; a missing error is the full risk."""
    part = lambda x, ref: F.coalesce(clip(x / ref, 0, 2) / 2, F.lit(1.0))
    need = clip(precision_ref / F.greatest(precision, F.lit(1e-6)), 0, 3) / 3
    risk = clip(0.25 * (1 - clip(quality, 0, 1)) + 0.2 * part(fb, fb_ref) + 0.25 * part(residual, residual_ref) + 0.2 * (1 - clip(confidence, 0, 1)) + 0.1 * need, 0, 1)
    return risk, F.rint(least + risk * (most - least)).cast("int")


def search_reason(adaptive: Column, recovering: Column, speed: Column, residual: Column, most_speed: float) -> Column:
    slow = speed.isNull() | (F.abs(speed) <= 1)
    near = residual.isNull() | (residual <= 1)
    return first_rule(
        [(~adaptive, "fixed"), (recovering, "base_recovery"), (slow & near, "stable_prediction"), (F.abs(speed) > most_speed / 2, "high_motion"), (residual > 1, "prediction_error")],
        "normal",
    )


def visual_evidence(*residuals: Column) -> Column:
    """exp(-largest residual that is there); null if none is."""
    return F.exp(-F.greatest(*residuals))


def validity(depth: Column, motion: Column, least: float, most: float, most_motion: float) -> Column:
    """The first gate that a reprojected depth fails; a missing depth is ambiguous."""
    return first_rule([(depth.isNull(), "ambiguous"), (~depth.between(least, most), "depth_out_of_range"), (motion > most_motion, "motion_rejected")], "valid")


def precision_plan(target: Column, depth_mm: Column, focal: float, baseline_mm: float, sigma: Column, floor: Column) -> dict[str, Column]:
    """Needed disparity noise of a depth target, the depth noise there is, their ratio, and whether the target can be met."""
    square = depth_mm * depth_mm
    # at no depth any noise will do
    need = F.when((square == 0) & (target > 0), float("inf")).otherwise(F.try_divide(target * focal * baseline_mm, square))
    low = F.coalesce(floor, sigma)
    feasible = F.coalesce(low <= need, F.lit(False))
    reason = first_rule(
        [(target.isNull(), "z_target_unavailable_x_y_partial_not_controlling"), (feasible, "uncertainty_floor_within_target"), (low.isNotNull(), "required_sigma_d_below_uncertainty_floor")],
        "estimated_uncertainty_unavailable",
    )
    with_target = lambda c: F.when(target.isNotNull(), c)
    return {"need": need, "sigma_z": with_target(depth_mm * depth_mm * sigma / (focal * baseline_mm)), "ratio": F.try_divide(sigma, need), "feasible": feasible, "reason": reason, "axis": F.when(target.isNull(), "x_y_partial").otherwise("z")}
