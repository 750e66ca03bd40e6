"""Cleaning of text cells: what can't be used is null, and no NaN gets past here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_double(x: Column) -> Column:
    """A finite number, or null for blanks, junk, NaN and infinities."""
    v = F.trim(x.cast("string")).try_cast("double")
    return F.when(F.abs(v) < float("inf"), v)


def frame_or_all(x: Column) -> Column:
    """An integer frame; -1 ("every frame") for what isn't written as an integer."""
    s = F.trim(x.cast("string"))
    return F.coalesce(F.when(s.rlike(r"\A[+-]?[0-9]+\z"), s.try_cast("int")), F.lit(-1))


def truncated_int(x: Column) -> Column:
    """An integer by way of a number, cut towards zero."""
    return clean_double(x).try_cast("int")


def flag(x: Column) -> Column:
    """1, true or yes, in any case; everything else is false."""
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("1", "true", "yes"), F.lit(False))


def first_usable(*xs: Column) -> Column:
    return F.coalesce(*(clean_double(x) for x in xs))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, null unless whole is positive."""
    return F.when(whole > 0, 100.0 * F.try_divide(part, whole))
