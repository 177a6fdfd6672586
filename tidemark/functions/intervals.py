"""Interval expressions: overlap, ratios, clamps, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length of the common part, 0 if there is none."""
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0.0))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Strict overlap."""
    return (s1 < e2) & (s2 < e1)


def ratio_of_first(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap as a part of the first interval; 0 for an empty one."""
    return F.when(e1 - s1 > 0, overlap(s1, e1, s2, e2) / (e1 - s1)).otherwise(0.0)


def ratio_of_shorter(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap as a part of the shorter interval; 0 for an empty one."""
    short = F.least(e1 - s1, e2 - s2)
    return F.when(short > 0, overlap(s1, e1, s2, e2) / short).otherwise(0.0)


def pad(start: Column, end: Column, padding: float, duration: Column) -> tuple[Column, Column]:
    """Start and end moved out by a padding, within 0 and the duration."""
    return F.greatest(start - padding, F.lit(0.0)), F.least(end + padding, duration)


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def midpoint(start: Column, end: Column) -> Column:
    return (start + end) / 2


def hybrid_score(base: Column, boost: Column, weight: float) -> Column:
    """base * (1 + weight * boost), at most 1; a missing base is 0.5."""
    return F.least(F.coalesce(base, F.lit(0.5)) * (1 + weight * boost), F.lit(1.0))


def weighted(weights: list[float], scores: list[Column]) -> Column:
    """Sum of scores under weights that are brought to a sum of 1."""
    total = sum(weights)
    return sum((s * (w / total) for w, s in zip(weights[1:], scores[1:], strict=True)), scores[0] * (weights[0] / total))


def rounded(x: Column, places: int) -> Column:
    """Half-up to some places, as a decimal of nine places first: a half is a half whatever the last bit of a sum or mean
    says. What no such decimal holds (a billion or more, infinities, NaN) is rounded as it is."""
    return F.coalesce(F.round(x.try_cast("decimal(18,9)"), places).cast("double"), F.round(x, places))
