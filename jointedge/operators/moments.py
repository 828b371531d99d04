"""Correlation algebra over sums. Counts and sums of integers are exact and add up over seasons, so every statistic is a formula
over a few sums: no built-in correlation, which fails on groups without variance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: Column) -> Column:
    return x.cast("double")


def clamp(r: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))


def phi(n: Column, n1: Column, n2: Column, n11: Column) -> Column:
    """Correlation of two 0/1 events from their counts (or weighted counts); null without variance."""
    n, n1, n2, n11 = map(_d, (n, n1, n2, n11))
    spread = (n1 > 0) & (n1 < n) & (n2 > 0) & (n2 < n)
    return F.when(spread, clamp((n * n11 - n1 * n2) / F.sqrt((n1 * (n - n1)) * (n2 * (n - n2)))))


def pearson(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    """Pearson correlation from sums; null under two rows or without variance."""
    n, x, y, xx, yy, xy = map(_d, (n, x, y, xx, yy, xy))
    vx, vy = n * xx - x * x, n * yy - y * y
    return F.when((n > 1) & (vx > 0) & (vy > 0), clamp((n * xy - x * y) / F.sqrt(vx * vy)))


def weighted_pearson(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    """``pearson`` from weighted sums, whose weight may be below two; a spread of under a billionth of the squares is rounding and none."""
    n, x, y, xx, yy, xy = map(_d, (n, x, y, xx, yy, xy))
    vx, vy = n * xx - x * x, n * yy - y * y
    spread = (n > 0) & (vx > n * xx * 1e-9) & (vy > n * yy * 1e-9)
    return F.when(spread, clamp((n * xy - x * y) / F.sqrt(vx * vy)))


def pair_sums(x: Column, y: Column, prefix: str = "", weight: Column | None = None) -> list[Column]:
    """Aggregates n, x, y, xx, yy, xy over rows where both values are there (and the weight is positive)."""
    ok = x.isNotNull() & y.isNotNull()
    if weight is not None:
        ok = ok & (weight > 0) & ~F.isnan(weight)
    w = F.lit(1) if weight is None else weight
    parts = {"n": F.lit(1), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}
    return [F.sum(F.when(ok, w * v)).alias(prefix + k) for k, v in parts.items()]


def rounded_ratio(numerator: Column, denominator: Column, unit: int, factor: int = 1) -> Column:
    """factor * numerator / denominator to 1/unit, half up, in whole numbers (both sides must not be negative)."""
    top, bottom = numerator.cast("long") * (2 * unit * factor) + denominator.cast("long"), denominator.cast("long") * 2
    return F.when(denominator > 0, F.floor(F.try_divide(top - F.pmod(top, bottom), bottom)).cast("long") / float(unit))


def percent(hits: Column, n: Column) -> Column:
    """Share of hits in percent with one decimal."""
    return rounded_ratio(hits, n, 10, 100)


def dot(names: list[Column], weights: list[Column]) -> Column:
    """w0 n0 + w1 n1 + ... in this order (float sums depend on it); nulls count as zero."""
    out = F.lit(0.0)
    for n, w in zip(names, weights):
        out = out + F.coalesce(_d(n), F.lit(0.0)) * w
    return out
