"""Score intervals, order-statistic intervals and small curve formulas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialstats.rules import z_value


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wilson(k, n, alpha: float = 0.05) -> tuple[Column, Column]:
    """Wilson score limits; (0, 0) for an empty cell, clamped to [0, 1]."""
    z = z_value(alpha)
    k, n = _col(k).cast("double"), _col(n).cast("double")
    p = k / n
    z2 = z * z
    scale = F.lit(1.0) + F.lit(z2) / n
    centre = (p + F.lit(z2) / (F.lit(2.0) * n)) / scale
    half = (
        F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z2) / (F.lit(4.0) * n * n)) / scale
    )
    lo = F.when(n > 0, F.greatest(centre - half, F.lit(0.0))).otherwise(F.lit(0.0))
    hi = F.when(n > 0, F.least(centre + half, F.lit(1.0))).otherwise(F.lit(0.0))
    return lo, hi


def newcombe(k1, n1, k2, n2, alpha: float = 0.05) -> tuple[Column, Column]:
    """Hybrid score limits of p1 - p2; null when either side is empty."""
    k1, n1, k2, n2 = (_col(c).cast("double") for c in (k1, n1, k2, n2))
    l1, u1 = wilson(k1, n1, alpha)
    l2, u2 = wilson(k2, n2, alpha)
    p1, p2 = k1 / n1, k2 / n2
    both = (n1 > 0) & (n2 > 0)
    down = F.sqrt((p1 - l1) * (p1 - l1) + (u2 - p2) * (u2 - p2))
    up = F.sqrt((u1 - p1) * (u1 - p1) + (p2 - l2) * (p2 - l2))
    return F.when(both, p1 - p2 - down), F.when(both, p1 - p2 + up)


def tail_count(draws, alpha: float) -> Column:
    """How many draws lie outside each limit of the symmetric order-statistic interval."""
    draws = _col(draws)
    by_alpha = F.floor(draws * F.lit(alpha) / F.lit(2.0) + F.lit(1e-9))
    return F.least(by_alpha, F.floor((draws - 1) / 2)).cast("int")


def order_limits(values: Column, alpha: float) -> tuple[Column, Column]:
    """Limits from a sorted array of draws: (k+1)-th from each end, without interpolation.

    Infinite draws order normally; NaN sorts last in Spark and is refused.
    """
    size = F.size(values)
    k = tail_count(size, alpha)
    bad = F.when(
        (size > 0) & F.isnan(F.try_element_at(values, size)),
        F.raise_error(F.lit("NaN among the draws")).cast("double"),
    )
    lo = F.when(size > 0, F.coalesce(bad, F.try_element_at(values, k + 1)))
    hi = F.when(size > 0, F.coalesce(bad, F.try_element_at(values, size - k)))
    return lo, hi


def sorted_draws(value: Column) -> Column:
    """Aggregate: the non-null draws of one statistic, sorted. A group holds one resample count
    of draws (a rule value, not a property of the data), so the array is bounded."""
    return F.sort_array(F.collect_list(value))


def peak(b1, b2) -> Column:
    b1, b2 = _col(b1), _col(b2)
    return F.when(b2 < 0, F.lit(4.0) - b1 / (F.lit(2.0) * b2))


def peak_draw(ok, b1, b2) -> Column:
    """A draw without a peak counts as an infinity on the side the slope points to."""
    ok, b1, b2 = _col(ok), _col(b1), _col(b2)
    return (
        F.when(ok & (b2 < 0), F.lit(4.0) - b1 / (F.lit(2.0) * b2))
        .when(b1 > 0, F.lit(math.inf))
        .otherwise(F.lit(-math.inf))
    )


def drop_column(t, lo: int, hi: int) -> Column:
    """The column a drop is measured from: the peak rounded half up and clipped to the range."""
    t = _col(t)
    clipped = F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), t))
    return F.when(t.isNull(), F.lit(lo)).otherwise(F.floor(clipped + F.lit(0.5))).cast("int")


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def percent_half_up(rate) -> Column:
    return F.floor(_col(rate) * 100 + F.lit(0.5)).cast("int")
