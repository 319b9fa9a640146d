"""Column functions on arrays of doubles and on test statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def distance(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def pearson(a: Column | str, b: Column | str, size: Column | int) -> Column:
    """Correlation of two z-scored arrays (population standard deviation) of `size` elements."""
    return dot(a, b) / size


def pearson_from_distance(dist: Column, size: Column | int) -> Column:
    return 1 - dist * dist / (2 * F.lit(size) if isinstance(size, int) else 2 * size)


def distance_from_pearson(p: Column, size: Column | int) -> Column:
    return F.sqrt(2 * (F.lit(size) if isinstance(size, int) else size) * (1 - p))


def zscore(raw: Column) -> Column:
    """Population z-scores; null for a constant or empty array."""

    def scaled(mean: Column) -> Column:
        spread = F.sqrt(total(F.transform(raw, lambda x: (x - mean) * (x - mean))) / F.size(raw))
        return F.element_at(F.transform(F.array(spread), lambda s: F.when(s > 0, F.transform(raw, lambda x: (x - mean) / s))), 1)

    return F.when(F.size(raw) > 0, F.element_at(F.transform(F.array(total(raw) / F.size(raw)), scaled), 1))


def projection(z: Column | str, dims: list[int], coefficients: list[float], unit: bool = False) -> Column:
    """Weighted sum of chosen elements (0-based). With unit, scaled to a norm of 1, so it is a 1-Lipschitz key."""
    scale = sum(c * c for c in coefficients) ** 0.5 if unit else 1.0
    return sum((F.element_at(z, d + 1) * (c / scale) for d, c in zip(dims, coefficients, strict=True)), F.lit(0.0))


def signed_plane_distance(value: Column, split: Column | float, coefficients: list[float]) -> Column:
    """How far a point with this projection lies from the plane of points with projection `split`; negative below it."""
    return (value - split) / sum(c * c for c in coefficients) ** 0.5


def distance_to_box(point: Column, low: Column, high: Column) -> Column:
    """0 inside the box."""
    outside = F.zip_with(F.zip_with(point, low, lambda p, a: a - p), F.zip_with(point, high, lambda p, b: p - b), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.sqrt(total(F.transform(outside, lambda d: d * d)))


def box_in_ball(low: Column, high: Column, center: Column, radius: Column) -> Column:
    """Whether the box's farthest corner is within the radius."""
    far = F.zip_with(F.zip_with(center, low, lambda c, a: F.abs(c - a)), F.zip_with(center, high, lambda c, b: F.abs(c - b)), lambda x, y: F.greatest(x, y))
    return F.sqrt(total(F.transform(far, lambda d: d * d))) <= radius


def weighted_ks(d: Column, n1: Column, n2: Column) -> Column:
    return d / F.sqrt((n1 + n2) / (n1 * n2))


def ks_pvalue(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic p with the Stephens correction, clipped to [0, 1]; 1 where the series would not converge."""
    en = F.sqrt(n1 * n2 / (n1 + n2))
    x = (en + 0.12 + F.lit(0.11) / en) * d
    term = lambda k: F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(-2.0 * k * k * x * x)
    p = total(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: term(k.cast("double"))))
    return F.when(x < 0.18, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))
