"""Numeric functions: flags, bins, finite tests, corrected moments."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    """0/1, and 0 where the condition is unknown."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def right_closed_bin(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of (edge[i], edge[i+1]]; null at or below the first edge and for null (H7)."""
    out = F.when(c <= F.lit(edges[0]), F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        # NaN compares above every number, so it must not fall into an open last bin.
        out = out.when((c <= F.lit(float(upper))) & ~F.isnan(c.cast("double")), F.lit(label))
    return out


def ordered_code(c: Column, labels: Sequence[str]) -> Column:
    """Position of a label in its fixed order, null for an unlisted one (H8)."""
    return reduce(lambda acc, iv: acc.when(c == F.lit(iv[1]), F.lit(iv[0])), enumerate(labels), F.when(c.isNull(), None))


def is_finite(c: Column) -> Column:
    """False for NaN and both infinities, null for null."""
    return ~(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))


def finite_or(c: Column, value: float) -> Column:
    return F.when(is_finite(c), c).otherwise(F.lit(float(value)))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness; Spark's own is the population value."""
    n = F.count(c).cast("double")
    scale = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when(n > 2, F.skewness(c) * scale)


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis."""
    n = F.count(c).cast("double")
    return F.when(n > 3, F.try_divide(((n + 1) * F.kurtosis(c) + 6) * (n - 1), (n - 2) * (n - 3)))


def normal_quantiles(probs: Sequence[float]) -> list[float]:
    from statistics import NormalDist

    return [NormalDist().inv_cdf(p) for p in probs]
