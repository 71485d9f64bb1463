"""Functions on array<double> columns: bias, dot product, weight statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def feature_array(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def with_bias(features: Column) -> Column:
    """Features followed by a constant 1.0."""
    return F.concat(features, F.array(F.lit(1.0)))


def dot(features: Column, weights: Column) -> Column:
    """Inner product of two arrays of the same length; null when lengths differ."""
    products = F.zip_with(features, weights, lambda x, w: x * w)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def linear_prediction(features: Column, weights: Column) -> Column:
    """Xw + b with the bias as the last weight (L1)."""
    head = F.slice(weights, F.lit(1), F.size(weights) - 1)
    return dot(features, head) + F.element_at(weights, -1)


def unrolled_prediction(columns: Sequence[str], weights: Sequence[float]) -> Column:
    """The same as a plain column sum, which stays inside generated code."""
    if len(weights) != len(columns) + 1:
        raise ValueError(f"{len(columns)} columns need {len(columns) + 1} weights, got {len(weights)}")
    out = F.lit(float(weights[-1]))
    for c, w in zip(columns, weights):
        out = out + F.col(c).cast("double") * F.lit(float(w))
    return out


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def weight_stats(weights: Column) -> Column:
    """Struct of size, min, max, mean and population std of the non-bias weights, and the bias."""
    w = F.slice(weights, F.lit(1), F.size(weights) - 1)
    n = F.size(w)
    mean = F.try_divide(array_sum(w), n)
    spread = array_sum(F.transform(w, lambda x: (x - mean) * (x - mean)))
    return F.struct(
        n.cast("long").alias("n_features"), F.array_min(w).alias("min_weight"), F.array_max(w).alias("max_weight"),
        mean.alias("mean_weight"), F.sqrt(F.try_divide(spread, n)).alias("std_weight"),
        F.element_at(weights, -1).alias("bias"),
    )


def sparsify(weights: Column, threshold: float = 1e-3) -> Column:
    """Small weights become exactly zero."""
    return F.transform(weights, lambda w: F.when(F.abs(w) < threshold, 0.0).otherwise(w))


def standardise(features: Column, means: Sequence[float], stds: Sequence[float], floor: float = 1e-8) -> Column:
    """(x - mean) / max(std, floor) with stored statistics; a length mismatch raises."""
    if len(means) != len(stds):
        raise ValueError("means and stds differ in length")
    checked = F.when(F.size(features) == len(means), features).otherwise(
        F.raise_error(F.lit(f"expected {len(means)} features")).cast("array<double>"))
    shifts = F.array(*[F.lit(float(m)) for m in means])
    scales = F.array(*[F.lit(max(float(s), floor)) for s in stds])
    centred = F.zip_with(checked, shifts, lambda x, m: x - m)
    return F.zip_with(centred, scales, lambda x, s: x / s)
