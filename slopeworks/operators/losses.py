"""Losses, gradients and Hessians of a linear model over a table (J1-J8, J13), as aggregates or from the statistic."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeworks.functions import constants as K
from slopeworks.functions.numeric import is_finite
from slopeworks.functions.vectors import unrolled_prediction


def penalty_value(w: np.ndarray, loss: str, lam: float, l1_ratio: float = 0.5) -> float:
    """Penalty of the non-bias weights."""
    if loss == "ridge":
        return 0.5 * lam * float(w @ w)
    if loss == "lasso":
        return lam * float(np.sqrt(w * w + K.LASSO_EPS).sum())
    if loss == "l1":
        return lam * float(np.abs(w).sum())
    if loss == "elastic_net":
        return lam * (l1_ratio * float(np.abs(w).sum()) + 0.5 * (1 - l1_ratio) * float(w @ w))
    return 0.0


def penalty_gradient(w: np.ndarray, loss: str, lam: float, l1_ratio: float = 0.5) -> np.ndarray:
    if loss == "ridge":
        return lam * w
    if loss == "lasso":
        return lam * w / np.sqrt(w * w + K.LASSO_EPS)
    if loss == "l1":
        return lam * np.sign(w)
    if loss == "elastic_net":
        return lam * (l1_ratio * np.sign(w) + (1 - l1_ratio) * w)
    return np.zeros_like(w)


def penalty_curvature(w: np.ndarray, loss: str, lam: float, l1_ratio: float = 0.5) -> np.ndarray:
    if loss == "ridge":
        return np.full_like(w, lam)
    if loss == "lasso":
        return lam * K.LASSO_EPS / (w * w + K.LASSO_EPS) ** 1.5
    if loss == "elastic_net":
        return np.full_like(w, lam * (1 - l1_ratio))
    return np.zeros_like(w)


@dataclass
class Quadratic:
    """Loss with a quadratic data term, from one statistic; the bias is the last weight and carries no penalty."""

    zz: np.ndarray
    loss: str = "ols"
    lam: float = 0.0
    l1_ratio: float = 0.5

    def __post_init__(self):
        self.n = float(self.zz[-2, -2])
        p = self.zz.shape[0] - 1
        self.h, self.b, self.c = self.zz[:p, :p] / self.n, self.zz[:p, -1] / self.n, self.zz[-1, -1] / self.n

    def value(self, w: np.ndarray) -> float:
        data = 0.5 * (w @ (self.h @ w) - 2 * (self.b @ w) + self.c)
        return float(data) + penalty_value(w[:-1], self.loss, self.lam, self.l1_ratio)

    def change(self, w: np.ndarray, d: np.ndarray, step: float) -> float:
        """value(w + step * d) - value(w), without cancelling two large numbers in the quadratic part."""
        data = step * float((self.h @ w - self.b) @ d) + 0.5 * step * step * float(d @ (self.h @ d))
        a, e = w[:-1], d[:-1]
        if self.loss == "ridge":
            return data + self.lam * (step * float(a @ e) + 0.5 * step * step * float(e @ e))
        moved = penalty_value(a + step * e, self.loss, self.lam, self.l1_ratio)
        return data + moved - penalty_value(a, self.loss, self.lam, self.l1_ratio)

    def gradient(self, w: np.ndarray) -> np.ndarray:
        g = self.h @ w - self.b
        g[:-1] += penalty_gradient(w[:-1], self.loss, self.lam, self.l1_ratio)
        return g

    def hessian(self, w: np.ndarray) -> np.ndarray:
        return self.h + np.diag(np.append(penalty_curvature(w[:-1], self.loss, self.lam, self.l1_ratio), 0.0))


def residual(features: Sequence[str], label: str, weights: Sequence[float]) -> Column:
    return unrolled_prediction(features, weights) - F.col(label).cast("double")


def data_loss(e: Column, loss: str = "ols", delta: float = 1.0) -> Column:
    """Aggregate of the data term over residuals: half mean square, or Huber."""
    if loss == "huber":
        return F.avg(F.when(F.abs(e) <= delta, 0.5 * e * e).otherwise(delta * (F.abs(e) - 0.5 * delta)))
    return F.avg(e * e) / 2


def loss_at(df: DataFrame, features: Sequence[str], label: str, weights: Sequence[float], loss: str = "ols",
            lam: float = 0.0, l1_ratio: float = 0.5, delta: float = 1.0) -> DataFrame:
    """One row (n, data_loss, penalty, loss) at the given weights."""
    pen = penalty_value(np.array(weights[:-1], dtype=float), loss, lam, l1_ratio)
    out = df.select(residual(features, label, weights).alias("e")).agg(
        F.count("e").alias("n"), data_loss(F.col("e"), loss, delta).alias("data_loss"))
    return out.withColumns({"penalty": F.lit(pen), "loss": F.col("data_loss") + F.lit(pen)})


def gradient_at(df: DataFrame, features: Sequence[str], label: str, weights: Sequence[float], loss: str = "ols",
                lam: float = 0.0, l1_ratio: float = 0.5, delta: float = 1.0) -> DataFrame:
    """Rows (feature, gradient), the bias under the name 'bias' (J6, J7); one aggregate over the table."""
    e = residual(features, label, weights)
    if loss == "huber":
        e = F.when(F.abs(e) <= delta, e).otherwise(delta * F.signum(e))
    pen = [*penalty_gradient(np.array(weights[:-1], dtype=float), loss, lam, l1_ratio), 0.0]
    names = [*features, "bias"]
    rows = df.select(e.alias("__e"), *[F.col(c).cast("double").alias(c) for c in features], F.lit(1.0).alias("bias"))
    row = rows.agg(*[F.avg(F.col("__e") * F.col(c)).alias(c) for c in names])
    cells = [F.struct(F.lit(c).alias("feature"), (F.col(c) + F.lit(float(p))).alias("gradient")) for c, p in zip(names, pen)]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def hessian_cells(stats: DataFrame, features: Sequence[str], weights: Sequence[float] | None = None, loss: str = "ols",
                  lam: float = 0.0, l1_ratio: float = 0.5) -> DataFrame:
    """Upper triangle (row, col, value) of the Hessian from the statistic."""
    names = [*features, "bias"]
    d = len(names) + 1
    w = np.array(weights if weights is not None else [0.0] * len(names), dtype=float)
    diagonal = [*penalty_curvature(w[:-1], loss, lam, l1_ratio), 0.0]
    n = F.col("zz")[(d - 2) * d + d - 2]
    cells = [F.struct(F.lit(names[i]).alias("row"), F.lit(names[j]).alias("col"),
                      (F.col("zz")[i * d + j] / n + F.lit(float(diagonal[i]) if i == j else 0.0)).alias("value"))
             for i in range(d - 1) for j in range(i, d - 1)]
    return stats.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def numerical_issues(history: DataFrame) -> DataFrame:
    """Rows of a training history with a NaN or infinite loss or gradient norm, and which it was."""
    def issue(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.when(F.isnan(v), F.lit(f"NaN in {c}")).when(~is_finite(v), F.lit(f"Inf in {c}"))
    found = F.concat_ws("; ", issue("gradient_norm"), issue("loss"))
    return history.withColumn("issue", found).filter(F.col("issue") != "")
