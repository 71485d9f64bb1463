"""Lasso and elastic net by coordinate descent along a path of penalties, one pass over the table.

One pass sums the statistics of the training rows and of the held-out rows for each group. Each group then descends its path
on an executor: warm starts, sweeps over the active coordinates, a duality gap as the rule to stop, and the loss of the
held-out rows, which chooses a penalty and may end the path early.

Objective: half mean square + regularization * (l1_ratio * |w| + (1 - l1_ratio) / 2 * w^2); the bias is free.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slopeworks.operators.gram import gram_stats

MAX_SWEEPS = 100_000
INNER_SWEEPS = 50  # sweeps over the active coordinates between two over all


class Centred:
    """Covariances of a table; the bias follows from the means."""

    def __init__(self, zz: np.ndarray):
        p = zz.shape[0] - 2
        self.n = float(zz[p, p])
        means = zz[p] / self.n
        self.mean, self.label_mean = means[:p], means[-1]
        self.h = zz[:p, :p] / self.n - np.outer(self.mean, self.mean)
        self.c = zz[:p, -1] / self.n - self.mean * self.label_mean
        self.q = float(zz[-1, -1] / self.n - self.label_mean**2)

    def bias(self, w: np.ndarray) -> float:
        return float(self.label_mean - self.mean @ w)


def duality_gap(s: Centred, w: np.ndarray, l1: float, l2: float) -> float:
    """How far the objective may lie above its minimum; needs l1 > 0."""
    hw = s.h @ w
    square = s.q - 2 * float(s.c @ w) + float(w @ hw)
    steepest = float(np.abs(s.c - hw - l2 * w).max(initial=0.0))
    scale = min(1.0, l1 / steepest) if steepest > 0 else 1.0
    augmented = square + l2 * float(w @ w)
    primal = 0.5 * augmented + l1 * float(np.abs(w).sum())
    return primal - (scale * (s.q - float(s.c @ w)) - 0.5 * scale * scale * augmented)


def descend(s: Centred, w: np.ndarray, l1: float, l2: float, tolerance: float) -> tuple[np.ndarray, float, int, bool]:
    """(weights, gap, sweeps, converged) from a start; a column that does not vary keeps no weight."""
    if not (np.isfinite(s.h).all() and np.isfinite(s.c).all() and np.isfinite(s.q)):
        return np.full(len(w), np.nan), np.nan, 0, False
    curve = np.diag(s.h) + l2
    usable = np.flatnonzero(np.diag(s.h) > 1e-12 * (np.abs(s.mean) ** 2 + 1e-300))
    w = w.copy()
    rest = s.c - s.h @ w

    def sweep(places: np.ndarray) -> float:
        nonlocal rest
        most = 0.0
        for j in places:
            pull = rest[j] + s.h[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - l1, 0.0) / curve[j]
            if new != w[j]:
                rest = rest - s.h[:, j] * (new - w[j])
                most, w[j] = max(most, abs(new - w[j]) * curve[j] ** 0.5), new
        return most

    limit, gap, sweeps = tolerance * max(s.q, 1e-300), np.inf, 0
    while sweeps < MAX_SWEEPS:
        moved = sweep(usable)
        sweeps += 1
        gap = max(0.0, duality_gap(s, w, l1, l2))
        if gap <= limit:
            return w, gap, sweeps, True
        if moved == 0.0:  # rounding lets it get no further
            return w, gap, sweeps, False
        active = usable[w[usable] != 0]
        for _ in range(INNER_SWEEPS):
            sweeps += 1
            if sweep(active) <= 0.1 * moved:
                break
        rest = s.c - s.h @ w  # no drift
    return w, gap, sweeps, False


def held_out_loss(zz: np.ndarray | None, weights: np.ndarray) -> float | None:
    """Half mean square of the rows of a statistic."""
    if zz is None:
        return None
    v = np.append(weights, -1.0)
    return float(v @ zz @ v) / float(zz[-2, -2]) / 2


def path(train: np.ndarray, held_out: np.ndarray | None, penalties: Sequence[float], l1_ratio: float, tolerance: float,
         patience: int | None) -> list[dict]:
    """One record for each penalty, largest first, until the held-out loss has not improved `patience` times in a row."""
    s, w, out, best = Centred(train), np.zeros(train.shape[0] - 2), [], None
    for lam in sorted(set(map(float, penalties)), reverse=True):
        w, gap, sweeps, converged = descend(s, w, lam * l1_ratio, lam * (1 - l1_ratio), tolerance)
        full = np.append(w, s.bias(w))
        loss = held_out_loss(held_out, full)
        out.append({"regularization": lam, "weights": full.tolist(), "n_active": int(np.count_nonzero(w)), "gap": gap, "sweeps": sweeps,
                    "converged": converged, "train_loss": held_out_loss(train, full), "held_out_loss": loss})
        if loss is not None and np.isfinite(loss) and (best is None or loss < out[best]["held_out_loss"]):
            best = len(out) - 1
        if patience is not None and best is not None and len(out) - 1 - best >= patience:
            break
    for k, record in enumerate(out):
        record["chosen"] = k == (best if held_out is not None else len(out) - 1)
    return out


def elastic_net_path(df: DataFrame, features: Sequence[str], label: str, penalties: Sequence[float], l1_ratio: float = 1.0,
                     held_out: Column | None = None, group_cols: Sequence[str] = (), tolerance: float = 1e-10,
                     patience: int | None = None) -> DataFrame:
    """Rows (group..., regularization, weights, n_active, gap, sweeps, converged, train_loss, held_out_loss, chosen).

    `held_out` tells the rows that only choose the penalty (null: training row). `tolerance` is the gap as a share of the
    variance of the label. Without held-out rows the smallest penalty is the chosen one and `patience` has no effect. A group
    without training rows has no result; unknown values give weights that are not converged.
    """
    if not 0 < l1_ratio <= 1 or not penalties or min(penalties) <= 0:
        raise ValueError("a gap needs an absolute penalty: l1_ratio in (0, 1] and penalties above 0")
    features, groups, fold = list(features), list(group_cols), "_held_out"
    while fold in df.columns:
        fold += "_"
    split = df.withColumn(fold, F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False))
    stats = gram_stats(split, features, label, [*groups, fold])
    pick = lambda wanted: F.max(F.when(F.col(fold) == wanted, F.struct("zz")))
    both = stats.groupBy(*groups).agg(pick(False)["zz"].alias("train"), pick(True)["zz"].alias("test")).filter("train[0] is not null")
    fields = ("regularization double, weights array<double>, n_active int, gap double, sweeps int, converged boolean, train_loss double, "
              "held_out_loss double, chosen boolean")
    schema = T.StructType([*[df.schema[g] for g in groups], *T.StructType.fromDDL(fields)])
    d = len(features) + 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.to_dict("records"):
                test = row["test"]
                records = path(np.array(row["train"], dtype=float).reshape(d, d), None if test is None else np.array(test, dtype=float).reshape(d, d),
                               penalties, l1_ratio, tolerance, patience)
                yield pd.DataFrame([{**{g: row[g] for g in groups}, **r} for r in records])[[f.name for f in schema]]

    return both.mapInPandas(run, schema)
