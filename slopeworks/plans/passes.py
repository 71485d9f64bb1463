"""Training with one job per iteration over the table (pass mode): Huber, very wide tables, and checks of the statistic.

Each job evaluates loss and gradient at several trial points at once, so a line search costs no extra pass.
Only (d+1)-sized sums come back to the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from slopeworks.operators.gram import sum_blocks
from slopeworks.operators.losses import penalty_gradient, penalty_value
from slopeworks.operators.ranking import HASH_SPACE
from slopeworks.plans.steps import lbfgs_direction, stop_reason

TRIALS = 6


class PassMeter:
    """What data passes read and hand on, counted by Spark while they run.

    Rows that are read again after an executor is lost are counted again: they are work done.
    """

    SCHEMA = "pass int, points int, rows_read long, partial_rows long, multiplications long, seconds double"

    def __init__(self):
        self.rows: list[tuple] = []
        self._read = self._made = None
        self._started = 0.0

    def reads(self, df: DataFrame) -> DataFrame:
        self._read, self._started = Observation(), time.perf_counter()
        return df.observe(self._read, F.count(F.lit(1)).alias("n"))

    def makes(self, df: DataFrame) -> DataFrame:
        self._made = Observation()
        return df.observe(self._made, F.count(F.lit(1)).alias("n"))

    def close(self, points: int, multiplications_a_row: int) -> None:
        """Ends a pass whose job is done."""
        read = self._read.get["n"]
        self.rows.append((len(self.rows), points, read, self._made.get["n"], read * multiplications_a_row, time.perf_counter() - self._started))

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, self.SCHEMA)


def measured_sizes(df: DataFrame, shares: Sequence[float], hashed: Column,
                   train: Callable[[DataFrame, PassMeter], object]) -> DataFrame:
    """One training on each share of the rows (the smallest hashes), with what its passes did: a row per share."""
    out = None
    for share in shares:
        meter = PassMeter()
        train(df.filter(hashed < int(share * HASH_SPACE)), meter)
        done = meter.frame(df.sparkSession).agg(
            F.max("rows_read").alias("n"), F.count("*").alias("passes"), F.sum("rows_read").alias("rows_read"), F.sum("partial_rows").alias("partial_rows"),
            F.sum("multiplications").alias("multiplications"), F.sum("seconds").alias("seconds")).withColumn("share", F.lit(float(share)))
        out = done if out is None else out.unionByName(done)
    return out


def evaluate_points(df: DataFrame, features: Sequence[str], label: str, points: Sequence[np.ndarray], loss: str = "ols",
                    delta: float = 1.0, meter: PassMeter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Data loss and gradient at each point, from one pass: (k,), (k, d+1)."""
    w, features = np.column_stack(points), list(features)

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, p = w.shape[1], w.shape[0]
        acc, n = np.zeros((k, p + 1)), 0
        for batch in batches:
            z = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            x = np.hstack([z[:, :-1], np.ones((len(z), 1))])
            e = x @ w - z[:, -1:]
            if loss == "huber":
                a = np.abs(e)
                values, e = np.where(a <= delta, 0.5 * e * e, delta * (a - 0.5 * delta)), np.clip(e, -delta, delta)
            else:
                values = 0.5 * e * e
            acc += np.column_stack([values.sum(axis=0), e.T @ x])
            n += len(z)
        if n:
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(k), "int32"), "n": pa.array([n] * k, "int64"),
                                              "v": pa.array(acc.tolist(), pa.list_(pa.float64()))})

    nan = F.lit(float("nan"))
    cols = [F.coalesce(F.col(c).cast("double"), nan).alias(c) for c in [*features, label]]
    source = df.select(*cols)
    parts = (meter.reads(source) if meter else source).mapInArrow(partials, "k int, n long, v array<double>")
    if meter:
        parts = meter.makes(parts)
    width = w.shape[0] + 1
    sums = parts.groupBy("k").agg(F.sum("n").alias("n"), *[F.sum(F.col("v")[j]).alias(f"s{j}") for j in range(width)])
    rows = sorted(sums.collect(), key=lambda r: r["k"])  # one row per trial point
    if not rows:
        raise ValueError("no rows to train on")
    if meter:
        meter.close(w.shape[1], 2 * w.size)
    total = np.array([[r[f"s{j}"] for j in range(width)] for r in rows]) / rows[0]["n"]
    return total[:, 0], total[:, 1:]


def fit_by_passes(df: DataFrame, features: Sequence[str], label: str, loss: str = "huber", delta: float = 1.0,
                  method: str = "lbfgs", regularization: float = 0.0, penalty: str = "ridge", l1_ratio: float = 0.5,
                  learning_rate: float = 1.0, memory: int = 10, max_iter: int = 50, tolerance: float = 1e-6,
                  c1: float = 1e-4, meter: PassMeter | None = None) -> tuple[DataFrame, DataFrame]:
    """(model row, history rows). `method` is `lbfgs` with backtracking or `gd` with a constant step.

    A `meter` gets the measured cost of every pass.
    """
    if method not in ("lbfgs", "gd"):
        raise ValueError(f"unknown method {method!r}")
    table = df.select(*features, label).persist(StorageLevel.MEMORY_AND_DISK)
    pen = penalty if regularization else "none"
    p = len(features) + 1

    def full(points):
        losses, grads = evaluate_points(table, features, label, points, loss, delta, meter)
        for i, w in enumerate(points):
            losses[i] += penalty_value(w[:-1], pen, regularization, l1_ratio)
            grads[i, :-1] += penalty_gradient(w[:-1], pen, regularization, l1_ratio)
        return losses, grads

    try:
        w, pairs, history, step, passes = np.zeros(p), [], [], 0.0, 1
        losses, grads = full([w])
        value, g, change = losses[0], grads[0], None
        for t in range(max_iter + 1):
            gnorm = float(np.linalg.norm(g))
            history.append((t, float(value), gnorm, float(step)))
            stopped, converged, reason = stop_reason(gnorm, float(value), change, t, tolerance, max_iter, w)
            if stopped:
                break
            d = lbfgs_direction(g, pairs) if method == "lbfgs" else -g
            d = d if g @ d < 0 else -g
            first = learning_rate if method == "gd" or pairs else min(1.0, learning_rate / max(gnorm, 1e-12))
            steps = [first * 0.5 ** i for i in range(TRIALS)] if method == "lbfgs" else [first]
            while True:  # halves on, a few trials in each pass, until a step descends enough or is lost in rounding
                losses, grads = full([w + a * d for a in steps])
                passes += 1
                fits = [i for i, a in enumerate(steps) if losses[i] <= value + c1 * a * (g @ d)] if method == "lbfgs" else [0]
                if fits or steps[-1] * float(np.abs(d).max()) < 1e-16 * max(1.0, float(np.abs(w).max())):
                    break
                steps = [a * 0.5 ** TRIALS for a in steps]
            if not fits:
                converged, reason = False, "no step descends"
                break
            i = fits[0]
            step, new = steps[i], w + steps[i] * d
            sv, y = new - w, grads[i] - g
            if sv @ y > 1e-14:
                pairs = (pairs + [(sv, y)])[-memory:]
            change, value, w, g = float(losses[i] - value), losses[i], new, grads[i]
    finally:
        table.unpersist()
    spark = df.sparkSession
    model = spark.createDataFrame(
        [(f"{method}_{loss}", w.tolist(), bool(converged), reason, t, float(value), gnorm, passes)],
        "setup string, weights array<double>, converged boolean, reason string, final_iteration int, final_loss double, "
        "final_gradient_norm double, data_passes int")
    return model, spark.createDataFrame(history, "iteration int, loss double, gradient_norm double, step_size double")


def huber_points(df: DataFrame, features: Sequence[str], label: str, points: Sequence[np.ndarray], delta: float) -> list[tuple]:
    """(loss, gradient, curvature of the inliers, curvature of a parabola above the loss) at each point, from one pass."""
    p = len(features) + 1

    def kernel(block: np.ndarray) -> np.ndarray:
        x, y = np.hstack([block[:, :-1], np.ones((len(block), 1))]), block[:, -1]
        rows = [np.append(np.zeros(p), len(block))[None, :]]
        for w in points:
            e = x @ w - y
            a = np.abs(e)
            loss = np.where(a <= delta, 0.5 * e * e, delta * (a - 0.5 * delta)).sum()
            inside = (x * (a <= delta)[:, None]).T @ x
            above = (x * (delta / np.maximum(a, delta))[:, None]).T @ x
            rows += [np.append(np.clip(e, -delta, delta) @ x, loss)[None, :], np.hstack([np.vstack([inside, above]), np.zeros((2 * p, 1))])]
        return np.vstack(rows)

    sums = {r["i"]: r["v"] for r in sum_blocks(df, [], [*features, label], kernel, p + 1).collect()}  # 2p + 1 rows a point
    if not sums:
        raise ValueError("no rows to train on")
    m = np.array([sums[i] for i in range(len(sums))])
    n, out = m[0, -1], []
    for k in range(len(points)):
        at = 1 + k * (2 * p + 1)
        out.append((float(m[at, -1] / n), m[at, :p] / n, m[at + 1 : at + 1 + p, :p] / n, m[at + 1 + p : at + 1 + 2 * p, :p] / n))
    return out


def fit_huber_newton(df: DataFrame, features: Sequence[str], label: str, delta: float = 1.0, regularization: float = 0.0,
                     max_iter: int = 100, tolerance: float = 1e-10) -> tuple[DataFrame, DataFrame]:
    """(model row, history rows) of Huber regression with a ridge penalty by semismooth Newton, one pass an iteration.

    Each pass tries two full steps: Newton's, on the curvature of the rows inside `delta`, and one to the minimum of a
    weighted parabola that lies above the loss. The second never climbs, so the better of the two needs no line search; the
    first ends the descent in a few steps once the inliers are known.
    """
    features = list(features)
    table = df.select(*features, label).persist(StorageLevel.MEMORY_AND_DISK)
    p = len(features) + 1
    ridge = np.diag(np.append(np.full(p - 1, regularization), 0.0))

    def evaluate(points: list[np.ndarray]) -> list[tuple]:
        return [(w, v + 0.5 * float(w @ ridge @ w), g + ridge @ w, inside + ridge, above + ridge)
                for w, (v, g, inside, above) in zip(points, huber_points(table, features, label, points, delta))]

    def step(w: np.ndarray, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        return w - np.linalg.lstsq(h, g, rcond=1e-13)[0]

    try:
        (w, value, g, inside, above), passes, history, still, reason = evaluate([np.zeros(p)])[0], 1, [], 0, "iteration limit"
        for t in range(max_iter + 1):
            gnorm = float(np.linalg.norm(g))
            history.append((t, value, gnorm))
            converged = gnorm < tolerance
            if not (np.isfinite(value) and np.isfinite(gnorm)):
                reason = "NaN or Inf in loss or gradient"
            elif converged:
                reason = "gradient norm below tolerance"
            elif still >= 3:
                reason = "no further progress"
            if reason != "iteration limit" or t == max_iter:
                break
            tried = evaluate([step(w, inside, g), step(w, above, g)])
            passes += 1
            # Losses that differ by rounding only are told apart by their gradients.
            least = min(x[1] for x in tried)
            w, new, g, inside, above = min((x for x in tried if x[1] <= least + 1e-14 * max(1.0, abs(least))), key=lambda x: float(np.linalg.norm(x[2])))
            still = still + 1 if abs(new - value) <= 1e-15 * max(1.0, abs(value)) else 0
            value = new
    finally:
        table.unpersist()
    spark = df.sparkSession
    model = spark.createDataFrame([(w.tolist(), bool(converged), reason, t, value, gnorm, passes)],
                                  "weights array<double>, converged boolean, reason string, final_iteration int, final_loss double, "
                                  "final_gradient_norm double, data_passes int")
    return model, spark.createDataFrame(history, "iteration int, loss double, gradient_norm double")
