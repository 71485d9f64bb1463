"""Mini-batch SGD over a table.

`exact`: for OLS and ridge one batch update is an affine map of the state (weights, velocity), and maps compose.
Row chunks turn into one composed map each, in parallel; maps are then multiplied in order, level by level, so an
epoch over any number of rows ends in one small matrix. The result is that of the sequential algorithm.

`averaged`: for step rules that are not affine (unit-length steps, L1 signs). Blocks of rows, fixed by the hash of the
key, run SGD on their own rows from the same start, and the row-weighted mean starts the next epoch. Averaged weights are
not those of one sequential run, unless there is one block. The number of blocks is a parameter and never follows from the
size of the table; a task reads its block as a sorted stream, so a block may have any number of rows.

`stored_sgd` has the sequential run of those rules, and epochs that do not sort rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeworks.operators.gram import gram_stats
from slopeworks.operators.losses import Quadratic, penalty_gradient
from slopeworks.operators.ranking import HASH_SPACE, hash_row_number, key_hash
from slopeworks.plans.steps import stop_reason

CHUNK_ROWS = 50_000
FAN_IN = 128
BLOCKS = 1  # of averaged SGD where the caller names no number: the sequential run, whatever the size of the table


@dataclass(frozen=True)
class SgdSetup:
    setup: str = "sgd"
    loss: str = "ols"  # ols ridge; sequential and averaged also l1
    learning_rate: float = 0.01
    schedule: str = "constant"  # constant linear exponential sqrt step_down
    epochs: int = 100
    batch_size: int = 32
    momentum: float = 0.0
    regularization: float = 0.0
    step_length: float = 0.0  # > 0: every update has this length
    order: str = "each_epoch"  # once each_epoch bootstrap
    decay_rate: float = 0.95
    decay_steps: float = 10.0
    tolerance: float = 1e-6
    seed: int = 42


def epoch_rate(s: SgdSetup, epoch: int) -> float:
    """Learning rate of an epoch."""
    lr = s.learning_rate
    if s.schedule == "linear":
        return lr * max(1.0 - epoch / max(s.epochs, 1), 0.01)
    if s.schedule == "exponential":
        return lr * s.decay_rate ** (epoch / s.decay_steps)
    if s.schedule == "sqrt":
        return lr / (epoch + 1) ** 0.5
    if s.schedule == "step_down":
        return lr * 0.9 ** (epoch // 10)
    if s.schedule != "constant":
        raise ValueError(f"unknown schedule {s.schedule!r}")
    return lr


def poisson_numbers(u: np.ndarray) -> np.ndarray:
    """`poisson_weight` of an array, inside a task."""
    terms = np.array([math.exp(-1.0) / math.factorial(k) for k in range(20)])
    return np.searchsorted(np.cumsum(terms), u, side="right").astype(float)


def poisson_weight(u: Column) -> Column:
    """Poisson(1) count from a uniform number: the bootstrap weight of a row."""
    cumulative, term, out = 0.0, math.exp(-1.0), None
    for k in range(20):  # the rest is below the precision of a double
        cumulative += term
        out = F.when(u < cumulative, F.lit(float(k))) if out is None else out.when(u < cumulative, F.lit(float(k)))
        term /= k + 1
    return out.otherwise(F.lit(20.0))


def _hash_of(key: str, seed: int, hashed, epoch: int) -> Column:
    """The place of a row in the order of an epoch; `hashed` may be a column (one order for all) or a function of the epoch."""
    if hashed is None:
        return key_hash(key, seed)
    return hashed if isinstance(hashed, Column) else hashed(epoch)


def _ordered(df: DataFrame, key: str, s: SgdSetup, epoch: int, n: int, hashed: Column | None) -> DataFrame:
    """Rows with their batch, place in the shuffled order of the epoch, and weight."""
    seed = s.seed + (epoch if s.order != "once" else 0)
    ranked = hash_row_number(df, key, _hash_of(key, seed, hashed, epoch if s.order != "once" else 0), "__rank", n)
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit("bootstrap")), F.lit(HASH_SPACE)) / F.lit(float(HASH_SPACE))
    weight = poisson_weight(u) if s.order == "bootstrap" else F.lit(1.0)
    return ranked.withColumns({"__w": weight, "__batch": F.floor(F.col("__rank") / s.batch_size).cast("long")})


def _batches(pdf: pd.DataFrame, features: list[str], label: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(H, b) of each batch of a chunk, in order."""
    pdf = pdf.sort_values("__rank")
    x = np.hstack([pdf[features].to_numpy(float), np.ones((len(pdf), 1))])
    y, w, batch = pdf[label].to_numpy(float), pdf["__w"].to_numpy(float), pdf["__batch"].to_numpy()
    cuts = np.flatnonzero(np.diff(batch)) + 1
    for xs, ys, ws in zip(np.split(x, cuts), np.split(y, cuts), np.split(w, cuts)):
        total = ws.sum()
        if total > 0:
            yield (xs * ws[:, None]).T @ xs / total, xs.T @ (ws * ys) / total


def batch_map(h: np.ndarray, b: np.ndarray, lr: float, mu: float, lam: float) -> np.ndarray:
    """Affine map of (weights, velocity, 1) for one update; without momentum the velocity is left out."""
    p = len(b)
    eye = np.eye(p)
    g = h + lam * np.diag([1.0] * (p - 1) + [0.0])
    if not mu:
        m = np.eye(p + 1)
        m[:p, :p], m[:p, -1] = eye - lr * g, lr * b
        return m
    m = np.zeros((2 * p + 1, 2 * p + 1))
    m[:p, :p], m[:p, p:2 * p], m[:p, -1] = eye - lr * g, -lr * mu * eye, lr * b
    m[p:2 * p, :p], m[p:2 * p, p:2 * p], m[p:2 * p, -1] = g, mu * eye, -b
    m[-1, -1] = 1.0
    return m


def epoch_maps(df: DataFrame, features: Sequence[str], label: str, key: str, s: SgdSetup, epoch: int, rates: Sequence[float],
               n: int, hashed: Column | None = None, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Rows (i, m): the composed map of a whole epoch for each learning rate."""
    features, rates = list(features), [float(r) for r in rates]
    per_chunk = max(1, chunk_rows // s.batch_size)
    mu, lam = s.momentum, s.regularization if s.loss == "ridge" else 0.0
    width = (len(features) + 1) * (2 if mu else 1) + 1
    rows = _ordered(df, key, s, epoch, n, hashed).select(
        *[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias(label), "__w", "__rank", "__batch",
        F.floor(F.col("__batch") / per_chunk).cast("long").alias("chunk"))

    def compose_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [np.eye(width) for _ in rates]
        for h, b in _batches(pdf, features, label):
            out = [batch_map(h, b, lr, mu, lam) @ m for lr, m in zip(rates, out)]
        return pd.DataFrame({"chunk": int(pdf["chunk"].iloc[0]), "i": range(len(rates)), "m": [m.ravel().tolist() for m in out]})

    def compose_maps(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.eye(width)
        for m in pdf.sort_values("below")["m"]:
            total = np.asarray(m).reshape(width, width) @ total
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "i": [int(pdf["i"].iloc[0])], "m": [total.ravel().tolist()]})

    def from_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for chunk, zz in zip(pdf["__batch"], pdf["zz"]):
                m = np.asarray(zz, dtype=float).reshape(len(features) + 2, -1)
                if m[-2, -2] > 0:
                    h, b = m[:-1, :-1] / m[-2, -2], m[:-1, -1] / m[-2, -2]
                    yield pd.DataFrame({"chunk": chunk, "i": range(len(rates)), "m": [batch_map(h, b, lr, mu, lam).ravel().tolist() for lr in rates]})

    schema = "chunk long, i int, m array<double>"
    if s.batch_size > chunk_rows:  # a batch is more than a task should hold: its sums come from partial aggregates
        maps = gram_stats(rows, features, label, ["__batch"], "__w").mapInPandas(from_sums, schema)
    else:
        maps = rows.groupBy("chunk").applyInPandas(compose_rows, schema)
    chunks = math.ceil(math.ceil(n / s.batch_size) / per_chunk)
    while chunks > 1:
        above = maps.select(F.col("chunk").alias("below"), F.floor(F.col("chunk") / fan_in).cast("long").alias("chunk"), "i", "m")
        maps = above.groupBy("chunk", "i").applyInPandas(compose_maps, schema)
        chunks = math.ceil(chunks / fan_in)
    return maps.select("i", "m")


def _stats(df: DataFrame, features, label) -> np.ndarray:
    zz = np.array(gram_stats(df, features, label).first()["zz"])
    return zz.reshape(len(features) + 2, -1)


def _finish(spark, s: SgdSetup, mode: str, w, best, history, converged, reason) -> tuple[DataFrame, DataFrame]:
    last = history[-1]
    model = spark.createDataFrame(
        [(s.setup, mode, best[3].tolist(), w.tolist(), bool(converged), reason, last[0], last[1], last[2], best[0], best[1], best[2])],
        "setup string, mode string, weights array<double>, last_weights array<double>, converged boolean, reason string, "
        "final_epoch int, final_loss double, final_gradient_norm double, best_epoch int, best_loss double, best_gradient_norm double")
    return model, spark.createDataFrame(history, "epoch int, loss double, gradient_norm double, learning_rate double")


def fit_sgd(df: DataFrame, features: Sequence[str], label: str, key: str, s: SgdSetup, mode: str = "exact",
            hashed: Column | None = None, chunk_rows: int = CHUNK_ROWS, blocks: int = BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(model row, history rows). Losses after each epoch come from the statistic of the whole table, not from a pass."""
    features = list(features)
    affine = s.loss in ("ols", "ridge") and not s.step_length
    if mode == "exact" and not affine:
        raise ValueError("exact mode needs OLS or ridge without unit-length steps; use averaged")
    table = df.select(key, *features, label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        zz = _stats(table, features, label)
        n = int(zz[-2, -2])
        maps = {}
        if mode == "exact" and s.order == "once":
            rates = sorted({epoch_rate(s, e) for e in range(s.epochs)})
            rows = epoch_maps(table, features, label, key, s, 0, rates, n, hashed, chunk_rows).collect()  # one matrix per rate
            maps = {rates[r["i"]]: r["m"] for r in rows}

        def epoch_step(epoch: int, lr: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if mode == "averaged":
                return _averaged_epoch(table, features, label, key, s, epoch, lr, w, v, hashed, blocks)
            if mode != "exact":
                raise ValueError(f"unknown mode {mode!r}")
            m = maps[lr] if s.order == "once" else epoch_maps(table, features, label, key, s, epoch, [lr], n, hashed, chunk_rows).first()["m"]
            return apply_map(m, w, v, s)

        return run_epochs(df.sparkSession, s, mode, zz, epoch_step)
    finally:
        table.unpersist()


def apply_map(m, w: np.ndarray, v: np.ndarray, s: SgdSetup) -> tuple[np.ndarray, np.ndarray]:
    """The state after the updates that a composed map stands for."""
    p = len(w)
    state = np.concatenate([w, v, [1.0]] if s.momentum else [w, [1.0]])
    state = np.asarray(m, dtype=float).reshape(len(state), -1) @ state
    return state[:p], state[p:2 * p] if s.momentum else v


def run_epochs(spark, s: SgdSetup, mode: str, zz: np.ndarray,
               epoch_step: Callable[[int, float, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[DataFrame, DataFrame]:
    """Epochs until a stop rule holds: (model row, history rows). `epoch_step` takes (epoch, rate, weights, velocity)."""
    q = Quadratic(zz, "l1" if s.loss == "l1" else s.loss, s.regularization)
    w, v = np.zeros(len(q.b)), np.zeros(len(q.b))
    history, best, converged, reason = [], None, False, "epoch limit"
    for epoch in range(s.epochs):
        lr = epoch_rate(s, epoch)
        w, v = epoch_step(epoch, lr, w, v)
        loss, gnorm = q.value(w), float(np.linalg.norm(q.gradient(w)))
        change = history[-1][1] - loss if history else None
        history.append((epoch + 1, loss, gnorm, lr))
        if np.isfinite(gnorm) and (best is None or gnorm < best[2]):
            best = (epoch + 1, loss, gnorm, w.copy())
        stopped, converged, reason = stop_reason(gnorm, loss, change, epoch, s.tolerance, s.epochs, w)
        if not stopped and len(history) >= 5 and loss > 2 * history[-5][1]:
            stopped, reason = True, "loss doubled within five epochs"
        if stopped:
            break
        reason = "epoch limit"
    return _finish(spark, s, mode, w, best or (history[-1][0], loss, gnorm, w), history, converged, reason)


def update(w, v, g, s: SgdSetup, lr: float):
    """One update with momentum and, if asked for, a fixed length."""
    v = s.momentum * v + g
    if s.step_length:
        norm = np.linalg.norm(v)
        return (w - s.step_length * v / norm if norm > 1e-10 else w), v
    return w - lr * v, v


def batch_gradient(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray, s: SgdSetup) -> np.ndarray:
    """Mean gradient of a batch with row weights; the last weight is the bias and has no penalty."""
    g = x.T @ (weight * (x @ w - y)) / weight.sum()
    g[:-1] += penalty_gradient(w[:-1], s.loss, s.regularization)
    return g


def _averaged_epoch(table: DataFrame, features, label, key: str, s: SgdSetup, epoch: int, lr, w, v, hashed=None, blocks: int = BLOCKS):
    """Every block of rows runs the epoch on its own and the weights are averaged by rows.

    A key's block, its place in the order and its bootstrap weight come from hashes of the key, so that the result does not
    depend on partitions or batches of the transport.
    """
    names = [*features, label]
    seed = s.seed + (epoch if s.order != "once" else 0)
    place = _hash_of(key, seed, hashed, epoch if s.order != "once" else 0)
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit("bootstrap")), F.lit(HASH_SPACE)) / F.lit(float(HASH_SPACE))
    rows = table.select(*[F.col(c).cast("double").alias(c) for c in names], F.col(key).alias("__key"), place.alias("__h"),
                        (poisson_weight(u) if s.order == "bootstrap" else F.lit(1.0)).alias("__w"),
                        F.pmod(F.xxhash64(F.col(key), F.lit("block")), F.lit(blocks)).alias("__block"))

    def steps(a, m, pdf: pd.DataFrame):
        x, y = np.hstack([pdf[features].to_numpy(float), np.ones((len(pdf), 1))]), pdf[label].to_numpy(float)
        weight = pdf["__w"].to_numpy(float)
        for i in range(0, len(pdf), s.batch_size):
            xs, ys, ws = x[i:i + s.batch_size], y[i:i + s.batch_size], weight[i:i + s.batch_size]
            if ws.sum() > 0:
                a, m = update(a, m, batch_gradient(xs, ys, ws, a, s), s, lr)
        return a, m

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, a, m, count, rest = None, w, v, 0, None

        def end() -> pd.DataFrame:
            state = np.concatenate(steps(a, m, rest))
            return pd.DataFrame({"n": [count], "s": [(state * count).tolist()]})

        for pdf in frames:
            for one, part in pdf.groupby("__block", sort=False):
                if one != block:
                    if block is not None:
                        yield end()
                    block, a, m, count, rest = one, w.copy(), v.copy(), 0, part[:0]
                count += len(part)
                part = pd.concat([rest, part]) if len(rest) else part
                whole = len(part) // s.batch_size * s.batch_size  # the rest waits for the rows that come next
                a, m = steps(a, m, part[:whole])
                rest = part[whole:]
        if block is not None:
            yield end()

    ordered = rows.repartition(blocks, "__block").sortWithinPartitions("__block", "__h", "__key")
    parts = ordered.mapInPandas(run, "n long, s array<double>")
    p = len(w)
    row = parts.agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(2 * p)]).first()
    mean = np.array([row[f"s{j}"] for j in range(2 * p)]) / row["n"]
    return mean[:p], mean[p:]
