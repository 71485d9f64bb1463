"""Second-moment statistics of a table in one pass (J9), and what follows from them (J11, J12, D11 for wide tables).

With Z = [features, 1, label] the matrix Z'Z holds everything a quadratic loss needs: n, X'X, X'y and y'y. It is
kept as one row-major array `zz` per group. Few features: plain sums in generated code. Many: every task adds up
its Arrow batches with a matrix product and emits one row per matrix row, which Spark sums. Statistics are
additive, so groups of any size are split freely. A null or NaN input makes the sums of its group NaN, which the
trainers report; check the table with `clean.validity` first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDE_FEATURES = 11  # 91 sums: the largest aggregate within the 100 fields Spark compiles as one stage
FLUSH_CELLS = 4_000_000  # matrix cells a task holds for its groups before it emits them
HELD_CELLS = 1_000_000  # input cells a task groups at a time
KERNEL_ROWS = 64  # rows a group must have on average for a matrix product of its own


def _doubles(columns: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in columns]


def _group_codes(columns: Sequence[pa.Array]) -> np.ndarray:
    """One integer per row that tells the groups apart; null is a value."""
    codes = np.zeros(len(columns[0]), dtype="int64")
    for c in columns:
        coded = c.dictionary_encode(null_encoding="encode")
        codes = codes * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
        if len(columns) > 1:
            codes = np.unique(codes, return_inverse=True)[1]
    return codes


def sum_blocks(df: DataFrame, groups: Sequence[str], columns: Sequence[str],
                kernel: Callable[[np.ndarray], np.ndarray], width: int, products: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Rows (group..., i, v): element-wise sums over all rows of `kernel(block)`, one matrix row per output row.

    `products` gives the matrix of every single row; it serves where groups have few rows in a task, which one call each
    would not pay for.
    """
    groups, columns = list(groups), list(columns)
    schema = T.StructType([*[df.schema[g] for g in groups], T.StructField("i", T.IntegerType()),
                           T.StructField("v", T.ArrayType(T.DoubleType()))])

    def numbers(batch: pa.RecordBatch) -> np.ndarray:
        return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])

    def made(keys: Sequence[pa.Array], firsts: np.ndarray, mats: np.ndarray) -> pa.RecordBatch:
        """Matrices, each with the group of the row at its place in `firsts`."""
        n, rows = mats.shape[:2]
        out = [k.take(pa.array(np.repeat(firsts, rows))) for k in keys]
        offsets = pa.array(np.arange(0, mats.size + 1, width, dtype="int32"))
        out += [pa.array(np.tile(np.arange(rows, dtype="int32"), n)), pa.ListArray.from_arrays(offsets, pa.array(mats.ravel()))]
        return pa.RecordBatch.from_arrays(out, names=[*groups, "i", "v"])

    def by_group(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = [batch.column(g) for g in groups]
        codes = _group_codes(keys)
        order = np.argsort(codes, kind="stable")
        block, starts = numbers(batch)[order], np.flatnonzero(np.diff(codes[order], prepend=-1))
        if products is None or len(block) >= KERNEL_ROWS * len(starts):
            held, first = [], 0
            for k, rows in enumerate(np.split(block, starts[1:])):
                held.append(kernel(rows))
                if len(held) * held[0].size > FLUSH_CELLS or k == len(starts) - 1:
                    yield made(keys, order[starts[first : k + 1]], np.stack(held))
                    held, first = [], k + 1
            return
        step = max(1, FLUSH_CELLS // 4 // products(block[:1]).size)
        for a in range(0, len(block), step):  # a group cut here gives two rows, which Spark adds up
            inside = starts[(starts > a) & (starts < a + step)]
            cuts = np.concatenate([[a], inside])
            yield made(keys, order[cuts], np.add.reduceat(products(block[a : a + step]), cuts - a, axis=0))

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not groups:
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = kernel(numbers(batch))
                    total = part if total is None else total + part
            if total is not None:
                yield made([], np.zeros(1, dtype="int64"), total[None])
            return
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size * len(columns) >= HELD_CELLS:
                yield from by_group(pa.concat_batches(held))
                held, size = [], 0
        if size:
            yield from by_group(pa.concat_batches(held))

    parts = df.select(*groups, *_doubles(columns)).mapInArrow(partials, schema)
    # NaN must survive the sum; Spark's sum of doubles keeps it.
    total = parts.groupBy(*groups, "i").agg(*[F.sum(F.col("v")[j]).alias(f"s{j}") for j in range(width)])
    return total.select(*groups, "i", F.array(*[F.col(f"s{j}") for j in range(width)]).alias("v"))


def gram_stats(df: DataFrame, features: Sequence[str], label: str, group_cols: Sequence[str] = (),
               weight: str | None = None, wide_features: int = WIDE_FEATURES) -> DataFrame:
    """One row (group..., zz) per group; zz is Z'Z of [features, 1, label], row-major."""
    features, groups = list(features), list(group_cols)
    d = len(features) + 2
    if weight:  # a row of unknown weight is left out, at any width
        df = df.filter(F.col(weight).isNotNull())
    if len(features) <= wide_features:
        z = [*[F.col(c) for c in features], F.lit(1.0), F.col(label)]
        w = F.col(weight) if weight else F.lit(1.0)
        rows = df.select(*groups, *_doubles([*features, label]), *([F.col(weight).cast("double").alias(weight)] if weight else []))
        cells = {(i, j): F.sum(w * z[i] * z[j]).alias(f"s_{i}_{j}") for i in range(d) for j in range(i, d)}
        sums = rows.groupBy(*groups).agg(*cells.values())
        full = F.array(*[F.col(f"s_{min(i, j)}_{max(i, j)}") for i in range(d) for j in range(d)])
        return sums.select(*groups, full.alias("zz"))

    def rows_of(block: np.ndarray) -> np.ndarray:
        return np.hstack([block[:, : d - 2], np.ones((len(block), 1)), block[:, d - 2 : d - 1]])

    def kernel(block: np.ndarray) -> np.ndarray:
        z = rows_of(block)
        return (z * block[:, d - 1 :]).T @ z if weight else z.T @ z

    def products(block: np.ndarray) -> np.ndarray:
        z = rows_of(block)
        return (z * block[:, d - 1 :] if weight else z)[:, :, None] * z[:, None, :]

    rows = sum_blocks(df, groups, [*features, label, *([weight] if weight else [])], kernel, d, products)
    ordered = F.sort_array(F.collect_list(F.struct("i", "v")))  # d rows per group
    return rows.groupBy(*groups).agg(F.flatten(F.transform(ordered, lambda r: r["v"])).alias("zz"))


def gram_cells(stats: DataFrame, names: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """Long form (group..., row, col, value) of the upper triangle; `names` lists the features."""
    z = [*names, "bias", "label"]
    d = len(z)
    cells = [F.struct(F.lit(z[i]).alias("row"), F.lit(z[j]).alias("col"), F.col("zz")[i * d + j].alias("value"))
             for i in range(d) for j in range(i, d)]
    return stats.select(*group_cols, F.explode(F.array(*cells)).alias("c")).select(*group_cols, "c.*")


def _map_stats(stats: DataFrame, group_cols: Sequence[str], fields: str, solve: Callable[[np.ndarray], dict]) -> DataFrame:
    groups = list(group_cols)
    schema = T.StructType([*[stats.schema[g] for g in groups], *T.StructType.fromDDL(fields).fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for zz in pdf["zz"]:
                m = np.asarray(zz, dtype=float)
                rows.append(solve(m.reshape(int(len(m) ** 0.5), -1)))
            yield pd.concat([pdf[groups].reset_index(drop=True), pd.DataFrame(rows, columns=schema.names[len(groups):])], axis=1)

    return stats.mapInPandas(run, schema)


def normal_equations(stats: DataFrame, group_cols: Sequence[str] = (), ridge: float = 0.0) -> DataFrame:
    """Least squares per group from the statistic; a singular system gets a 1e-10 diagonal.

    Rows (group..., n, weights with the bias last, loss, singular).
    """
    def solve(z: np.ndarray) -> dict:
        n, p = z[-2, -2], z.shape[0] - 1
        if not np.isfinite(z).all():
            return {"n": n, "weights": [float("nan")] * p, "loss": float("nan"), "singular": False}
        h, b = z[:p, :p] / n, z[:p, -1] / n
        h = h + ridge * np.diag([1.0] * (p - 1) + [0.0])
        singular = np.linalg.matrix_rank(h) < p
        w = np.linalg.solve(h + 1e-10 * np.eye(p), b) if singular else np.linalg.solve(h, b)
        loss = 0.5 * (w @ (z[:p, :p] / n) @ w - 2 * w @ b + z[-1, -1] / n) + 0.5 * ridge * w[:-1] @ w[:-1]
        return {"n": n, "weights": w.tolist(), "loss": max(float(loss), 0.0), "singular": bool(singular)}

    return _map_stats(stats, group_cols, "n double, weights array<double>, loss double, singular boolean", solve)


def conditioning(stats: DataFrame, group_cols: Sequence[str] = (), ridge: float = 0.0) -> DataFrame:
    """Eigenvalue range, condition number and definiteness of the Hessian X'X/n + ridge."""
    def solve(z: np.ndarray) -> dict:
        p = z.shape[0] - 1
        values = np.linalg.eigvalsh(z[:p, :p] / z[-2, -2] + ridge * np.diag([1.0] * (p - 1) + [0.0]))
        low, high = float(values[0]), float(values[-1])
        cond = high / low if low > 0 else float("inf")
        return {"n": z[-2, -2], "min_eigenvalue": low, "max_eigenvalue": high, "condition_number": cond,
                "positive_definite": bool(low > 1e-12 * max(high, 1.0))}

    return _map_stats(stats, group_cols, "n double, min_eigenvalue double, max_eigenvalue double, condition_number double, "
                      "positive_definite boolean", solve)


def pairwise_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r of all pairs over the rows where both are known, by masked matrix products (D11 beyond a few columns)."""
    columns = list(columns)
    d = len(columns)
    # A shift keeps the sums well scaled; a constant column becomes zeros, so that it does not vary by rounding either.
    number = lambda c: F.col(c).cast("double")
    centre = df.agg(*[F.when(F.min(number(c)) == F.max(number(c)), F.min(number(c))).otherwise(F.avg(number(c))).alias(c) for c in columns])
    shift = [float(v or 0.0) for v in centre.first()]

    def kernel(block: np.ndarray) -> np.ndarray:
        known = ~np.isnan(block)
        x, m = np.where(known, block - np.array(shift), 0.0), known.astype(float)
        return np.hstack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])

    rows = sum_blocks(df, [], columns, kernel, 4 * d)
    parts = [F.slice("v", k * d + 1, d) for k in range(4)]
    cells = rows.select("i", F.posexplode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("n", "s", "q", "p"))])).alias("j", "c"))
    a = cells.select("i", "j", "c.*")
    b = a.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("s").alias("s2"), F.col("q").alias("q2"))
    both = a.filter(F.col("i") < F.col("j")).join(b, ["i", "j"])  # one row per pair of columns
    spread = (F.col("n") * F.col("q") - F.col("s") * F.col("s")) * (F.col("n") * F.col("q2") - F.col("s2") * F.col("s2"))
    r = F.try_divide(F.col("n") * F.col("p") - F.col("s") * F.col("s2"), F.sqrt(F.when(spread > 0, spread)))
    names = F.array(*[F.lit(c) for c in columns])
    return both.select(names[F.col("i")].alias("column_1"), names[F.col("j")].alias("column_2"), r.alias("r"))


def poly_fit(df: DataFrame, x: str, y: str, degree: int, group_cols: Sequence[str] = ()) -> DataFrame:
    """Polynomial trend of y on x with R2 and RMSE, from one pass over the powers of x.

    Coefficients are in powers of x / max|x| so that high degrees stay well scaled; `scale` is that maximum.
    """
    scale = float(df.agg(F.max(F.abs(F.col(x).cast("double")))).first()[0] or 1.0)
    powers = [f"__p{k}" for k in range(1, degree + 1)]
    u = F.col(x).cast("double") / F.lit(scale)
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    stats = gram_stats(known.withColumns({n: F.pow(u, F.lit(float(k + 1))) for k, n in enumerate(powers)}), powers, y, group_cols)
    # Weights run from the first power up, the intercept is last.
    fit = normal_equations(stats, group_cols).withColumn("scale", F.lit(scale)).drop("singular")
    d = degree + 2
    zz = stats.select(*group_cols, F.col("zz")[d * d - 1].alias("yty"), F.col("zz")[(d - 2) * d + d - 1].alias("sy"))
    joined = fit.join(zz, list(group_cols)) if group_cols else fit.withColumns(
        {"yty": zz.select("yty").scalar(), "sy": zz.select("sy").scalar()})
    total = F.col("yty") / F.col("n") - F.pow(F.col("sy") / F.col("n"), F.lit(2.0))
    return joined.withColumns({"r2": F.when(total > 0, 1 - 2 * F.col("loss") / total), "rmse": F.sqrt(2 * F.col("loss"))}).drop("yty", "sy", "loss")
