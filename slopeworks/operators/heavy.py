"""Heavy hitters: the most frequent values of columns, exact, without a shuffle that grows with the number of distinct values.

First scan: each task keeps a Misra-Gries summary of 64-bit hashes for each column, at most twice `capacity` counters at a time.
Merged by hash, the summaries give every value a lower bound of its count, and an upper one that is higher by what the tasks
shed. Second scan: the few values whose upper bound reaches the k-th lower bound are counted exactly. The answer stands if its
last count exceeds the bound of everything that was left out; otherwise all values are counted. Hashes only choose what is
counted, so two values of one hash cannot spoil a result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 1024


@dataclass(frozen=True)
class Candidates:
    """Hashes worth an exact count, and how often a value of any other hash can occur at most."""

    keys: tuple[int, ...]
    bound: int
    hopeless: bool  # no count of these values could exceed the bound


def hash_key(df: DataFrame, column: str) -> Column:
    """64-bit hash, null for null; zeros of both signs and all NaNs are one value each, as in a grouping."""
    x = F.col(column)
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        x = F.when(F.isnan(x), F.lit(float("nan"))).otherwise(x + F.lit(0.0))
    return F.when(F.col(column).isNotNull(), F.xxhash64(x))


def shed(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keeps at most `capacity` counters by taking the next largest count from all; returns what was taken.

    Each unit taken comes from more than `capacity` counters, so all that is ever taken is below rows / capacity.
    """
    if len(keys) <= capacity:
        return keys, counts, 0
    place = len(counts) - capacity - 1
    cut = int(np.partition(counts, place)[place])
    stay = counts > cut
    return keys[stay], counts[stay] - cut, cut


def add_counts(keys: np.ndarray, counts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new, times = np.unique(values, return_counts=True)
    merged, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
    total = np.zeros(len(merged), dtype=np.int64)
    np.add.at(total, place, np.concatenate([counts, times]))
    return merged, total


def summaries(df: DataFrame, columns: Sequence[str], capacity: int = CAPACITY) -> DataFrame:
    """(place, key, n, lost, n_rows): counters of each task for the column at each place; one row with a null key has what was
    shed and the number of known values."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    width = len(columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = ([np.zeros(0, dtype=np.int64) for _ in range(width)] for _ in range(2))
        lost, seen = [0] * width, [0] * width
        for batch in batches:
            for i in range(width):
                values = batch.column(i).drop_null().to_numpy()
                seen[i] += len(values)
                keys[i], counts[i] = add_counts(keys[i], counts[i], values)
                if len(keys[i]) > 2 * capacity:
                    keys[i], counts[i], cut = shed(keys[i], counts[i], capacity)
                    lost[i] += cut
        for i in range(width):
            k, c, cut = shed(keys[i], counts[i], capacity)
            zeros = np.zeros(len(k), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(k) + 1, i, dtype=np.int32)), pa.array([*k.tolist(), None], pa.int64()), pa.array(np.append(c, 0)),
                pa.array(np.append(zeros, lost[i] + cut)), pa.array(np.append(zeros, seen[i]))], names=["place", "key", "n", "lost", "n_rows"])

    hashed = df.select(*[hash_key(df, c).alias(f"h{i}") for i, c in enumerate(columns)])
    return hashed.mapInArrow(count, "place int, key long, n long, lost long, n_rows long")


def candidates(df: DataFrame, columns: Sequence[str], k: int, capacity: int = CAPACITY) -> dict[str, Candidates]:
    """What has to be counted to know the k most frequent values of each column; one scan.

    At most `capacity` counters a column reach the driver: all of them if there are no more, else those of at least
    rows / capacity.
    """
    merged = summaries(df, columns, capacity).groupBy("place", "key").agg(*[F.sum(c).alias(c) for c in ("n", "lost", "n_rows")]).persist()
    try:
        totals = {r["place"]: r for r in merged.groupBy("place").agg(
            F.sum("lost").alias("lost"), F.sum("n_rows").alias("n_rows"), F.count("key").alias("n_keys")).collect()}  # one row a column
        least = {i: 0 if r["n_keys"] <= capacity else -(-r["n_rows"] // capacity) for i, r in totals.items()}
        floors = F.coalesce(*[F.when(F.col("place") == i, F.lit(v)) for i, v in least.items()]) if least else F.lit(0)
        kept: dict[int, list] = {i: [] for i in range(len(columns))}
        for r in merged.filter(F.col("key").isNotNull() & (F.col("n") >= floors)).select("place", "key", "n").collect():
            kept[r["place"]].append((r["n"], r["key"]))
    finally:
        merged.unpersist()
    out = {}
    for i, c in enumerate(columns):
        lost, floor = (totals[i]["lost"], least[i]) if i in totals else (0, 0)
        ranked = sorted(kept[i], reverse=True)
        last = ranked[k - 1][0] if len(ranked) >= k else 0
        chosen = [key for n, key in ranked if n + lost >= last]
        left_out = max(ranked[len(chosen)][0] if len(chosen) < len(ranked) else 0, max(floor - 1, 0))
        bound = lost + left_out
        hopeless = bound > 0 and (len(ranked) < k or last + lost <= bound)
        out[c] = Candidates(tuple(chosen), bound, hopeless)
    return out


def is_proven(counts: Sequence[int], k: int, bound: int) -> bool:
    """Whether exact counts, in falling order, leave no room for a value that was not counted."""
    return bound == 0 or (len(counts) >= k and counts[k - 1] > bound)


def top_values(df: DataFrame, columns: Sequence[str], k: int, capacity: int = CAPACITY) -> dict[str, list[tuple[object, int]]]:
    """The k most frequent known values of each column with their counts, the smallest first on ties. Columns are of one type.

    A column without known values has an empty list. At most k rows a column reach the driver.
    """
    columns = list(columns)
    found = candidates(df, columns, k, capacity) if columns else {}
    out: dict[str, list[tuple[object, int]]] = {}
    hopeful = [c for c in columns if not found[c].hopeless]
    if hopeful:
        # One row for each candidate is left after the partial step, so ranking a column is a small task.
        slim = df.select(*[F.when(hash_key(df, c).isin(list(found[c].keys)), F.col(c)).alias(c) for c in hopeful])
        counts = slim.unpivot([], hopeful, "column", "value").filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
        place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
        got: dict[str, list] = {c: [] for c in hopeful}
        for r in counts.withColumn("place", place).filter(F.col("place") <= k).orderBy("column", "place").collect():
            got[r["column"]].append((r["value"], r["n"]))
        out = {c: v for c, v in got.items() if is_proven([n for _, n in v], k, found[c].bound)}
    for c in columns:
        if c not in out:
            every = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
            out[c] = [(r["value"], r["n"]) for r in every.orderBy(F.desc("n"), "value").limit(k).collect()]
    return out
