"""Seeded splits, samples and batches that depend on row keys, not on row order."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeworks.operators.ranking import HASH_SPACE, hash_row_number, key_hash, smallest_by_hash


def split_exact(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, hashed: Column | None = None,
                n_rows: int | None = None, rounding: str = "ceil") -> DataFrame:
    """Adds `split` with exactly ceil(n * test_size) test rows, or int(n * test_size)."""
    n_rows = df.count() if n_rows is None else n_rows
    take = math.ceil(n_rows * test_size - 1e-9) if rounding == "ceil" else int(n_rows * test_size)
    test = smallest_by_hash(df, key, key_hash(key, seed) if hashed is None else hashed, take)
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def split_by_hash(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, hashed: Column | None = None) -> DataFrame:
    """Adds `split` by a hash threshold: no job, share right up to chance."""
    h = key_hash(key, seed) if hashed is None else hashed
    return df.withColumn("split", F.when(h < int(HASH_SPACE * test_size), "test").otherwise("train"))


def sample_exact(df: DataFrame, key: str, size: int, seed: int = 42, hashed: Column | None = None) -> DataFrame:
    """Exactly `size` rows (or all) without replacement."""
    return df.filter(smallest_by_hash(df, key, key_hash(key, seed) if hashed is None else hashed, size))


def sample_stratified(df: DataFrame, stratum: str, fractions: dict, key: str, seed: int = 42,
                      hashed: Column | None = None) -> DataFrame:
    """Rows kept per stratum with the given share, decided by the key hash alone."""
    h = key_hash(key, seed) if hashed is None else hashed
    bound = F.lit(0)
    for value, share in fractions.items():
        bound = F.when(F.col(stratum) == F.lit(value), F.lit(int(HASH_SPACE * share))).otherwise(bound)
    return df.filter(h < bound)


def sample_quality(source: DataFrame, sample: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and std of each column in the source and in the sample."""
    def one(df: DataFrame, which: str) -> DataFrame:
        row = df.agg(*[a for c in columns for a in (F.avg(c).alias(f"m__{c}"), F.stddev_samp(c).alias(f"s__{c}"))],
                     F.count(F.lit(1)).alias("n"))
        cells = [F.struct(F.lit(c).alias("column"), F.col(f"`m__{c}`").alias("mean"), F.col(f"`s__{c}`").alias("std")) for c in columns]
        return row.select(F.lit(which).alias("rows_of"), "n", F.explode(F.array(*cells)).alias("x")).select("rows_of", "n", "x.*")
    return one(source, "source").unionByName(one(sample, "sample"))


def with_batches(df: DataFrame, key: str, batch_size: int = 32, seed: int = 42, hashed: Column | None = None,
                 n_rows: int | None = None) -> DataFrame:
    """Adds `batch_id`: consecutive batches of the shuffled row order."""
    h = key_hash(key, seed) if hashed is None else hashed
    ranked = hash_row_number(df, key, h, "__rank", n_rows)
    return ranked.withColumn("batch_id", F.floor(F.col("__rank") / batch_size).cast("long")).drop("__rank")
