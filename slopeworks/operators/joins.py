"""Lookups against a side whose size is checked: broadcast within a bound, salted shuffle join beyond it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
SALTS = 64
ROWS_PER_TASK = 4_000_000


def within(df: DataFrame, rows: int) -> bool:
    """Whether a frame, which should be persisted or a scan, has at most `rows` rows."""
    return df.count() <= rows


def lookup_join(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left",
                weight: str | None = None, bound: int = BROADCAST_ROWS, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Equi-join with a table that has one row per key.

    A table within `bound` rows is broadcast. A larger one is shuffled; a key of which `weight` (rows per key) shows
    more than `rows_per_task` is spread over as many salts as it needs, with its table row copied once per salt, and
    null keys are spread too.
    """
    keys = list(keys)
    table = table.persist()
    if within(table, bound):
        return df.join(F.broadcast(table), keys, how)
    if weight is None:
        return df.join(table, keys, how)
    needed = F.greatest(F.ceil(F.col(weight) / rows_per_task), F.lit(1)).cast("int")
    hot = table.filter(F.col(weight) > rows_per_task).select(*[F.col(k).alias(f"__hot_{k}") for k in keys], needed.alias("__salts"))
    if not within(hot, bound):  # as many keys of that size spread by themselves
        return df.join(table, keys, how)
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__hot_{k}") for k in keys])
    unknown = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    known = df.join(F.broadcast(hot), same, "left").drop(*[f"__hot_{k}" for k in keys])
    # The partition number is the same when a task is run again, so a retry salts its rows alike.
    salt = F.pmod(F.spark_partition_id(), F.when(unknown, SALTS).otherwise(F.coalesce("__salts", F.lit(1))))
    left = known.withColumn("__salt", salt.cast("int")).drop("__salts")
    right = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), needed - 1)))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def salted_join(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str, hot_keys: Sequence[tuple],
                salts: int = SALTS) -> DataFrame:
    """Left or inner equi-join in which the listed keys are spread over `salts` partitions."""
    keys = list(keys)

    def is_hot(values):
        return reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in zip(keys, values)])

    hot = reduce(lambda a, b: a | b, [is_hot(v) for v in hot_keys], F.lit(False))
    unknown = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    # The partition number is the same when a task is run again, so a retry salts its rows alike.
    salt = F.when(unknown | hot, F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(F.lit(0))
    left = df.withColumn("__salt", salt.cast("int"))
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = table.withColumn("__salt", F.explode(copies))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
