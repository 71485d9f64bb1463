"""Category encoders fitted on the training rows, applied to any rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopeworks.functions import constants as K
from slopeworks.functions.text import normal_name
from slopeworks.operators.joins import lookup_join
from slopeworks.operators.profile import categorical_summary, string_columns

MAX_LEVELS = 10_000


def target_means(df: DataFrame, key: str, target: str) -> DataFrame:
    """Rows (key, n, mean_target)."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(target).alias("n"), F.avg(target).alias("mean_target"))


def fit_target_encoding(df: DataFrame, key: str, target: str, smoothing: int = K.TARGET_SMOOTHING) -> tuple[DataFrame, float]:
    """Smoothed mean per key and the global mean, which also serves unseen keys."""
    overall = df.agg(F.avg(target)).first()[0]
    smooth = (F.col("mean_target") * F.col("n") + F.lit(overall) * smoothing) / (F.col("n") + smoothing)
    table = target_means(df, key, target).filter(F.col("n") > 0)
    return table.select(key, "n", smooth.alias(f"{key}_target_encoded")), overall


def apply_target_encoding(df: DataFrame, key: str, table: DataFrame, overall: float) -> DataFrame:
    """Left lookup; a key without a mean gets the global mean."""
    name = f"{key}_target_encoded"
    out = lookup_join(df, table, [key], "left", weight="n")
    return out.withColumn(name, F.coalesce(name, F.lit(overall))).drop("n")


def levels_of(df: DataFrame, column: str, max_levels: int = MAX_LEVELS) -> list[str]:
    """Sorted distinct known values; more than `max_levels` is an error, not a silent cut."""
    rows = (df.select(F.col(column).cast("string").alias("v")).filter(F.col("v").isNotNull()).distinct()
            .limit(max_levels + 1).collect())
    if len(rows) > max_levels:
        raise ValueError(f"{column} has more than {max_levels} levels; use target encoding")
    return sorted(r["v"] for r in rows)


def label_code(column: str, levels: Sequence[str]) -> Column:
    """Alphabetical code from 0; null for unknown levels."""
    codes = F.create_map(*[x for i, v in enumerate(levels) for x in (F.lit(v), F.lit(i))]) if levels else None
    return codes[F.col(column).cast("string")] if codes is not None else F.lit(None).cast("int")


def label_encode(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Code column from the levels of the frame itself, of any number; the levels are numbered and looked up as a table."""
    name = name or f"{column}_label_encoded"
    level = F.col(column).cast("string").alias("__level")
    counts = df.select(level).filter(F.col("__level").isNotNull()).groupBy("__level").agg(F.count("*").alias("__n"))
    codes = ordered_codes(counts, "__level", name)
    return lookup_join(df.withColumn("__level", level), codes, ["__level"], "left", weight="__n").drop("__level", "__n")


def ordered_codes(levels: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the place of each row in the order of a column of distinct values, from range partitions and their sizes."""
    parts = int(levels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = levels.repartitionByRange(parts, column).withColumn("__b", F.spark_partition_id()).persist()
    sizes = placed.groupBy("__b").agg(F.count("*").alias("__m"))
    offsets = sizes.select("__b", (F.sum("__m").over(Window.orderBy("__b")) - F.col("__m")).alias("__o"))  # one row for each partition
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(column)) - 1
    numbered = placed.withColumn("__r", inside).join(F.broadcast(offsets), "__b")
    return numbered.withColumn(name, (F.col("__r") + F.col("__o")).cast("int")).drop("__b", "__r", "__o")


def one_hot_columns(column: str, levels: Sequence[str]) -> dict[str, Column]:
    """One 0/1 column per level but the first; a null row is all zero."""
    out: dict[str, Column] = {}
    for v in levels[1:]:
        name = base = f"{column}_{normal_name(v)}"
        k = 1
        while name in out:  # levels whose names are alike once tidied
            k += 1
            name = f"{base}_{k}"
        out[name] = F.coalesce((F.col(column).cast("string") == v).cast("int"), F.lit(0))
    return out


def one_hot(df: DataFrame, column: str) -> DataFrame:
    """Dummies next to the other columns."""
    return df.withColumns(one_hot_columns(column, levels_of(df, column)))


@dataclass
class EncodePlan:
    """What became of each string column."""

    binary: dict[str, list[str]] = field(default_factory=dict)
    hot: dict[str, list[str]] = field(default_factory=dict)
    label: dict[str, list[str]] = field(default_factory=dict)
    target: dict[str, tuple[DataFrame, float]] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for key, (table, overall) in self.target.items():
            out = apply_target_encoding(out, key, table, overall)
        new = {f"{c}_encoded": label_code(c, lv) for c, lv in self.binary.items()}
        for c, lv in self.hot.items():
            new |= one_hot_columns(c, lv)
        new |= {f"{c}_label_encoded": label_code(c, lv) for c, lv in self.label.items()}
        out = out.withColumns(new) if new else out
        return out.drop(*self.binary, *self.hot, *self.label, *self.dropped, *self.target)


def fit_encoding(df: DataFrame, target: str, columns: Sequence[str] | None = None, max_categories: int = 50,
                 target_encoded: Sequence[str] = tuple(K.TARGET_ENCODED)) -> EncodePlan:
    """<=2 values: label; <=10: one-hot; <= max_categories: label; more: target encoding if asked for, else dropped."""
    columns = [c for c in (columns or string_columns(df)) if c != target]
    plan = EncodePlan()
    if not columns:
        return plan
    for r in categorical_summary(df, columns).collect():  # one row per column
        c, k = r["column"], r["distinct_count"]
        if c in target_encoded and k > K.TARGET_MIN_DISTINCT:
            plan.target[c] = fit_target_encoding(df, c, target)
        if k <= 2:
            plan.binary[c] = levels_of(df, c)
        elif k <= 10:
            plan.hot[c] = levels_of(df, c)
        elif k <= max_categories:
            plan.label[c] = levels_of(df, c)
        elif c not in plan.target:
            plan.dropped.append(c)
    return plan
