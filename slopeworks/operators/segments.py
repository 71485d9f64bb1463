"""Segment reports (P1-P6): shares, tiers, variance analysis, depreciation, retention, age bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.functions.numeric import right_closed_bin


def segment_shares(df: DataFrame, column: str, edges: Sequence[float], labels: Sequence[str], target: str,
                   reference: str | None = None) -> DataFrame:
    """Share and mean target per bin, and the percent difference of the mean from the reference (middle) bin."""
    reference = reference or labels[len(labels) // 2]
    per = (df.groupBy(right_closed_bin(F.col(column), edges, labels).alias("segment"))
           .agg(F.count("*").alias("n"), F.avg(target).alias("mean_target")).filter(F.col("segment").isNotNull()))
    total = per.agg(F.sum("n").alias("t")).scalar()
    base = per.filter(F.col("segment") == reference).agg(F.max("mean_target").alias("m")).scalar()
    return per.select("segment", "n", (F.col("n") * 100.0 / total).alias("share_pct"), "mean_target",
                      F.try_divide((F.col("mean_target") - base) * 100.0, base).alias("vs_reference_pct"))


def group_tiers(df: DataFrame, key: str, target: str, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """Groups binned by their mean target: number of groups, rows, market share per tier."""
    per = df.groupBy(key).agg(F.count("*").alias("n"), F.avg(target).alias("mean_target"))
    tiers = per.groupBy(right_closed_bin(F.col("mean_target"), edges, labels).alias("tier")).agg(
        F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"),
        (F.sum(F.col("mean_target") * F.col("n")) / F.sum("n")).alias("mean_target"))
    total = tiers.agg(F.sum("n_rows").alias("t")).scalar()
    return tiers.withColumn("share_pct", F.col("n_rows") * 100.0 / total)


def group_anova(df: DataFrame, key: str, target: str) -> DataFrame:
    """One-way F, eta squared and group count, from per-group counts, means and variances."""
    per = group_variation(df, key, target)
    n, m = F.col("n"), F.col("mean_target")
    grand = per.agg((F.sum(n * m) / F.sum("n")).alias("g")).scalar()
    sums = per.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(n * F.pow(m - grand, F.lit(2.0))).alias("between"),
                   F.sum((n - 1) * F.coalesce("variance", F.lit(0.0))).alias("within"))
    f = F.try_divide(F.col("between") / (F.col("k") - 1), F.try_divide("within", F.col("n") - F.col("k")))
    return sums.select("k", "n", F.when(F.col("k") > 1, f).alias("f_value"),
                       F.try_divide(F.col("between"), F.col("between") + F.col("within")).alias("eta_squared"))


def group_variation(df: DataFrame, key: str, target: str) -> DataFrame:
    """Count, mean, variance and coefficient of variation per group."""
    known = df.filter(F.col(key).isNotNull() & F.col(target).isNotNull())
    return known.groupBy(key).agg(F.count("*").alias("n"), F.avg(target).alias("mean_target"), F.var_samp(target).alias("variance"),
                                  F.try_divide(F.stddev_samp(target), F.avg(target)).alias("variation"))


def retention(df: DataFrame, key: str, age: str, target: str) -> DataFrame:
    """Mean target by age as a percent of the same group's mean at age 0 (P5); null for groups without rows of that age."""
    means = df.groupBy(key, F.col(age).cast("int").alias("age")).agg(F.avg(target).alias("mean_target"), F.count("*").alias("n"))
    new = means.filter(F.col("age") == 0).select(F.col(key).alias("__key"), F.col("mean_target").alias("new_mean"))
    return means.join(new, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key").withColumn("retention_pct", F.try_divide(F.col("mean_target") * 100.0, F.col("new_mean")))


def retention_extremes(df: DataFrame, key: str, age: str, target: str, at_age: int = 5, n: int = 5, slowest: bool = True) -> DataFrame:
    """Groups that keep most (or least) of their value at an age (P5)."""
    r = retention(df, key, age, target).filter((F.col("age") == at_age) & F.col("retention_pct").isNotNull())
    order = F.desc("retention_pct") if slowest else F.asc("retention_pct")
    return r.orderBy(order, key).limit(n)


# Age bands, upper ends included.
AGE_EDGES = [-1.0, 2.0, 7.0, 15.0, float("inf")]
AGE_LABELS = ["0-2", "3-7", "8-15", "16+"]


def age_segments(df: DataFrame, age: str, target: str) -> DataFrame:
    """Rows and mean target per age band."""
    return (df.groupBy(right_closed_bin(F.col(age), AGE_EDGES, AGE_LABELS).alias("band"))
            .agg(F.count("*").alias("n"), F.avg(target).alias("mean_target")).filter(F.col("band").isNotNull()))
