"""Stored sketches of columns: quantiles, distinct counts and moments that merge over any set of partitions.

One scan makes a row for each (part, column) with counts, moments, a KLL sketch of the values and a HyperLogLog sketch of the
distinct ones; no value is shuffled. The rows are stored with the table they describe and answer questions about all of it, or
some parts of it, without reading it again. `quantiles.exact_quantiles` takes its brackets from the same sketches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KLL_SIZE = 4096
HLL_BITS = 12


def rank_error(size: int) -> float:
    """How far, as a share of the rows, a KLL sketch of this size may be off: thrice its error at 99 %."""
    return min(0.5, 3 * 2.296 / size**0.9021)


def known_number(column: str) -> Column:
    """As a double, with NaN as null."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def sketch_columns(df: DataFrame, columns: Sequence[str], part_cols: Sequence[str] = (), kll_size: int = KLL_SIZE, hll_bits: int = HLL_BITS) -> DataFrame:
    """(part..., column, n_rows, n, zeros, mean, m2, lo, hi, quantiles, distinct), one row for each part and column.

    Null and NaN values count as rows and no more; a column without values has null sketches. Equal doubles are one value.
    """
    def cell(c: str) -> Column:
        v = known_number(c)
        n = F.count(v)
        return F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), n.alias("n"), F.count_if(v == 0).alias("zeros"), F.avg(v).alias("mean"),
            (F.var_pop(v) * n).alias("m2"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.when(n > 0, F.kll_sketch_agg_double(v, F.lit(kll_size))).alias("quantiles"),
            F.when(n > 0, F.hll_sketch_agg(F.when(v.isNotNull(), F.xxhash64(v + F.lit(0.0))), F.lit(hll_bits))).alias("distinct"))

    cells = df.groupBy(*part_cols).agg(*[cell(c).alias(f"cell{k}") for k, c in enumerate(columns)])
    return cells.select(*part_cols, F.explode(F.array(*[f"cell{k}" for k in range(len(columns))])).alias("cell")).select(*part_cols, "cell.*")


def merge_sketches(parts: DataFrame) -> DataFrame:
    """One row for each column over all given parts: filter the stored rows first to ask for some of them."""
    mean = F.try_divide(F.sum(F.col("mean") * F.col("n")), F.sum("n"))
    merged = parts.groupBy("column").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n"), F.sum("zeros").alias("zeros"), mean.alias("mean"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        (F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")) - F.sum("n") * mean * mean).alias("m2"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"))
    return merged.withColumn("m2", F.greatest("m2", F.lit(0.0)))


def sketched_quantiles(merged: DataFrame, probs: Sequence[float], group_cols: Sequence[str] = ()) -> DataFrame:
    """(group..., column, p, value) with ranks within `rank_error` of the wanted ones; the ends are exact."""
    wanted = F.array(*[F.lit(float(x)) for x in probs])
    known = merged.filter("n > 0").select(*group_cols, "column", "lo", "hi", F.posexplode(F.kll_sketch_get_quantile_double("quantiles", wanted)).alias("k", "value"))
    p = F.get(wanted, F.col("k"))
    return known.select(*group_cols, "column", p.alias("p"), F.when(p <= 0, F.col("lo")).when(p >= 1, F.col("hi")).otherwise(F.col("value")).alias("value"))


def sketched_summary(merged: DataFrame) -> DataFrame:
    """Describe by sketches: counts, moments and ends are exact, quartiles and distinct counts are estimates."""
    quartile = lambda p: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(p)))
    return merged.select(
        "column", F.col("n").alias("count"), "mean", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std"), F.col("lo").alias("min"), F.col("hi").alias("max"),
        quartile(0.25).alias("q1"), quartile(0.5).alias("median"), quartile(0.75).alias("q3"),
        (100.0 * (F.col("n_rows") - F.col("n")) / F.col("n_rows")).alias("missing_pct"), (100.0 * F.col("zeros") / F.col("n_rows")).alias("zeros_pct"),
        F.coalesce(F.hll_sketch_estimate("distinct"), F.lit(0)).cast("long").alias("distinct_count"))
