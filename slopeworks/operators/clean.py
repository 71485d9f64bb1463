"""Row and column filters, duplicates, validity checks and dtype policy."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slopeworks.functions import constants as K
from slopeworks.functions.numeric import is_finite, ordered_code
from slopeworks.operators.profile import column_facts, null_rates, numeric_columns
from slopeworks.operators.quantiles import quantile_values


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One of each set of equal rows; partial aggregation merges copies before the shuffle."""
    return df.distinct()


def positive(df: DataFrame, column: str) -> DataFrame:
    """Rows with a target above zero; NaN is not (Spark orders it above all numbers)."""
    return df.filter((F.col(column) > 0) & ~F.isnan(F.col(column).cast("double")))


def below_quantile(df: DataFrame, column: str, p: float = 0.995, **quantile_options) -> DataFrame:
    """Rows strictly below the exact quantile of the rows given (B3); the bound is a constant that reaches the scan."""
    bound = quantile_values(df, {"bound": (column, p)}, **quantile_options)["bound"]
    return df.filter(F.col(column) < F.lit(bound).cast("double"))


def in_range(df: DataFrame, column: str, low=None, high=None, closed_high: bool = False) -> DataFrame:
    """Keeps low <= x < high (or <= high); unknown values are dropped."""
    if low is not None:
        df = df.filter(F.col(column) >= low)
    if high is not None:
        df = df.filter(F.col(column) <= high if closed_high else F.col(column) < high)
    return df


def clean_listings(df: DataFrame, as_of: int, target: str = "price", year: str = "year", mileage: str = "mileage",
                   trim: float = 0.995) -> DataFrame:
    """Distinct rows, positive target below its upper quantile, plausible year and mileage.

    The row filters run before duplicates are removed, which changes nothing but the size of the shuffle. The trim
    bound needs the target of all distinct rows: there a row is told apart by 128 hash bits, so that only the target
    and two numbers are shuffled, not whole rows.
    """
    kept = positive(df, target)
    slim = kept.select(target, F.xxhash64(*df.columns).alias("h1"), F.xxhash64(F.lit("second"), *df.columns).alias("h2")).distinct()
    bound = quantile_values(slim, {"bound": (target, trim)}, reuse=True)["bound"]
    out = drop_duplicate_rows(kept).filter(F.col(target) < F.lit(bound).cast("double"))
    if year in df.columns:
        out = in_range(out, year, 1900, as_of + 1, closed_high=True)
    return in_range(out, mileage, 0, 500_000) if mileage in df.columns else out


def mostly_null_columns(df: DataFrame, limit: float = 0.5) -> list[str]:
    """Names of columns with a null share above the limit: one aggregate, one row per column."""
    rows = null_rates(df).filter(F.col("missing_count") > F.col("n_rows") * limit).collect()
    return [r["column"] for r in rows]


def drop_mostly_null(df: DataFrame, limit: float = 0.5) -> DataFrame:
    return df.drop(*mostly_null_columns(df, limit))


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Feature columns and the target column."""
    return df.drop(target), df.select(target)


def numeric_matrix(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """`keep` columns and one array<double> of all other numeric columns."""
    names = [c for c in numeric_columns(df) if c not in keep]
    return df.select(*keep, F.array(*[F.col(c).cast("double") for c in names]).alias("features"))


def final_types(df: DataFrame, keep: Sequence[str] = (), categories: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Model-ready columns (B10): ordered categories to codes, booleans to 0/1, numeric strings to numbers.

    Empty columns and strings without any number are dropped, as counts of the known values decide.
    """
    categories = categories or {}
    fields = [f for f in df.schema if f.name not in keep]
    usable = {f.name: (F.col(f.name).try_cast("double") if isinstance(f.dataType, T.StringType) and f.name not in categories
                       else F.col(f.name)) for f in fields}
    known = column_facts(df, {n: [F.count(e).alias(n)] for n, e in usable.items()})
    out = list(keep)
    for f in fields:
        c = F.col(f.name)
        if not known[f.name]:
            continue
        if f.name in categories:
            out.append(ordered_code(c, categories[f.name]).cast("double").alias(f.name))
        elif isinstance(f.dataType, T.BooleanType):
            out.append(c.cast("int").alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            out.append(c.try_cast("double").alias(f.name))
        elif isinstance(f.dataType, T.NumericType):
            out.append(c)
    return df.select(*out)


def validity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: null, NaN and infinite counts and whether the column is fit for training."""
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        aggs += [F.count_if(v.isNull()).alias(f"n_null__{c}"), F.count_if(F.isnan(v)).alias(f"n_nan__{c}"),
                 F.count_if(F.abs(v) == float("inf")).alias(f"n_inf__{c}"), F.count(F.lit(1)).alias(f"n_rows__{c}")]
    cells = [F.struct(F.lit(c).alias("column"), *[F.col(f"`{m}__{c}`").alias(m) for m in ("n_rows", "n_null", "n_nan", "n_inf")])
             for c in columns]
    long = df.agg(*aggs).select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    return long.withColumn("valid", (F.col("n_rows") > 0) & (F.col("n_null") + F.col("n_nan") + F.col("n_inf") == 0))


def finite_groups(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of the groups in which every value of the columns is finite.

    The verdict is an aggregate per group; the groups that fail are anti-joined away.
    """
    ok = reduce(lambda a, b: a & b, [F.coalesce(is_finite(F.col(c).cast("double")), F.lit(False)) for c in columns])
    bad = df.filter(~ok).select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return df.join(bad, same, "left_anti")


def change_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows, columns and nulls before and after a step."""
    def one(df: DataFrame, stage: str) -> DataFrame:
        nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
        return df.agg(F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("n_rows"),
                      F.lit(len(df.columns)).cast("long").alias("n_columns"), nulls.alias("null_cells"))
    return one(before, "before").unionByName(one(after, "after"))


def concat_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Row-wise union by name; a column missing in one frame is null there (G1)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def removal_report(df: DataFrame, rules: dict[str, "F.Column"]) -> DataFrame:
    """Rows that each removal rule hits, rows hit by any, in one pass."""
    hits = {n: F.coalesce(c, F.lit(False)) for n, c in rules.items()}
    any_hit = reduce(lambda a, b: a | b, hits.values())
    everything = {**hits, "any_rule": any_hit}
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(c).alias(n) for n, c in everything.items()])
    cells = [F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("n_removed"),
                      F.try_divide(F.col(f"`{n}`") * 100.0, F.col("__n")).alias("pct")) for n in everything]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def listing_projection(df: DataFrame) -> DataFrame:
    """The columns the preparation job reads, in their fixed order, as far as the table has them (B1)."""
    return df.select(*[c for c in K.LISTING_COLUMNS if c in df.columns])
