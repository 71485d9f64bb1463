"""Table profile as long-form reports (D1-D19). Every report is a DataFrame; one or two aggregates each."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slopeworks.functions.numeric import is_finite, normal_quantiles, percent, right_closed_bin, sample_kurtosis, sample_skewness
from slopeworks.operators.heavy import CAPACITY, candidates, hash_key, is_proven, top_values
from slopeworks.operators.quantiles import ONE_PASS_ROWS, between, exact_quantiles, picked, quantile_values
from slopeworks.operators.sketches import KLL_SIZE, merge_sketches, rank_error, sketch_columns, sketched_summary

CORR_IN_ONE_AGGREGATE = 3  # columns; more go through the block statistic in `gram`
FACTS_AT_ONCE = 15  # columns whose aggregates share a scan


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "categorical" if isinstance(t, T.StringType) else "other"


def _nulls(c: str) -> Column:
    return F.count_if(F.col(c).isNull())


def _long(row: DataFrame, columns: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """Turns a one-row aggregate with columns `{field}__{column}` into one row per column."""
    cells = [F.struct(F.lit(c).alias("column"), *[F.col(f"`{f}__{c}`").cast(t).alias(f) for f, t in fields.items()])
             for c in columns]
    return row.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def column_facts(df: DataFrame, aggregates: dict[str, list[Column]], at_once: int = FACTS_AT_ONCE) -> dict[str, object]:
    """The named aggregates of every column in one dict, some columns at a time: an aggregate of hundreds of fields runs as
    code that is never compiled, which costs more than reading the columns it needs by themselves."""
    names, out = list(aggregates), {}
    for at in range(0, len(names), at_once):
        out |= df.agg(*[a for c in names[at : at + at_once] for a in aggregates[c]]).first().asDict()
    return out


def null_rates(df: DataFrame) -> DataFrame:
    """Rows (column, n_rows, missing_count) in one pass."""
    aggs = [a for c in df.columns for a in (_nulls(c).alias(f"missing_count__{c}"), F.count(F.lit(1)).alias(f"n_rows__{c}"))]
    return _long(df.agg(*aggs), df.columns, {"n_rows": "long", "missing_count": "long"})


def overview(df: DataFrame) -> DataFrame:
    """Size, null cells, exact duplicates and column kinds."""
    kinds = [kind_of(f.dataType) for f in df.schema]
    missing = reduce(lambda a, b: a + b, [F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns])
    # Equal rows meet in one hash aggregate whose partial step already merges copies, so copies cannot pile up. A row is
    # told apart by 128 hash bits, so whole rows are not shuffled.
    slim = df.select(F.xxhash64(*df.columns).alias("__h1"), F.xxhash64(F.lit("second"), *df.columns).alias("__h2"), missing.alias("__missing"))
    distinct = slim.groupBy("__h1", "__h2", "__missing").agg(F.count("*").alias("__n"))
    totals = distinct.agg(F.sum("__n").alias("n_rows"), F.count("*").alias("distinct_rows"),
                          F.sum(F.col("__missing") * F.col("__n")).alias("missing_cells"))
    rows = F.coalesce(F.col("n_rows"), F.lit(0))
    duplicates = rows - F.col("distinct_rows")
    return totals.select(
        rows.alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.coalesce(F.col("missing_cells"), F.lit(0)).alias("missing_cells"),
        F.round(percent(F.col("missing_cells"), rows * len(df.columns)), 2).alias("missing_pct"),
        duplicates.alias("duplicate_rows"), F.round(percent(duplicates, rows), 2).alias("duplicate_pct"),
        *[F.lit(kinds.count(k)).cast("long").alias(f"{k}_columns") for k in ("numeric", "categorical", "boolean", "datetime")])


def type_counts(df: DataFrame) -> DataFrame:
    """Number of columns per Spark type (part of D1)."""
    names = [f.dataType.simpleString() for f in df.schema]
    rows = [F.struct(F.lit(t).alias("type"), F.lit(names.count(t)).cast("long").alias("n_columns")) for t in sorted(set(names))]
    return df.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with nulls: count, percent, type, severity tier; most missing first."""
    types = F.create_map(*[x for f in df.schema for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    pct = percent(F.col("missing_count"), F.col("n_rows"))
    tier = F.when(pct > 50, "over_50").when(pct > 20, "20_to_50").when(pct > 5, "5_to_20").otherwise("up_to_5")
    return (null_rates(df).filter(F.col("missing_count") > 0)
            .select("column", "missing_count", F.round(pct, 2).alias("missing_pct"), types[F.col("column")].alias("type"),
                    tier.alias("tier"))
            .orderBy(F.desc("missing_count"), "column"))


def _number(column: str) -> Column:
    """As a double, with NaN as null: unknown values count alike however they were stored."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def pearson(a: Column, b: Column) -> Column:
    """r over the rows where both are known; null where one of them does not vary there."""
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    spread = F.sqrt(F.var_pop(a) * F.var_pop(b))
    return F.when(F.min(a) < F.max(a), F.when(F.min(b) < F.max(b), F.try_divide(F.covar_pop(a, b), spread)))


def missing_tiers(df: DataFrame) -> DataFrame:
    """Number of columns per severity tier (D3)."""
    return missing_report(df).groupBy("tier").agg(F.count("*").alias("n_columns"))


def target_statistics(df: DataFrame, target: str, few_rows: int = ONE_PASS_ROWS, **quantile_options) -> DataFrame:
    """Moments, quartiles and IQR outliers of a positive target (D4, D5), in two scans.

    The first takes the moments and a sketch, whose quantiles bracket the quartiles and so both fences. The second counts what
    lies beside the brackets and takes up the few values inside, from which quartiles and outliers are exact. Where too many
    values lie inside, the quartiles are found by `exact_quantiles` and the outliers by a scan of their own.
    """
    kept = df.select(_number(target).alias(target)).filter(F.col(target) > 0)
    c = F.col(target)
    step = rank_error(KLL_SIZE)
    brackets = [p + d for p in (0.25, 0.5, 0.75) for d in (-step, step)]
    grid = [k / 200 for k in range(201)]
    ranks = F.array(*[F.lit(r) for r in brackets + grid])
    moments = kept.agg(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
        sample_skewness(c).alias("skewness"), sample_kurtosis(c).alias("kurtosis"), F.kll_sketch_agg_double(c, F.lit(KLL_SIZE)).alias("sketch"))
    first = moments.filter("count > 0").withColumn("b", F.kll_sketch_get_quantile_double("sketch", ranks)).drop("sketch").first()
    if first is None:
        raise ValueError(f"no positive values in {target}")
    n, b = first["count"], first["b"][:6]
    f = [b[0] - 1.5 * (b[5] - b[0]), b[1] - 1.5 * (b[4] - b[1]), b[4] + 1.5 * (b[4] - b[1]), b[5] + 1.5 * (b[5] - b[0])]
    near = sum(f[0] <= x <= f[1] or f[2] <= x <= f[3] for x in first["b"][6:]) / 200 + 12 * step
    q1 = median = q3 = None
    if all(map(math.isfinite, f)) and near * n <= few_rows and not quantile_options:
        inside = lambda lo, hi: F.collect_list(F.when(c.between(lo, hi), c))
        seen = kept.agg(*[between(c, b[2 * k], b[2 * k + 1]).alias(f"s{k}") for k in range(3)], F.count_if(c < f[0]).alias("low"), inside(f[0], f[1]).alias("low_near"),
                        F.count_if(c > f[3]).alias("high"), inside(f[2], f[3]).alias("high_near"))
        seen = seen.persist()  # one row
        try:
            q1, median, q3 = picked(seen, [(f"s{k}", b[2 * k], b[2 * k + 1], p * (n - 1)) for k, p in enumerate((0.25, 0.5, 0.75))])
            if None not in (q1, median, q3):
                low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
                beyond = F.col("low") + F.col("high") + F.size(F.filter("low_near", lambda x: x < low)) + F.size(F.filter("high_near", lambda x: x > high))
                outliers = seen.select(beyond.cast("long").alias("out")).first()["out"]
        finally:
            seen.unpersist()
    if None in (q1, median, q3):
        q = quantile_values(kept, {"q1": (target, 0.25), "median": (target, 0.5), "q3": (target, 0.75)}, **quantile_options)
        q1, median, q3 = q["q1"], q["median"], q["q3"]
        outliers = kept.agg(F.count_if((c < q1 - 1.5 * (q3 - q1)) | (c > q3 + 1.5 * (q3 - q1)))).first()[0]
    row = {"count": n, "mean": first["mean"], "median": median, "std": first["std"], "min": first["min"], "max": first["max"], "q1": q1, "q3": q3, "iqr": q3 - q1,
           "skewness": first["skewness"], "kurtosis": first["kurtosis"], "outliers_count": outliers, "outliers_pct": outliers * 100.0 / n}
    kinds = ", ".join(f"{k} {'long' if k in ('count', 'outliers_count') else 'double'}" for k in row)
    return df.sparkSession.createDataFrame([tuple(row.values())], kinds)


def histogram(df: DataFrame, column: str, bins: int = 50, transform=None) -> DataFrame:
    """Equal-width bins between minimum and maximum, the last one closed; empty bins are kept."""
    c = F.col(column).cast("double")
    x = df.select((transform(c) if transform else c).alias("x")).filter(is_finite(F.col("x")))
    bounds = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if bounds["lo"] is None:
        return df.sparkSession.range(0).select(F.lit(0).alias("bin"), F.lit(0.0).alias("lower"), F.lit(0.0).alias("upper"),
                                               F.lit(0).cast("long").alias("n"))
    lo, width = bounds["lo"], (bounds["hi"] - bounds["lo"]) / bins or 1.0
    at = F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)).cast("int")
    counts = x.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(F.broadcast(counts), "bin", "left").select(
        "bin", (F.lit(lo) + F.col("bin") * width).alias("lower"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def range_counts(df: DataFrame, column: str, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """Counts of right-closed ranges in range order."""
    order = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("range"))
    return (df.groupBy(right_closed_bin(F.col(column), edges, labels).alias("range")).agg(F.count("*").alias("n"))
            .filter(F.col("range").isNotNull()).withColumn("position", order.cast("int")).orderBy("position"))


def normal_qq(df: DataFrame, column: str, points: int = 20, **quantile_options) -> DataFrame:
    """Sample quantiles against standard normal quantiles at (i - 0.5) / points."""
    probs = [(i + 0.5) / points for i in range(points)]
    theory = F.create_map(*[x for p, z in zip(probs, normal_quantiles(probs)) for x in (F.lit(float(p)), F.lit(z))])
    q = exact_quantiles(df, [column], probs, **quantile_options)
    return q.select("p", theory[F.col("p")].alias("theoretical"), F.col("value").alias("sample"))


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False, **quantile_options) -> DataFrame:
    """Describe plus missing, zero and distinct counts per numeric column.

    `approximate` takes quartiles and distinct counts from sketches: one scan, and no value is shuffled.
    """
    columns = list(columns or numeric_columns(df))
    if approximate:
        return sketched_summary(merge_sketches(sketch_columns(df, columns)))
    x = df.select(*[_number(c).alias(c) for c in columns])
    aggs = []
    for c in columns:
        v = F.col(c)
        aggs += [F.count(v).alias(f"count__{c}"), F.avg(v).alias(f"mean__{c}"), F.stddev_samp(v).alias(f"std__{c}"),
                 F.min(v).alias(f"min__{c}"), F.max(v).alias(f"max__{c}"),
                 percent(_nulls(c), F.count(F.lit(1))).alias(f"missing_pct__{c}"),
                 percent(F.count_if(v == 0), F.count(F.lit(1))).alias(f"zeros_pct__{c}")]
    fields = {"count": "long", "mean": "double", "std": "double", "min": "double", "max": "double",
              "missing_pct": "double", "zeros_pct": "double"}
    basics = _long(x.agg(*aggs), columns, fields)
    # Values are counted in long form: one row per (column, value) after the partial step.
    distinct = (x.unpivot([], columns, "column", "value").filter(F.col("value").isNotNull()).groupBy("column", "value")
                .agg(F.lit(1).alias("one")).groupBy("column").agg(F.count("*").alias("distinct_count")))
    quart = exact_quantiles(x, columns, [0.25, 0.5, 0.75], **quantile_options).groupBy("column").agg(*[
        F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    # Both sides have one row per column of the table.
    return (basics.join(F.broadcast(quart), "column", "left").join(F.broadcast(distinct), "column", "left")
            .withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)).cast("long")))


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson r of every pair of columns over the rows where both are known."""
    columns = list(columns or numeric_columns(df))
    x = df.select(*[_number(c).alias(c) for c in columns])
    if len(columns) > CORR_IN_ONE_AGGREGATE:
        from slopeworks.operators.gram import pairwise_correlations

        return pairwise_correlations(x, columns)
    pairs = list(combinations(range(len(columns)), 2))
    row = x.agg(*[pearson(F.col(columns[i]), F.col(columns[j])).alias(f"r_{i}_{j}") for i, j in pairs])
    cells = [F.struct(F.lit(columns[i]).alias("column_1"), F.lit(columns[j]).alias("column_2"), F.col(f"r_{i}_{j}").alias("r"))
             for i, j in pairs]
    return row.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def target_correlations(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """r of each column with the target, strongest first."""
    columns = [c for c in (columns or numeric_columns(df)) if c != target]
    row = df.agg(*[pearson(_number(c), _number(target)).alias(f"r__{c}") for c in columns])
    return (_long(row, columns, {"r": "double"}).filter(F.col("r").isNotNull()).withColumn("abs_r", F.abs("r"))
            .orderBy(F.desc("abs_r"), "column"))


def strong_pairs(df: DataFrame, columns: Sequence[str] | None = None, above: float = 0.8) -> DataFrame:
    """Pairs with |r| above a limit, r to three places."""
    return correlations(df, columns).filter(F.abs("r") > above).withColumn("r", F.round("r", 3))


def correlation_block(df: DataFrame, target: str, columns: Sequence[str] | None = None, k: int = 15) -> DataFrame:
    """Correlations among the k columns that go best with the target."""
    pairs = correlations(df, columns).persist()  # one row per pair of columns
    side = F.when(F.col("column_1") == target, F.col("column_2")).when(F.col("column_2") == target, F.col("column_1"))
    top = (pairs.withColumn("column", side).filter(F.col("column").isNotNull() & F.col("r").isNotNull())
           .orderBy(F.abs("r").desc(), "column").limit(k).select("column"))
    keep = F.broadcast(top)
    return (pairs.join(keep.withColumnRenamed("column", "column_1"), "column_1", "left_semi")
            .join(keep.withColumnRenamed("column", "column_2"), "column_2", "left_semi")
            .select("column_1", "column_2", "r"))


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct count, missing percent, most frequent value (smallest on ties) and its share; cardinality class."""
    columns = list(columns or string_columns(df))
    counts = (df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
              .groupBy("column", "value").agg(F.count("*").alias("n")))
    known = F.col("value").isNotNull()
    # The most frequent value is an aggregate over (count, value), so no task sorts all values of a column.
    per = counts.groupBy("column").agg(
        F.count(F.when(known, F.lit(1))).alias("distinct_count"), F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing_count"),
        F.min(F.when(known, F.struct((-F.col("n")).alias("neg"), F.col("value").alias("value")))).alias("top"))
    d = F.col("distinct_count")
    return per.select(
        "column", "distinct_count", percent(F.col("missing_count"), F.col("n_rows")).alias("missing_pct"),
        F.col("top.value").alias("top_value"), (-F.col("top.neg")).alias("top_count"),
        percent(-F.col("top.neg"), F.col("n_rows")).alias("top_pct"),
        F.when(d > 50, "high").when(d > 10, "medium").otherwise("low").alias("cardinality"),
    ).orderBy(F.desc("distinct_count"), "column")


def cardinality_classes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return categorical_summary(df, columns).groupBy("cardinality").agg(F.count("*").alias("n_columns"))


def top_category_means(df: DataFrame, category: str, target: str, k: int = 10, capacity: int | None = None) -> DataFrame:
    """Mean target of the k most frequent values.

    With a `capacity` only heavy hitters are grouped (see `heavy`), which pays where a category has very many values; the answer
    is the same. This reads the table at once, and at most k rows pass through the driver.
    """
    def means(rows: DataFrame) -> DataFrame:
        return (rows.filter(F.col(category).isNotNull()).groupBy(category)
                .agg(F.count("*").alias("n"), F.avg(target).alias("mean_target")).orderBy(F.desc("n"), category).limit(k))

    if capacity is None:
        return means(df)
    found = candidates(df, [category], k, capacity)[category]
    if not found.hopeless:
        top = means(df.filter(hash_key(df, category).isin(list(found.keys))))
        rows = top.collect()
        if is_proven([r["n"] for r in rows], k, found.bound):
            return df.sparkSession.createDataFrame(rows, top.schema)
    return means(df)


def top_value_shares(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10, capacity: int = CAPACITY) -> DataFrame:
    """(column, place, value, n, pct) of the k most frequent values of each column, exact, with values as text."""
    columns = list(columns or string_columns(df))
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    n = text.count()
    rows = [(c, place, value, times, 100.0 * times / n) for c, found in top_values(text, columns, k, capacity).items()
            for place, (value, times) in enumerate(found, 1)]
    return df.sparkSession.createDataFrame(rows, "column string, place int, value string, n long, pct double")


def quality_report(df: DataFrame, target: str | None = None) -> DataFrame:
    """Completeness, column kinds and target validity in one row."""
    kinds = [kind_of(f.dataType) for f in df.schema]
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in df.columns])
    n = F.count(F.lit(1))
    aggs = [n.alias("total_rows"), F.lit(len(df.columns)).cast("long").alias("total_columns"),
            reduce(lambda a, b: a + b, [_nulls(c) for c in df.columns]).alias("missing_cells"),
            reduce(lambda a, b: a + b, [F.when(_nulls(c) > 0, 1).otherwise(0) for c in df.columns]).cast("long").alias("columns_with_missing"),
            F.count_if(complete).alias("complete_rows"), F.round(percent(F.count_if(complete), n), 2).alias("complete_pct")]
    aggs += [F.lit(kinds.count(k)).cast("long").alias(f"{k}_columns") for k in ("numeric", "categorical", "boolean", "datetime")]
    if target:
        t = F.col(target)
        positive = F.when(t > 0, t)
        aggs += [F.count_if(t > 0).alias("target_valid"), F.count_if(t.isNull()).alias("target_missing"),
                 F.count_if(t <= 0).alias("target_not_positive"), F.round(F.avg(positive), 2).alias("target_mean"),
                 F.round(F.stddev_samp(positive), 2).alias("target_std")]
    return df.agg(*aggs)


def quality_issues(df: DataFrame) -> DataFrame:
    """Rows (issue, column): mostly null, many distinct strings, constant."""
    nulls = null_rates(df).select("column", (F.col("missing_count") > F.col("n_rows") * 0.5).alias("mostly_null"))
    simple = [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    distinct = categorical_summary(df, simple).select("column", "distinct_count")
    strings = F.col("column").isin(string_columns(df))
    both = nulls.join(F.broadcast(distinct), "column", "left")
    rules = F.array_compact(F.array(
        F.when(F.col("mostly_null"), "mostly_null"), F.when(strings & (F.col("distinct_count") > 100), "high_cardinality"),
        F.when(F.col("distinct_count") <= 1, "constant")))
    return both.select(F.explode(rules).alias("issue"), "column")


def recommendations(df: DataFrame, target: str) -> DataFrame:
    """Preparation advice with a priority, from the reports above."""
    spark = df.sparkSession
    advice = F.struct

    def row(kind: str, priority: str, amount: Column) -> Column:
        return advice(F.lit(kind).alias("type"), F.lit(priority).alias("priority"), amount.cast("double").alias("amount"))

    over = missing_report(df).agg(F.count_if(F.col("tier") == "over_50").alias("amount")).select(
        row("DROP_COLUMNS", "HIGH", F.col("amount")).alias("r"), (F.col("amount") > 0).alias("on"))
    dup = overview(df).select(row("REMOVE_DUPLICATES", "HIGH", F.col("duplicate_rows")).alias("r"), (F.col("duplicate_rows") > 0).alias("on"))
    card = categorical_summary(df).agg(F.count_if(F.col("distinct_count") > 50).alias("amount")).select(
        row("ENCODE_CATEGORICAL", "HIGH", F.col("amount")).alias("r"), (F.col("amount") > 0).alias("on"))
    stats = target_statistics(df, target)
    out = stats.select(row("HANDLE_OUTLIERS", "MEDIUM", F.col("outliers_pct")).alias("r"), (F.col("outliers_pct") > 5).alias("on"))
    skew = stats.select(row("TRANSFORM_TARGET", "MEDIUM", F.col("skewness")).alias("r"), (F.col("skewness") > 1).alias("on"))
    parts = [over, dup, out, skew] + ([card] if string_columns(df) else [])
    rank = F.when(F.col("priority") == "HIGH", 1).when(F.col("priority") == "MEDIUM", 2).otherwise(3)
    return reduce(DataFrame.union, parts).filter("on").select("r.*").orderBy(rank, "type")
