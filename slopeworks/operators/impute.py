"""Imputation: a plan fitted by small aggregates, applied lazily."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slopeworks.operators.heavy import top_values
from slopeworks.operators.joins import lookup_join
from slopeworks.operators.profile import null_rates
from slopeworks.operators.quantiles import quantile_columns, quantile_values


def group_median_table(df: DataFrame, columns: Sequence[str], group_cols: Sequence[str], **quantile_options) -> DataFrame:
    """Rows (group..., m__column..., n_group) with exact medians of the known values."""
    known = df.filter(F.concat(*[F.lit("")] + [F.col(g).cast("string") for g in group_cols]).isNotNull())
    medians = quantile_columns(known, {f"m__{c}": (c, 0.5) for c in columns}, group_cols, **quantile_options)
    sizes = known.groupBy(*group_cols).agg(F.count("*").alias("n_group"))
    return sizes.join(medians, list(group_cols), "left")


def fill_group_median(df: DataFrame, columns: Sequence[str], group_cols: Sequence[str],
                      fallback: dict[str, float] | None = None, **quantile_options) -> DataFrame:
    """Known value, else the median of its group, else the fallback."""
    table = group_median_table(df, columns, group_cols, **quantile_options)
    joined = lookup_join(df, table, group_cols, "left", weight="n_group")
    fallback = fallback or {}
    fills = {c: F.coalesce(F.col(c).cast("double"), F.col(f"m__{c}"), F.lit(fallback.get(c)).cast("double")) for c in columns}
    return joined.withColumns(fills).drop("n_group", *[f"m__{c}" for c in columns])


@dataclass
class ImputePlan:
    """Which columns are dropped, flagged, filled with a constant or filled from their group."""

    dropped: list[str] = field(default_factory=list)
    flagged: list[str] = field(default_factory=list)
    fills: dict[str, object] = field(default_factory=dict)
    grouped: dict[str, float] = field(default_factory=dict)
    group_cols: tuple[str, ...] = ()
    group_table: DataFrame | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.drop(*self.dropped)
        flags = {f"{c}_was_missing": F.col(c).isNull().cast("int") for c in self.flagged}
        out = out.withColumns(flags) if flags else out
        if self.group_table is not None:
            out = lookup_join(out, self.group_table, self.group_cols, "left", weight="n_group")
            out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"m__{c}"), F.lit(g))
                                   for c, g in self.grouped.items()})
            out = out.drop("n_group", *[f"m__{c}" for c in self.grouped])
        fills = {c: F.coalesce(F.col(c), F.lit(v).cast(out.schema[c].dataType) if isinstance(v, str) else F.lit(v).cast("double"))
                 for c, v in self.fills.items() if c in out.columns}
        return out.withColumns(fills) if fills else out


def fit_smart(df: DataFrame, group_cols: Sequence[str] = ("make_name", "model_name"), drop_above: float = 0.5,
              skip: Sequence[str] = (), **quantile_options) -> ImputePlan:
    """Numeric nulls: <5% median, <20% group median then median, else a flag and the median.
    String nulls: <10% the most frequent value, else 'unknown' (I2). Columns mostly null are dropped (B6)."""
    rates = {r["column"]: r for r in null_rates(df).collect()}  # one row per column
    n = next(iter(rates.values()))["n_rows"] if rates else 0
    share = {c: r["missing_count"] / n if n else 0.0 for c, r in rates.items() if c not in skip}
    plan = ImputePlan(dropped=[c for c, s in share.items() if s > drop_above])
    open_cols = [f for f in df.schema if share.get(f.name, 0) > 0 and f.name not in plan.dropped]
    numeric = [f.name for f in open_cols if isinstance(f.dataType, T.NumericType)]
    strings = [f.name for f in open_cols if isinstance(f.dataType, T.StringType)]
    kept_groups = [g for g in group_cols if g in df.columns and g not in plan.dropped]
    by_group = [c for c in numeric if 0.05 <= share[c] < 0.2] if len(kept_groups) == len(group_cols) and group_cols else []
    if numeric:
        medians = quantile_values(df, {c: (c, 0.5) for c in numeric}, **{"reuse": True, **quantile_options})  # its passes share one read
        plan.flagged = [c for c in numeric if share[c] >= 0.2]
        plan.grouped = {c: medians[c] for c in by_group}
        plan.fills.update({c: medians[c] for c in numeric if c not in by_group})
    if by_group:
        plan.group_cols = tuple(kept_groups)
        plan.group_table = group_median_table(df, by_group, kept_groups, **quantile_options)
    modal = [c for c in strings if share[c] < 0.1]
    tops = _modes(df, modal)
    plan.fills.update({c: tops.get(c) or "unknown" for c in strings})
    return plan


def impute(df: DataFrame, strategy: str = "auto", columns: Sequence[str] | None = None, drop_above: float = 0.5,
           **quantile_options) -> DataFrame:
    """Single-strategy imputation (I3): auto, drop, mean, median, mode.

    `auto` drops mostly-null columns, then fills numbers with the median and strings with the most frequent value.
    """
    if strategy == "drop":
        return df.dropna(subset=list(columns) if columns else None)
    if strategy not in ("auto", "mean", "median", "mode"):
        raise ValueError(f"unknown strategy {strategy!r}")
    rates = {r["column"]: r for r in null_rates(df).collect()}
    n = next(iter(rates.values()))["n_rows"]
    gone = [c for c, r in rates.items() if strategy == "auto" and r["missing_count"] > n * drop_above]
    df = df.drop(*gone)
    names = [c for c in (columns or df.columns) if c not in gone and rates[c]["missing_count"] > 0]
    numeric = [c for c in names if isinstance(df.schema[c].dataType, T.NumericType)]
    strings = [c for c in names if isinstance(df.schema[c].dataType, T.StringType)]
    fills: dict[str, object] = {}
    if numeric and strategy == "mean":
        fills.update(df.agg(*[F.avg(c).alias(c) for c in numeric]).first().asDict())
    elif numeric and strategy in ("auto", "median"):
        fills.update(quantile_values(df, {c: (c, 0.5) for c in numeric}, **quantile_options))
    modal = (numeric if strategy == "mode" else []) + (strings if strategy in ("auto", "mode") else [])
    if modal:
        fills.update(_modes(df, modal))
    known = {c: v for c, v in fills.items() if v is not None}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in known.items()}) if known else df


def _modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """The most frequent known value of each column, the smallest on ties, by two scans for each type among the columns.

    Values are compared in their own type, so ties among numbers go to the smallest number.
    """
    kinds: dict[str, list[str]] = {}
    for c in columns:
        kinds.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    tops = {c: found for names in kinds.values() for c, found in top_values(df, names, 1).items()}
    return {c: tops[c][0][0] if tops[c] else None for c in columns}


def fill_leftover(df: DataFrame, columns: Sequence[str], **quantile_options) -> DataFrame:
    """Median fill of what is still null in numeric columns."""
    return impute(df.withColumns({c: F.col(c).cast("double") for c in columns}), "median", columns, **quantile_options)
