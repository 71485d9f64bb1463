"""Scalers fitted in one aggregate, applied as a projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.operators.profile import column_facts
from slopeworks.operators.quantiles import quantile_values


@dataclass
class Scaler:
    """x -> (x - shift) / scale per column; a column with scale 0 was constant."""

    shift: dict[str, float]
    scale: dict[str, float]
    constant: str = "centre"  # constant columns: "centre" divides by 1, "skip" leaves them alone

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c, s in self.scale.items():
            if s == 0 and self.constant == "skip":
                continue
            new[c] = (F.col(c).cast("double") - F.lit(self.shift[c])) / F.lit(s or 1.0)
        return df.withColumns(new) if new else df


def fit_scaler(df: DataFrame, columns: Sequence[str], kind: str = "standard", **quantile_options) -> Scaler:
    """`standard` population std (I16), `sample` sample std skipping constants (I17), `minmax` (I18), `robust`."""
    columns = list(columns)
    if kind == "robust":
        wanted = {f"{n}__{c}": (c, p) for c in columns for n, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))}
        row = quantile_values(df, wanted, **quantile_options)
        return Scaler({c: row[f"q2__{c}"] for c in columns}, {c: row[f"q3__{c}"] - row[f"q1__{c}"] for c in columns}, "skip")
    pairs = {"standard": (F.avg, F.stddev_pop), "sample": (F.avg, F.stddev_samp), "minmax": (F.min, F.max)}
    if kind not in pairs:
        raise ValueError(f"unknown scaler {kind!r}")
    low, spread = pairs[kind]
    row = column_facts(df, {c: [low(F.col(c).cast("double")).alias(f"a__{c}"), spread(F.col(c).cast("double")).alias(f"b__{c}")] for c in columns})
    shift = {c: row[f"a__{c}"] or 0.0 for c in columns}
    scale = {c: (row[f"b__{c}"] or 0.0) - (shift[c] if kind == "minmax" else 0.0) for c in columns}
    return Scaler(shift, scale, "centre" if kind == "standard" else "skip")


def log_target(df: DataFrame, target: str, name: str = "label") -> DataFrame:
    """label = log1p(target)."""
    return df.withColumn(name, F.log1p(F.col(target).cast("double")))


def original_target(df: DataFrame, label: str = "label", name: str = "target") -> DataFrame:
    return df.withColumn(name, F.expm1(label))
