"""Scoring and evaluation of linear models over a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.functions.numeric import is_finite
from slopeworks.functions.vectors import linear_prediction, standardise, unrolled_prediction
from slopeworks.operators.joins import BROADCAST_ROWS, lookup_join
from slopeworks.operators.profile import histogram

BROADCAST_WEIGHTS = 5_000_000  # numbers in all models together: 40 MB


def predict(df: DataFrame, features: Sequence[str], weights: Sequence[float], name: str = "prediction") -> DataFrame:
    """Xw + b as a plain column sum (L1)."""
    return df.withColumn(name, unrolled_prediction(features, weights))


def predict_array(df: DataFrame, features: str, weights: Sequence[float], name: str = "prediction") -> DataFrame:
    return df.withColumn(name, linear_prediction(F.col(features), F.array(*[F.lit(float(w)) for w in weights])))


def predict_by_group(df: DataFrame, features: Sequence[str], models: DataFrame, keys: Sequence[str],
                     name: str = "prediction") -> DataFrame:
    """Each row is scored by the model of its group; `models` has `weights` per key and its row count `n`."""
    slim = models.select(*keys, "weights", *(["n"] if "n" in models.columns else []))
    bound = min(BROADCAST_ROWS, BROADCAST_WEIGHTS // (len(features) + 1))
    joined = lookup_join(df, slim, keys, "left", weight="n" if "n" in models.columns else None, bound=bound)
    x = F.array(*[F.col(c).cast("double") for c in features])
    return joined.withColumn(name, linear_prediction(x, F.col("weights"))).drop("weights", "n")


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                       group_cols: Sequence[str] = ()) -> DataFrame:
    """MSE, RMSE, MAE, R2; with a constant label R2 is 1 for a perfect fit, else 0 (L4)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - p
    row = df.groupBy(*group_cols).agg(F.count(e).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                                      F.var_pop(y).alias("__v"))
    return row.withColumns({"rmse": F.sqrt("mse"), "r2": _r2("mse", "__v")}).drop("__v")


def _r2(mse: str, variance: str):
    return F.when(F.col(variance) == 0, F.when(F.col(mse) == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col(mse) / F.col(variance))


def full_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", group_cols: Sequence[str] = ()) -> DataFrame:
    """All metrics on the original scale (expm1) and the main ones on the log scale, in one aggregate."""
    logs = df.select(*group_cols, F.col(label).cast("double").alias("yl"), F.col(prediction).cast("double").alias("pl"))
    rows = logs.withColumns({"y": F.expm1("yl"), "p": F.expm1("pl")}).withColumns(
        {"e": F.col("y") - F.col("p"), "el": F.col("yl") - F.col("pl")})
    share = F.abs(F.try_divide(F.col("e"), F.col("y")))
    row = rows.groupBy(*group_cols).agg(
        F.count("e").alias("n"), F.avg(F.col("e") * F.col("e")).alias("mse"), F.avg(F.abs("e")).alias("mae"),
        F.var_pop("y").alias("__v"), F.var_pop("e").alias("__ve"), F.max(F.abs("e")).alias("max_error"),
        (F.avg(F.when(is_finite(share), share)) * 100).alias("mape"),
        F.avg(F.col("el") * F.col("el")).alias("mse_log_scale"), F.avg(F.abs("el")).alias("mae_log_scale"),
        F.var_pop("yl").alias("__vl"), F.min("p").alias("min_prediction"), F.max("p").alias("max_prediction"))
    return row.withColumns({
        "rmse": F.sqrt("mse"), "r2": _r2("mse", "__v"), "r2_log_scale": _r2("mse_log_scale", "__vl"),
        "mape": F.coalesce("mape", F.lit(float("inf"))),
        "explained_variance": F.when(F.col("__v") == 0, 0.0).otherwise(1 - F.col("__ve") / F.col("__v")),
    }).drop("__v", "__ve", "__vl")


def clip_prediction(df: DataFrame, low: float, high: float, prediction: str = "prediction") -> DataFrame:
    return df.withColumn(prediction, F.least(F.greatest(F.col(prediction), F.lit(float(low))), F.lit(float(high))))


def residuals(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Label, prediction and residual columns added as `residual`."""
    return df.withColumn("residual", F.col(label).cast("double") - F.col(prediction))


def residual_histogram(df: DataFrame, label: str = "label", prediction: str = "prediction", bins: int = 30) -> DataFrame:
    return histogram(residuals(df, label, prediction), "residual", bins)


def score_table(df: DataFrame, features: str, model: dict, run_name: str) -> DataFrame:
    """Stored-statistics scaling, prediction, and the model's name on every row.

    `model` holds weights (bias last) and, if it was fitted on scaled features, means and stds.
    """
    x = F.col(features)
    if model.get("means"):
        x = standardise(x, model["means"], model["stds"])
    weights = F.array(*[F.lit(float(w)) for w in model["weights"]])
    return df.withColumns({"prediction": linear_prediction(x, weights), "model": F.lit(model.get("algorithm", "")),
                           "run": F.lit(run_name)})
