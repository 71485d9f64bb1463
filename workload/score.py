"""Scoring and evaluation over whole tables (A4-A6, A11, H17, H19, L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopeworks.functions.vectors import sparsify, weight_stats
from slopeworks.operators import evaluate as V
from slopeworks.operators.gram import gram_stats, normal_equations
from slopeworks.operators.split import split_exact
from slopeworks.operators.ranking import multiplicative_hash
from slopeworks.session import shared_folder
from slopeworks.sources import tables as S
from workload.registry import ORACLES, query, rounded, table

_SCORED = "SELECT *, ln(1 + l_extendedprice) AS label, 0.02 * l_quantity - 0.5 * l_discount + 9.8::DOUBLE AS prediction FROM lineitem"
_FEATURES, _WEIGHTS = ["l_quantity", "l_discount"], [0.02, -0.5, 9.8]


def _lines(spark, sf):
    return table(spark, sf, "lineitem").withColumn("label", F.log1p("l_extendedprice"))


def _scored(spark, sf):
    return V.predict(_lines(spark, sf), _FEATURES, _WEIGHTS)


def _metrics_sql(keys: str = "", group: str = "") -> str:
    return f"""
WITH t AS (SELECT *, exp(label) - 1 AS y, exp(prediction) - 1 AS p FROM ({_SCORED}))
SELECT {keys} count(*) AS n, round(avg((y - p) ** 2), 2) AS mse, round(avg(abs(y - p)), 4) AS mae, round(max(abs(y - p)), 4) AS max_error,
  round(avg(abs((y - p) / y)) * 100, 6) AS mape, round(avg((label - prediction) ** 2), 8) AS mse_log_scale, round(avg(abs(label - prediction)), 8) AS mae_log_scale,
  round(min(p), 4) AS min_prediction, round(max(p), 4) AS max_prediction, round(sqrt(avg((y - p) ** 2)), 4) AS rmse,
  round(1 - avg((y - p) ** 2) / var_pop(y), 8) AS r2, round(1 - avg((label - prediction) ** 2) / var_pop(label), 8) AS r2_log_scale,
  round(1 - var_pop(y - p) / var_pop(y), 8) AS explained_variance FROM t {group}"""


def _round_metrics(df):
    df = rounded(rounded(df, 2, "mse"), 4, "mae", "max_error", "min_prediction", "max_prediction", "rmse")
    return rounded(rounded(df, 6, "mape"), 8, "mse_log_scale", "mae_log_scale", "r2", "r2_log_scale", "explained_variance")


@query("score_linear", f"SELECT l_orderkey, l_linenumber, round(prediction, 8) AS prediction FROM ({_SCORED})")
def linear(spark, sf):
    return rounded(_scored(spark, sf).select("l_orderkey", "l_linenumber", "prediction"), 8, "prediction")


@query("score_arrays", f"SELECT l_orderkey, l_linenumber, round(prediction, 8) AS prediction FROM ({_SCORED})")
def arrays(spark, sf):
    df = _lines(spark, sf).withColumn("x", F.array(*_FEATURES))
    return rounded(V.predict_array(df, "x", _WEIGHTS).select("l_orderkey", "l_linenumber", "prediction"), 8, "prediction")


@query("score_with_stored_model", """
SELECT l_orderkey, l_linenumber, round(0.3 * (l_quantity - 25) / 14 - 0.01 * (l_discount - 0.05) / 0.03 + 10, 8) AS prediction, 'ridge' AS model, 'night' AS run FROM lineitem""")
def stored_model(spark, sf):
    model = {"weights": [0.3, -0.01, 10.0], "means": [25.0, 0.05], "stds": [14.0, 0.03], "algorithm": "ridge"}
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array(*_FEATURES).alias("x"))
    return rounded(V.score_table(df, "x", model, "night").drop("x"), 8, "prediction")


@query("score_by_group", """
WITH m AS (SELECT l_suppkey, regr_slope(ln(1 + l_extendedprice), l_quantity) AS w, regr_intercept(ln(1 + l_extendedprice), l_quantity) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_suppkey, round(w * l_quantity + b, 6) AS prediction FROM lineitem JOIN m USING (l_suppkey)""")
def by_group(spark, sf):
    df = _lines(spark, sf)
    models = normal_equations(gram_stats(df, ["l_quantity"], "label", ["l_suppkey"]), ["l_suppkey"])
    out = V.predict_by_group(df, ["l_quantity"], models, ["l_suppkey"])
    return rounded(out.select("l_orderkey", "l_linenumber", "l_suppkey", "prediction"), 6, "prediction")


@query("evaluate_basic", f"""
SELECT count(*) AS n, round(avg((label - prediction) ** 2), 8) AS mse, round(avg(abs(label - prediction)), 8) AS mae,
  round(sqrt(avg((label - prediction) ** 2)), 8) AS rmse, round(1 - avg((label - prediction) ** 2) / var_pop(label), 8) AS r2 FROM ({_SCORED})""")
def basic(spark, sf):
    return rounded(V.regression_metrics(_scored(spark, sf)), 8, "mse", "mae", "rmse", "r2")


@query("evaluate_full", _metrics_sql())
def full(spark, sf):
    return _round_metrics(V.full_metrics(_scored(spark, sf)))


@query("evaluate_by_group", _metrics_sql("l_returnflag,", "GROUP BY l_returnflag"))
def grouped(spark, sf):
    return _round_metrics(V.full_metrics(_scored(spark, sf), group_cols=["l_returnflag"]))


@query("evaluate_clipped", f"""
SELECT l_orderkey, l_linenumber, round(least(greatest(prediction, 10), 10.5), 8)::DOUBLE AS prediction, round(label - least(greatest(prediction, 10), 10.5), 8)::DOUBLE AS residual FROM ({_SCORED})""")
def clipped(spark, sf):
    out = V.residuals(V.clip_prediction(_scored(spark, sf), 10, 10.5))
    return rounded(out.select("l_orderkey", "l_linenumber", "prediction", "residual"), 8, "prediction", "residual")


@query("evaluate_residual_bins", f"""
WITH x AS (SELECT label - prediction AS v FROM ({_SCORED})), b AS (SELECT min(v) AS lo, (max(v) - min(v)) / 30 AS w FROM x),
c AS (SELECT least(floor((v - lo) / w), 29)::INTEGER AS bin, count(*) AS n FROM x, b GROUP BY 1)
SELECT g.bin::INTEGER AS bin, round(lo + g.bin * w, 6) AS lower, round(lo + (g.bin + 1) * w, 6) AS upper, coalesce(c.n, 0)::BIGINT AS n
FROM (SELECT unnest(range(30)) AS bin) g CROSS JOIN b LEFT JOIN c ON c.bin = g.bin""")
def residual_bins(spark, sf):
    return rounded(V.residual_histogram(_scored(spark, sf)), 6, "lower", "upper")


_H = "((o_orderkey + 7) % 2147483648 * 2654435761) % 4294967296"
_SPLIT = f"""SELECT *, ln(1 + o_totalprice) AS label, CASE WHEN row_number() OVER (ORDER BY {_H}, o_orderkey) <= ceil((SELECT count(*) FROM orders) * 0.2 - 1e-9)
  THEN 'test' ELSE 'train' END AS split FROM orders"""


@query("matrix_metadata", f"""
SELECT split, count(*) AS n_rows, 2::BIGINT AS n_features, round(min(label), 6) AS min_log, round(max(label), 6) AS max_log, round(avg(label), 6) AS mean_log,
  round(min(o_totalprice), 3) AS min_target, round(max(o_totalprice), 3) AS max_target, round(avg(o_totalprice), 3) AS mean_target, true AS same_length, true AS all_finite
FROM ({_SPLIT}) GROUP BY split""")
def metadata(spark, sf):
    """Writes the model matrix, reads both splits back, reports on them."""
    df = table(spark, sf, "orders").withColumns({"label": F.log1p("o_totalprice"), "day": F.dayofyear("o_orderdate"), "k": F.col("o_custkey")})
    parted = split_exact(df, "o_orderkey", hashed=multiplicative_hash("o_orderkey", 7))
    path = shared_folder(spark)
    S.write_matrix(S.assemble(parted, ["day", "k"], "label", ["o_orderkey", "split"]), path)
    train, test = S.read_matrix(spark, path)
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    out = rounded(S.matrix_metadata(both), 6, "min_log", "max_log", "mean_log")
    return rounded(out, 3, "min_target", "max_target", "mean_target")


@query("matrix_align", "SELECT o_orderkey AS row_id, o_custkey::DOUBLE AS feature, o_totalprice AS label FROM orders")
def align(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "row_id")
    x = o.select("row_id", F.array(F.col("o_custkey").cast("double")).alias("features"))
    both = S.align(x, o.select("row_id", F.col("o_totalprice").alias("label")))
    return both.select("row_id", F.col("features")[0].alias("feature"), "label")


@query("matrix_align_stored", ORACLES["matrix_align"])
def align_stored(spark, sf):
    """Features and labels stored apart in buckets, matched bucket with bucket."""
    o, path = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "row_id"), shared_folder(spark)
    S.write_buckets(o.select("row_id", F.array(F.col("o_custkey").cast("double")).alias("features")), f"{path}/x", 8)
    S.write_buckets(o.select("row_id", F.col("o_totalprice").alias("label")), f"{path}/y", 8)
    both = S.align_stored(spark, f"{path}/x", f"{path}/y")
    return both.select("row_id", F.col("features")[0].alias("feature"), "label")


@query("model_state", """
SELECT 'ols' AS run_id, round(avg(l_quantity), 6) AS mean_1, round(stddev_pop(l_discount), 6) AS std_2, min(l_quantity) AS min_1, max(l_discount) AS max_2,
  round(avg(ln(1 + l_extendedprice)), 6) AS target_mean, round(stddev_pop(ln(1 + l_extendedprice)), 6) AS target_std, 3 AS n_weights FROM lineitem""")
def state(spark, sf):
    """Fits, saves with the training statistics, loads again."""
    df = _lines(spark, sf)
    model = normal_equations(gram_stats(df, _FEATURES, "label")).select(F.lit("ols").alias("run_id"), "weights")
    path = shared_folder(spark)
    S.save_state(S.model_state(df, model, _FEATURES, "label"), path)
    out = spark.read.parquet(path).select(
        "run_id", F.col("means")[0].alias("mean_1"), F.col("stds")[1].alias("std_2"), F.col("mins")[0].alias("min_1"), F.col("maxs")[1].alias("max_2"),
        "target_mean", "target_std", F.size("weights").alias("n_weights"))
    return rounded(out, 6, "mean_1", "std_2", "target_mean", "target_std")


@query("weights_statistics", """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS w FROM embeddings), h AS (SELECT vec_id, w, w[1:len(w) - 1] AS v FROM e)
SELECT vec_id, len(v)::BIGINT AS n_features, round(list_min(v), 6) AS min_weight, round(list_max(v), 6) AS max_weight, round(list_avg(v), 6) + 0.0 AS mean_weight,
  round(list_stddev_pop(v), 6) AS std_weight, round(w[-1], 6) + 0.0 AS bias FROM h""")
def weights(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("w"))
    out = e.select("vec_id", weight_stats(F.col("w")).alias("s")).select("vec_id", "s.*")
    return rounded(out, 6, "min_weight", "max_weight", "mean_weight", "std_weight", "bias")


@query("weights_sparsified", """
SELECT vec_id, count(*) FILTER (abs(x) < 0.05)::BIGINT AS zeros, round(sum(CASE WHEN abs(x) < 0.05 THEN 0 ELSE x END), 5) + 0.0 AS total
FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY 1""")
def sparsified(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", sparsify(F.col("embedding").cast("array<double>"), 0.05).alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    return rounded(e.select("vec_id", F.size(F.filter("w", lambda x: x == 0.0)).cast("long").alias("zeros"), total.alias("total")), 5, "total")


@query("score_with_loaded_model", """
WITH f AS (SELECT regr_slope(ln(1 + l_extendedprice), l_quantity) AS w, regr_intercept(ln(1 + l_extendedprice), l_quantity) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, round(w * l_quantity + b, 6) AS prediction, 'night' AS run FROM lineitem, f""")
def loaded_model(spark, sf):
    """Fits on scaled features, stores the model with their statistics, loads it, scores all rows, writes and reads them."""
    df = _lines(spark, sf)
    mean, spread = df.agg(F.avg("l_quantity"), F.stddev_pop("l_quantity")).first()
    scaled = df.withColumn("z", (F.col("l_quantity") - mean) / spread)
    model = normal_equations(gram_stats(scaled, ["z"], "label")).select(F.lit("night").alias("run_id"), "weights")
    path = shared_folder(spark)
    S.save_state(S.model_state(df, model, ["l_quantity"], "label"), f"{path}/model")
    state = S.load_state(spark, f"{path}/model", "night")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity").alias("x"))
    V.score_table(rows, "x", state, state["run_id"]).drop("x", "model").write.parquet(f"{path}/scored")
    return rounded(spark.read.parquet(f"{path}/scored"), 6, "prediction")
