"""Streaming jobs run to their end over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopeworks.session import shared_folder
from slopeworks.streaming import jobs as J
from workload.registry import query, rounded, table


def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    return J.read_stream(spark, f"{sf}/{name}.parque[t]", schema)


@query("stream_cleaned_ingest", "SELECT c_custkey, lower(c_mktsegment) AS c_mktsegment, lower(c_name) AS c_name, c_nationkey, c_acctbal FROM customer")
def ingest(spark, sf):
    path = shared_folder(spark)
    J.write_stream(J.clean_stream(_stream(spark, sf, "customer")), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("stream_incremental_regression", """
SELECT l_returnflag, count(*)::DOUBLE AS n, round(regr_slope(ln(1 + l_extendedprice), l_quantity), 8) AS slope,
  round(regr_intercept(ln(1 + l_extendedprice), l_quantity), 6) AS intercept FROM lineitem GROUP BY 1""")
def regression(spark, sf):
    path = shared_folder(spark)
    lines = _stream(spark, sf, "lineitem").withColumn("y", F.log1p("l_extendedprice"))
    J.accumulate_stats(lines, ["l_quantity"], "y", f"{path}/stats", f"{path}/checkpoint", ["l_returnflag"]).awaitTermination()
    fit = J.current_model(spark, f"{path}/stats", ["l_returnflag"])
    out = fit.select("l_returnflag", "n", F.col("weights")[0].alias("slope"), F.col("weights")[1].alias("intercept"))
    return rounded(rounded(out, 8, "slope"), 6, "intercept")


@query("stream_scored", "SELECT o_orderkey, round((o_custkey - 100) / 50 * 0.5 + 3, 6) AS prediction, 'ols' AS model, 'live' AS run FROM orders")
def scored(spark, sf):
    path = shared_folder(spark)
    orders = _stream(spark, sf, "orders").select("o_orderkey", F.array(F.col("o_custkey").cast("double")).alias("x"))
    model = {"weights": [0.5, 3.0], "means": [100.0], "stds": [50.0], "algorithm": "ols"}
    J.write_stream(J.score_stream(orders, "x", model, "live"), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return rounded(spark.read.parquet(f"{path}/out").drop("x"), 6, "prediction")
