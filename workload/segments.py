"""Segment reports over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopeworks.operators import segments as G
from workload.registry import query, rounded, table

_PRICED = "SELECT p_brand, p_type, p_size, l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey"


def _priced(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select("p_brand", "p_type", "p_size", "l_extendedprice")


@query("segment_shares", """
WITH s AS (SELECT CASE WHEN l_quantity <= 15 THEN 'small' WHEN l_quantity <= 35 THEN 'middle' ELSE 'large' END AS segment, count(*) AS n, avg(l_extendedprice) AS m
  FROM lineitem GROUP BY 1)
SELECT segment, n, round(n * 100.0 / (SELECT sum(n) FROM s), 6)::DOUBLE AS share_pct, round(m, 4) AS mean_target,
  round((m - b) * 100 / b, 6) + 0.0 AS vs_reference_pct FROM s, (SELECT m AS b FROM s WHERE segment = 'middle')""")
def shares(spark, sf):
    out = G.segment_shares(table(spark, sf, "lineitem"), "l_quantity", [0, 15, 35, float("inf")], ["small", "middle", "large"], "l_extendedprice")
    return rounded(rounded(out, 6, "share_pct", "vs_reference_pct"), 4, "mean_target")


@query("segment_tiers", f"""
WITH b AS (SELECT p_brand, count(*) AS n, avg(l_extendedprice) AS m FROM ({_PRICED}) GROUP BY 1),
t AS (SELECT CASE WHEN m <= 52500 THEN 'low' WHEN m <= 53500 THEN 'mid' ELSE 'high' END AS tier, count(*) AS n_groups, sum(n)::BIGINT AS n_rows, sum(m * n) / sum(n) AS mt FROM b GROUP BY 1)
SELECT tier, n_groups, n_rows, round(mt, 4) AS mean_target, round(n_rows * 100.0 / (SELECT sum(n_rows) FROM t), 6)::DOUBLE AS share_pct FROM t""")
def tiers(spark, sf):
    out = G.group_tiers(_priced(spark, sf), "p_brand", "l_extendedprice", [0, 52500, 53500, float("inf")], ["low", "mid", "high"])
    return rounded(rounded(out, 4, "mean_target"), 6, "share_pct")


_GROUPS = f"g AS (SELECT p_brand, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v, stddev_samp(l_extendedprice) / avg(l_extendedprice) AS cv FROM ({_PRICED}) GROUP BY 1)"


@query("segment_variation", f"WITH {_GROUPS} SELECT p_brand, n, round(m, 4) AS mean_target, round(v, 0) AS variance, round(cv, 8) AS variation FROM g")
def variation(spark, sf):
    return rounded(rounded(rounded(G.group_variation(_priced(spark, sf), "p_brand", "l_extendedprice"), 4, "mean_target"), 0, "variance"), 8, "variation")


@query("segment_anova", f"""
WITH {_GROUPS}, a AS (SELECT sum(n * m) / sum(n) AS grand FROM g),
s AS (SELECT count(*) AS k, sum(n)::BIGINT AS n, sum(n * (m - grand) ** 2) AS b, sum((n - 1) * v) AS w FROM g, a)
SELECT k, n, round((b / (k - 1)) / (w / (n - k)), 6) AS f_value, round(b / (b + w), 8) AS eta_squared FROM s""")
def anova(spark, sf):
    return rounded(rounded(G.group_anova(_priced(spark, sf), "p_brand", "l_extendedprice"), 6, "f_value"), 8, "eta_squared")


_KEPT = f"""WITH a AS (SELECT p_brand, (p_size - 1)::INTEGER AS age, avg(l_extendedprice) AS m, count(*) AS n FROM ({_PRICED}) GROUP BY 1, 2),
r AS (SELECT a.*, z.m AS new_mean, a.m * 100 / z.m AS retention_pct FROM a LEFT JOIN a z ON z.p_brand IS NOT DISTINCT FROM a.p_brand AND z.age = 0)"""


@query("segment_retention", f"{_KEPT} SELECT p_brand, age, n, round(m, 4) AS mean_target, round(new_mean, 4) AS new_mean, round(retention_pct, 6) AS retention_pct FROM r")
def retention(spark, sf):
    out = G.retention(_priced(spark, sf).withColumn("age", F.col("p_size") - 1), "p_brand", "age", "l_extendedprice")
    return rounded(rounded(out, 4, "mean_target", "new_mean"), 6, "retention_pct")


@query("segment_retention_slowest", f"{_KEPT} SELECT p_brand, round(retention_pct, 6) AS retention_pct FROM r WHERE age = 5 AND retention_pct IS NOT NULL ORDER BY r.retention_pct DESC, p_brand LIMIT 5")
def slowest(spark, sf):
    out = G.retention_extremes(_priced(spark, sf).withColumn("age", F.col("p_size") - 1), "p_brand", "age", "l_extendedprice")
    return rounded(out.select("p_brand", "retention_pct"), 6, "retention_pct")


@query("segment_age_bands", f"""
SELECT CASE WHEN p_size - 1 <= 2 THEN '0-2' WHEN p_size - 1 <= 7 THEN '3-7' WHEN p_size - 1 <= 15 THEN '8-15' ELSE '16+' END AS band, count(*) AS n,
  round(avg(l_extendedprice), 4) AS mean_target FROM ({_PRICED}) GROUP BY 1""")
def bands(spark, sf):
    return rounded(G.age_segments(_priced(spark, sf).withColumn("age", F.col("p_size") - 1), "age", "l_extendedprice"), 4, "mean_target")
