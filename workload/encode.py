"""Encoders, splits, samples and batches over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopeworks.operators import encode as E
from slopeworks.operators import split as S
from slopeworks.operators.ranking import multiplicative_hash
from workload.registry import query, rounded, table

HASH = "((({k}) + {s}) % 2147483648 * 2654435761) % 4294967296"


def _priced(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    brand = F.when(F.col("p_partkey") % 13 != 0, F.col("p_brand")).alias("brand")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", "l_extendedprice", brand, "p_type", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "p_name")


_PRICED = """SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN p_partkey % 13 <> 0 THEN p_brand END AS brand, p_type, l_returnflag AS flag,
  l_linestatus AS status, p_name FROM lineitem JOIN part ON l_partkey = p_partkey"""
_TARGET = f"""WITH t AS ({_PRICED}), g AS (SELECT avg(l_extendedprice) AS g FROM t),
m AS (SELECT brand, count(*) AS n, avg(l_extendedprice) AS m FROM t WHERE brand IS NOT NULL GROUP BY 1)"""


@query("encode_target_means", f"{_TARGET} SELECT brand, n, round(m, 4) AS mean_target FROM m")
def target_means(spark, sf):
    return rounded(E.target_means(_priced(spark, sf), "brand", "l_extendedprice"), 4, "mean_target")


@query("encode_target", f"""{_TARGET}
SELECT l_orderkey, l_linenumber, l_extendedprice, round(coalesce((m * n + g * 30) / (n + 30), g), 4) AS brand_target_encoded
FROM t LEFT JOIN m USING (brand) CROSS JOIN g""")
def target(spark, sf):
    df = _priced(spark, sf)
    encoding, overall = E.fit_target_encoding(df, "brand", "l_extendedprice")
    out = E.apply_target_encoding(df, "brand", encoding, overall)
    return rounded(out.select("l_orderkey", "l_linenumber", "l_extendedprice", "brand_target_encoded"), 4, "brand_target_encoded")


@query("encode_target_salted", f"""{_TARGET}
SELECT l_orderkey, l_linenumber, l_extendedprice, round(coalesce(m, 0), 4) AS mean_target FROM t LEFT JOIN m USING (brand)""")
def target_salted(spark, sf):
    """The lookup beyond the broadcast bound, with every brand treated as hot, forced here."""
    from slopeworks.operators.joins import salted_join

    df = _priced(spark, sf)
    means = E.target_means(df, "brand", "l_extendedprice")
    hot = [(f"Brand#{i}",) for i in range(1, 26)]
    out = salted_join(df, means, ["brand"], "left", hot, salts=4)
    out = out.withColumn("mean_target", F.coalesce("mean_target", F.lit(0.0)))
    return rounded(out.select("l_orderkey", "l_linenumber", "l_extendedprice", "mean_target"), 4, "mean_target")


@query("encode_label", """
SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INTEGER AS c_mktsegment_label_encoded FROM customer""")
def label(spark, sf):
    return E.label_encode(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").drop("c_mktsegment")


@query("encode_label_many", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_name) - 1)::INTEGER AS code FROM part")
def label_many(spark, sf):
    return E.label_encode(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "code").drop("p_name")


@query("encode_one_hot", """
WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 6 <> 0 THEN p_type END AS kind FROM part)
SELECT p_partkey, coalesce((kind = 'LARGE')::INTEGER, 0) AS kind_large, coalesce((kind = 'MEDIUM')::INTEGER, 0) AS kind_medium,
  coalesce((kind = 'PROMO')::INTEGER, 0) AS kind_promo, coalesce((kind = 'SMALL')::INTEGER, 0) AS kind_small,
  coalesce((kind = 'STANDARD')::INTEGER, 0) AS kind_standard FROM t""")
def one_hot(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 6 != 0, F.col("p_type")).alias("kind"))
    return E.one_hot(df, "kind").drop("kind")


@query("encode_by_cardinality", f"""{_TARGET},
lv AS (SELECT brand, (dense_rank() OVER (ORDER BY brand) - 1)::INTEGER AS code FROM (SELECT DISTINCT brand FROM t WHERE brand IS NOT NULL))
SELECT l_orderkey, l_linenumber, l_extendedprice, round(coalesce((m * n + g * 30) / (n + 30), g), 4) AS brand_target_encoded, code AS brand_label_encoded,
  (status = 'O')::INTEGER AS status_encoded, (flag = 'N')::INTEGER AS flag_n, (flag = 'R')::INTEGER AS flag_r
FROM t LEFT JOIN m USING (brand) LEFT JOIN lv USING (brand) CROSS JOIN g""")
def by_cardinality(spark, sf):
    """25 brands: label and target; 2 states: label; 3 flags: one-hot."""
    df = _priced(spark, sf).drop("p_type", "p_name")
    plan = E.fit_encoding(df, "l_extendedprice", target_encoded=["brand"])
    return rounded(plan.transform(df), 4, "brand_target_encoded")


_H = HASH.format(k="o_orderkey", s=42)


@query("split_exact", f"""
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {_H}, o_orderkey) <= ceil((SELECT count(*) FROM orders) * 0.2 - 1e-9) THEN 'test' ELSE 'train' END AS split
FROM orders""")
def split_exact(spark, sf):
    return S.split_exact(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", hashed=multiplicative_hash("o_orderkey", 42))


@query("split_by_hash", f"SELECT o_orderkey, CASE WHEN {_H} < floor(4294967296 * 0.2) THEN 'test' ELSE 'train' END AS split FROM orders")
def split_by_hash(spark, sf):
    return S.split_by_hash(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", hashed=multiplicative_hash("o_orderkey", 42))


_SAMPLE = f"SELECT * FROM orders ORDER BY {_H}, o_orderkey LIMIT 500"


@query("sample_exact", f"SELECT o_orderkey, o_totalprice FROM ({_SAMPLE})")
def sample_exact(spark, sf):
    return S.sample_exact(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500, hashed=multiplicative_hash("o_orderkey", 42))


@query("sample_stratified", f"""
SELECT o_orderkey, o_orderstatus FROM orders WHERE {_H} < CASE o_orderstatus WHEN 'O' THEN floor(4294967296 * 0.1) WHEN 'F' THEN floor(4294967296 * 0.5) ELSE 0 END""")
def sample_stratified(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return S.sample_stratified(df, "o_orderstatus", {"O": 0.1, "F": 0.5}, "o_orderkey", hashed=multiplicative_hash("o_orderkey", 42))


@query("sample_quality", f"""
SELECT 'source' AS rows_of, count(*) AS n, 'o_totalprice' AS column, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std FROM orders
UNION ALL SELECT 'sample', count(*), 'o_totalprice', round(avg(o_totalprice), 4), round(stddev_samp(o_totalprice), 4) FROM ({_SAMPLE})""")
def sample_quality(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    sample = S.sample_exact(df, "o_orderkey", 500, hashed=multiplicative_hash("o_orderkey", 42))
    return rounded(S.sample_quality(df, sample, ["o_totalprice"]), 4, "mean", "std")


@query("split_batches", f"SELECT o_orderkey, floor((row_number() OVER (ORDER BY {_H}, o_orderkey) - 1) / 256)::BIGINT AS batch_id FROM orders")
def batches(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey")
    return S.with_batches(df, "o_orderkey", 256, hashed=multiplicative_hash("o_orderkey", 42))
