"""Parsing and engineered features over the whole listing table (H, I4-I11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopeworks.functions import numeric as N
from slopeworks.functions import text as T
from slopeworks.operators import features as E
from workload.registry import LISTINGS_SQL, listings, query, rounded, table

KEY = ["l_orderkey", "l_linenumber"]


@query("parse_units", f"""
SELECT l_orderkey, l_linenumber, TRY_CAST(nullif(regexp_extract(length, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS length,
  TRY_CAST(nullif(regexp_extract(height, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS height,
  TRY_CAST(nullif(regexp_extract(power, '(\\d+)\\s*hp', 1), '') AS DOUBLE) AS power_hp,
  TRY_CAST(nullif(regexp_extract(replace(power, ',', ''), '@\\s*(\\d+)', 1), '') AS DOUBLE) AS power_rpm FROM ({LISTINGS_SQL})""")
def parse_units(spark, sf):
    return T.parse_units(listings(spark, sf)).select(*KEY, "length", "height", "power_hp", "power_rpm")


_TORQUE = """SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN '--' WHEN p_size % 10 = 1 THEN NULL WHEN p_size % 10 = 2 THEN p_size || ' lb-ft'
  ELSE (p_size * 8) || ' lb-ft @ ' || (p_size % 6 + 1) || ',' || lpad(CAST(p_size AS VARCHAR), 3, '0') || ' RPM' END AS torque FROM part"""


@query("parse_torque", f"""
SELECT p_partkey, TRY_CAST(nullif(regexp_extract(torque, '(\\d+)', 1), '') AS DOUBLE) AS torque_value,
  TRY_CAST(nullif(regexp_extract(replace(torque, ',', ''), '@\\s*(\\d+)', 1), '') AS DOUBLE) AS torque_rpm FROM ({_TORQUE})""")
def parse_torque(spark, sf):
    size = F.col("p_size")
    full = F.concat((size * 8).cast("string"), F.lit(" lb-ft @ "), (size % 6 + 1).cast("string"), F.lit(","), F.lpad(size.cast("string"), 3, "0"), F.lit(" RPM"))
    short = F.concat(size.cast("string"), F.lit(" lb-ft"))
    torque = F.when(size % 10 == 0, "--").when(size % 10 == 2, short).when(size % 10 != 1, full)
    return T.parse_units(table(spark, sf, "part").select("p_partkey", torque.alias("torque"))).select("p_partkey", "torque_value", "torque_rpm")


@query("parse_event_numbers", """
SELECT event_id, TRY_CAST(nullif(regexp_extract(props, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS not_a_number FROM events""")
def event_numbers(spark, sf):
    return table(spark, sf, "events").select("event_id", T.extract_number(F.col("props")).alias("k"), T.to_number(F.col("event_type")).alias("not_a_number"))


@query("parse_first_word", "SELECT p_partkey, split_part(p_name, ' ', 1) AS head, coalesce(p_brand, 'unknown') || '_' || coalesce(CASE WHEN p_size > 25 THEN p_type END, 'unknown') AS joined FROM part")
def first_word(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", T.head_of(F.col("p_name"), " ").alias("head"),
        T.joined_key(F.col("p_brand"), F.when(F.col("p_size") > 25, F.col("p_type"))).alias("joined"))


@query("features_basic", f"""
WITH t AS (SELECT *, TRY_CAST(nullif(regexp_extract(length, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS len, TRY_CAST(nullif(regexp_extract(width, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS wid,
  TRY_CAST(nullif(regexp_extract(height, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS hei, TRY_CAST(nullif(regexp_extract(back_legroom, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS back,
  TRY_CAST(nullif(regexp_extract(front_legroom, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS front, 2002.0::DOUBLE - year AS a FROM ({LISTINGS_SQL}))
SELECT l_orderkey, l_linenumber, a AS age, a * a AS age_squared, coalesce((a > 25)::INTEGER, 0) AS is_classic, round(mileage / (a + 1), 4) AS mileage_per_year,
  coalesce((mileage / (a + 1) > 15000)::INTEGER, 0) AS high_mileage, round((city_fuel_economy + highway_fuel_economy) / 2, 4) AS combined_fuel_economy,
  round(highway_fuel_economy - city_fuel_economy, 4) AS fuel_economy_diff, len * wid * hei AS vehicle_volume, len * wid AS vehicle_footprint,
  back + front AS total_legroom, round(back / (front + 1), 6) AS legroom_ratio, round(horsepower / (len * wid * hei + 1) * 1000, 6) AS power_to_size_ratio,
  round(daysonmarket / 7, 6) AS weeks_on_market, coalesce((daysonmarket < 30)::INTEGER, 0) AS quick_sale FROM t""")
def features_basic(spark, sf):
    out = E.add_features(T.parse_units(listings(spark, sf)), as_of=2002).withColumn("power_to_size_ratio", F.col("power_to_size_ratio") * 1000)
    out = out.select(*KEY, "age", "age_squared", "is_classic", "mileage_per_year", "high_mileage", "combined_fuel_economy", "fuel_economy_diff",
                     "vehicle_volume", "vehicle_footprint", "total_legroom", "legroom_ratio", "power_to_size_ratio", "weeks_on_market", "quick_sale")
    out = rounded(out, 4, "mileage_per_year", "combined_fuel_economy", "fuel_economy_diff")
    return rounded(out, 6, "legroom_ratio", "power_to_size_ratio", "weeks_on_market")


@query("features_interaction", f"""
SELECT l_orderkey, l_linenumber, coalesce(make_name, 'unknown') || '_' || coalesce(model_name, 'unknown') AS make_model,
  CASE WHEN horsepower <= 150 AND horsepower > 0 THEN 'economy' WHEN horsepower <= 250 AND horsepower > 0 THEN 'standard'
       WHEN horsepower <= 350 AND horsepower > 0 THEN 'performance' WHEN horsepower > 350 THEN 'high_performance' END AS performance_category,
  coalesce((lower(make_name) = 'bmw')::INTEGER, 0) AS is_luxury, coalesce((lower(fuel_type) = 'electric')::INTEGER, 0) AS is_electric,
  coalesce((lower(fuel_type) LIKE '%hybrid%')::INTEGER, 0) AS is_hybrid,
  3 - coalesce(has_accidents::INTEGER, 0) - coalesce(frame_damaged::INTEGER, 0) - coalesce(fleet::INTEGER, 0) AS condition_score,
  CASE WHEN price <= 0 THEN NULL WHEN price <= 15000 THEN 'budget' WHEN price <= 30000 THEN 'mid_range' WHEN price <= 50000 THEN 'premium' ELSE 'luxury' END AS price_tier
FROM ({LISTINGS_SQL})""")
def features_interaction(spark, sf):
    out = E.add_features(listings(spark, sf), as_of=2002).withColumn("price_tier", E.price_tier())
    return out.select(*KEY, "make_model", "performance_category", "is_luxury", "is_electric", "is_hybrid", "condition_score", "price_tier")


@query("features_luxury_share", """
WITH t AS (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'BMW' WHEN 'MACHINERY' THEN 'Land Rover' WHEN 'FURNITURE' THEN 'tesla' ELSE c_mktsegment END AS make_name FROM customer)
SELECT make_name, (lower(make_name) IN ('bmw', 'land rover', 'tesla'))::INTEGER AS is_luxury, count(*) AS n FROM t GROUP BY 1, 2""")
def luxury_share(spark, sf):
    s = F.col("c_mktsegment")
    make = F.when(s == "BUILDING", "BMW").when(s == "MACHINERY", "Land Rover").when(s == "FURNITURE", "tesla").otherwise(s)
    rich = E.add_features(table(spark, sf, "customer").select(make.alias("make_name")), as_of=2002)
    return rich.groupBy("make_name", "is_luxury").agg(F.count("*").alias("n"))


@query("scalar_bins_codes", """
SELECT o_orderkey, CASE WHEN o_totalprice <= 10000 THEN NULL WHEN o_totalprice <= 100000 THEN 'low' WHEN o_totalprice <= 300000 THEN 'mid' ELSE 'top' END AS bin,
  CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 END::INTEGER AS code, round(ln(1 + o_totalprice), 8) AS log1p, round(o_totalprice, 4) AS back,
  round(log10(o_totalprice), 8) AS log10, strftime(make_timestamp(o_orderkey * 1000000), '%Y-%m-%d %H:%M:%S') AS at FROM orders""")
def bins_codes(spark, sf):
    p = F.col("o_totalprice")
    out = table(spark, sf, "orders").select(
        "o_orderkey", N.right_closed_bin(p, [10000, 100000, 300000, float("inf")], ["low", "mid", "top"]).alias("bin"),
        N.ordered_code(F.col("o_orderstatus"), ["O", "F"]).cast("int").alias("code"), F.log1p(p).alias("log1p"), F.expm1(F.log1p(p)).alias("back"),
        F.log10(p).alias("log10"), F.date_format(F.timestamp_seconds("o_orderkey"), "yyyy-MM-dd HH:mm:ss").alias("at"))
    return rounded(rounded(out, 8, "log1p", "log10"), 4, "back")


@query("scalar_finite", """
SELECT l_orderkey, l_linenumber, l_linenumber NOT IN (1, 2) AS finite, CASE WHEN l_linenumber IN (1, 2) THEN -1 ELSE l_quantity END::DOUBLE AS replaced FROM lineitem""")
def finite(spark, sf):
    n = F.col("l_linenumber")
    x = F.when(n == 1, float("nan")).when(n == 2, float("-inf")).otherwise(F.col("l_quantity"))
    return table(spark, sf, "lineitem").select(*KEY, N.is_finite(x).alias("finite"), N.finite_or(x, -1).alias("replaced"))
