"""Registry of queries and helpers shared by them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; `sql` is its equivalent on the same tables."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Rounds to `digits` places; adding 0.0 turns a negative zero into zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def union_all(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)


LISTINGS_SQL = """
SELECT l.l_orderkey, l.l_linenumber, l.l_extendedprice AS price, CAST(year(l.l_shipdate) - p.p_size AS INTEGER) AS year,
  CASE WHEN p.p_partkey % 25 = 3 THEN NULL ELSE ' ' || upper(p.p_brand) || '  Motors ' END AS make_name, p.p_type AS model_name,
  CASE l.l_returnflag WHEN 'A' THEN 'Electric' WHEN 'R' THEN 'Plug-in Hybrid' ELSE 'Gasoline' END AS fuel_type,
  CASE WHEN l.l_orderkey % 9 = 0 THEN NULL ELSE l.l_quantity * 11000 END AS mileage,
  CASE WHEN l.l_partkey % 30 = 0 THEN NULL ELSE p.p_size * 9.5::DOUBLE END AS horsepower,
  CASE WHEN l.l_suppkey % 4 = 0 THEN NULL ELSE l.l_quantity END AS city_fuel_economy, l.l_quantity * 1.25::DOUBLE + 2 AS highway_fuel_economy,
  CAST(round(l.l_tax * 1000) AS INTEGER) AS daysonmarket,
  CAST(p.p_size + 150 AS VARCHAR) || '.5 in' AS length, CAST(p.p_size + 60 AS VARCHAR) || ' in' AS width,
  CASE WHEN p.p_size = 7 THEN '--' ELSE CAST(p.p_size + 50 AS VARCHAR) || ' in' END AS height,
  CAST(p.p_size + 20 AS VARCHAR) || ' in' AS back_legroom, CAST(p.p_size + 30 AS VARCHAR) || ' in' AS front_legroom,
  CAST(p.p_size * 5 AS VARCHAR) || ' hp @ 5,' || lpad(CAST(p.p_size AS VARCHAR), 3, '0') || ' RPM' AS power,
  CASE WHEN l.l_linenumber = 3 THEN NULL ELSE l.l_discount > 0.05 END AS has_accidents,
  l.l_linestatus = 'F' AS frame_damaged, CASE WHEN l.l_linenumber = 5 THEN NULL ELSE l.l_quantity > 40 END AS fleet,
  CASE WHEN l.l_suppkey % 5 < 3 THEN NULL ELSE CAST(l.l_linenumber AS DOUBLE) END AS owner_count
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
"""


def listings(spark: SparkSession, sf: str) -> DataFrame:
    """A listing table with nulls, unit strings and untidy text, computed from every lineitem and its part."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    c, null = F.col, F.lit(None)
    size = c("p_size")

    def text(n):
        return n.cast("string")

    return li.join(p, c("l_partkey") == c("p_partkey")).select(
        "l_orderkey", "l_linenumber", c("l_extendedprice").alias("price"), (F.year("l_shipdate") - size).alias("year"),
        F.when(c("p_partkey") % 25 == 3, null).otherwise(F.concat(F.lit(" "), F.upper("p_brand"), F.lit("  Motors "))).alias("make_name"),
        c("p_type").alias("model_name"),
        F.when(c("l_returnflag") == "A", "Electric").when(c("l_returnflag") == "R", "Plug-in Hybrid").otherwise("Gasoline").alias("fuel_type"),
        F.when(c("l_orderkey") % 9 == 0, null).otherwise(c("l_quantity") * 11000).alias("mileage"),
        F.when(c("l_partkey") % 30 == 0, null).otherwise(size * 9.5).alias("horsepower"),
        F.when(c("l_suppkey") % 4 == 0, null).otherwise(c("l_quantity")).alias("city_fuel_economy"),
        (c("l_quantity") * 1.25 + 2).alias("highway_fuel_economy"), F.round(c("l_tax") * 1000).cast("int").alias("daysonmarket"),
        F.concat(text(size + 150), F.lit(".5 in")).alias("length"), F.concat(text(size + 60), F.lit(" in")).alias("width"),
        F.when(size == 7, "--").otherwise(F.concat(text(size + 50), F.lit(" in"))).alias("height"),
        F.concat(text(size + 20), F.lit(" in")).alias("back_legroom"), F.concat(text(size + 30), F.lit(" in")).alias("front_legroom"),
        F.concat(text(size * 5), F.lit(" hp @ 5,"), F.lpad(text(size), 3, "0"), F.lit(" RPM")).alias("power"),
        F.when(c("l_linenumber") == 3, null).otherwise(c("l_discount") > 0.05).alias("has_accidents"),
        (c("l_linestatus") == "F").alias("frame_damaged"),
        F.when(c("l_linenumber") == 5, null).otherwise(c("l_quantity") > 40).alias("fleet"),
        F.when(c("l_suppkey") % 5 < 3, null).otherwise(c("l_linenumber").cast("double")).alias("owner_count"))


LABELLED_SQL = """
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, 'fixed' AS origin
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their labels where there are any: a table with real nulls and a constant column."""
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(lab, "doc_id", "left").select("doc_id", "lang", "source", "n_chars", "quality", "toxic", F.lit("fixed").alias("origin"))
