"""Cleaning, validity and imputation over whole tables (A2, A3, B, D21, D22, E1, G, I1-I3, I22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopeworks.functions.text import clean_text_columns, normalise_columns
from slopeworks.operators import clean as C
from slopeworks.operators import impute as I
from slopeworks.sources import tables as S
from workload.registry import LABELLED_SQL, LISTINGS_SQL, labelled, listings, query, rounded, table, union_all


@query("clean_column_names", "SELECT c_custkey AS cust_key, c_name AS full_name, c_acctbal AS acct_bal_2 FROM customer")
def column_names(spark, sf):
    messy = table(spark, sf, "customer").select(
        F.col("c_custkey").alias(" Cust Key "), F.col("c_name").alias("Full--NAME"), F.col("c_acctbal").alias("_Acct.Bal (2)"))
    return normalise_columns(messy)


@query("clean_distinct_rows", "SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag FROM lineitem")
def distinct_rows(spark, sf):
    return C.drop_duplicate_rows(table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag"))


@query("clean_below_quantile", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0
  AND o_totalprice < (SELECT quantile_cont(o_totalprice, 0.995) FROM orders WHERE o_totalprice > 0)""")
def below_quantile(spark, sf):
    return C.below_quantile(C.positive(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice"), "o_totalprice")


_CLEANED = f"""
WITH d AS (SELECT DISTINCT * FROM ({LISTINGS_SQL})), p AS (SELECT * FROM d WHERE price > 0),
q AS (SELECT quantile_cont(price, 0.995) AS q FROM p)
SELECT p.* FROM p, q WHERE price < q AND year >= 1900 AND year <= 1991 AND mileage >= 0 AND mileage < 500000"""


@query("clean_listings", f"SELECT l_orderkey, l_linenumber, price, year, mileage FROM ({_CLEANED})")
def clean_listings(spark, sf):
    return C.clean_listings(listings(spark, sf), as_of=1990).select("l_orderkey", "l_linenumber", "price", "year", "mileage")


@query("clean_text_columns", f"""
SELECT l_orderkey, l_linenumber, nullif(trim(regexp_replace(lower(make_name), '\\s+', ' ', 'g')), '') AS make_name,
  nullif(trim(regexp_replace(lower(fuel_type), '\\s+', ' ', 'g')), '') AS fuel_type FROM ({LISTINGS_SQL})""")
def text_columns(spark, sf):
    return clean_text_columns(listings(spark, sf).select("l_orderkey", "l_linenumber", "make_name", "fuel_type"))


@query("clean_document_text", """
SELECT doc_id, md5(nullif(trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '')) AS digest FROM documents""")
def document_text(spark, sf):
    cleaned = clean_text_columns(table(spark, sf, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("clean_drop_mostly_null", f"SELECT doc_id, lang, source, n_chars, origin FROM ({LABELLED_SQL})")
def drop_mostly_null(spark, sf):
    return C.drop_mostly_null(labelled(spark, sf))


@query("clean_drop_null_rows", f"SELECT * FROM ({LABELLED_SQL}) WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def drop_null_rows(spark, sf):
    return I.impute(labelled(spark, sf), "drop")


@query("clean_drop_null_target", f"SELECT doc_id, quality FROM ({LABELLED_SQL}) WHERE quality IS NOT NULL")
def drop_null_target(spark, sf):
    return labelled(spark, sf).select("doc_id", "quality").dropna(subset=["quality"])


@query("clean_numeric_matrix", "SELECT p_partkey, 2 AS width, p_size::DOUBLE AS f0, p_retailprice AS f1 FROM part")
def numeric_matrix(spark, sf):
    out = C.numeric_matrix(table(spark, sf, "part"), keep=["p_partkey"])
    return out.select("p_partkey", F.size("features").alias("width"), F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"))


@query("clean_final_types", f"""
SELECT l_orderkey, l_linenumber, year, mileage, TRY_CAST(make_name AS DOUBLE) AS none_, daysonmarket, frame_damaged::INTEGER AS frame_damaged,
  owner_count, TRY_CAST(CASE WHEN l_linenumber = 2 THEN CAST(year AS VARCHAR) ELSE 'n/a' END AS DOUBLE) AS mixed,
  CASE fuel_type WHEN 'Gasoline' THEN 0 WHEN 'Electric' THEN 1 END::DOUBLE AS fuel_type FROM ({LISTINGS_SQL})""".replace(
    "TRY_CAST(make_name AS DOUBLE) AS none_, ", ""))
def final_types(spark, sf):
    df = listings(spark, sf).select(
        "l_orderkey", "l_linenumber", "year", "mileage", "make_name", "daysonmarket", "frame_damaged", "owner_count", "fuel_type",
        F.when(F.col("l_linenumber") == 2, F.col("year").cast("string")).otherwise("n/a").alias("mixed"))
    return C.final_types(df, ["l_orderkey", "l_linenumber"], {"fuel_type": ["Gasoline", "Electric"]})


_BAD = """SELECT CASE WHEN l_orderkey % 50 = 0 THEN NULL WHEN l_orderkey % 50 = 1 THEN 'nan'::DOUBLE WHEN l_orderkey % 50 = 2 THEN 'inf'::DOUBLE
  ELSE l_quantity END AS a, l_tax AS b, l_suppkey AS s FROM lineitem"""


def _bad(spark, sf):
    k = F.col("l_orderkey") % 50
    return table(spark, sf, "lineitem").select(
        F.when(k == 1, float("nan")).when(k == 2, float("inf")).when(k != 0, F.col("l_quantity")).alias("a"), F.col("l_tax").alias("b"),
        F.col("l_suppkey").alias("s"))


@query("clean_validity", union_all([f"""
SELECT '{c}' AS column, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(*) FILTER (isnan({c})) AS n_nan,
  count(*) FILTER (isinf({c})) AS n_inf, count(*) FILTER ({c} IS NULL OR isnan({c}) OR isinf({c})) = 0 AS valid FROM ({_BAD})""" for c in "ab"]))
def validity(spark, sf):
    return C.validity(_bad(spark, sf), ["a", "b"])


@query("clean_finite_groups", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4)""")
def finite_groups(spark, sf):
    df = table(spark, sf, "lineitem").withColumn(
        "q", F.when(F.col("l_linenumber") == 4, float("inf")).otherwise(F.col("l_quantity")))
    return C.finite_groups(df, ["l_orderkey"], ["q"]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("clean_change_summary", f"""
SELECT 'before' AS stage, count(*) AS n_rows, 7::BIGINT AS n_columns, (2 * count(*) - count(quality) - count(toxic))::BIGINT AS null_cells FROM ({LABELLED_SQL})
UNION ALL SELECT 'after', count(*), 7::BIGINT, 0::BIGINT FROM ({LABELLED_SQL}) WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def change_summary(spark, sf):
    df = labelled(spark, sf)
    return C.change_summary(df, df.dropna())


@query("clean_concat_rows", """
SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier""")
def concat_rows(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return C.concat_rows([c, s])


@query("clean_removal_report", union_all([
    f"SELECT '{n}' AS rule, count(*) FILTER ({c}) AS n_removed, round(count(*) FILTER ({c}) * 100.0 / count(*), 4)::DOUBLE AS pct FROM ({LISTINGS_SQL})"
    for n, c in (("cheap", "price < 5000"), ("worn", "mileage > 400000"), ("old", "year < 1950"), ("any_rule", "price < 5000 OR mileage > 400000 OR year < 1950"))]))
def removal_report(spark, sf):
    rules = {"cheap": F.col("price") < 5000, "worn": F.col("mileage") > 400000, "old": F.col("year") < 1950}
    return rounded(C.removal_report(listings(spark, sf), rules), 4, "pct")


@query("source_tighten_types", "SELECT event_id, value AS amount, props AS raw FROM events")
def tighten_types(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.col("value").cast("string").alias("amount"), F.col("props").alias("raw"))
    return S.tighten_types(df)


@query("source_suggest_schema", union_all([
    f"""SELECT '{c}' AS column, '{t}' AS type, CASE WHEN m <= 127 THEN 'tinyint' WHEN m <= 32767 THEN 'smallint' WHEN m <= 2147483647 THEN 'int'
  ELSE 'bigint' END AS suggested FROM (SELECT greatest(max({c}), -(min({c}) + 1)) AS m FROM lineitem)"""
    for c, t in (("l_orderkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"))]
    + ["SELECT 'l_quantity', 'double', 'double'", "SELECT 'l_returnflag', 'string', 'string'"]))
def suggest_schema(spark, sf):
    return S.suggest_schema(table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"))


_HOLES = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority, o_orderstatus FROM orders"""


def _holes(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 7 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 11 != 0, F.col("o_orderpriority")).alias("priority"),
        "o_orderstatus")


@query("impute_group_median", f"""
WITH t AS ({_HOLES}), g AS (SELECT priority, o_orderstatus, median(price) AS m FROM t WHERE priority IS NOT NULL GROUP BY 1, 2)
SELECT o_orderkey, round(coalesce(price, m, 1.5), 4) AS price FROM t LEFT JOIN g USING (priority, o_orderstatus)""")
def group_median(spark, sf):
    out = I.fill_group_median(_holes(spark, sf), ["price"], ["priority", "o_orderstatus"], fallback={"price": 1.5})
    return rounded(out.select("o_orderkey", "price"), 4, "price")


@query("impute_group_median_counted", f"""
WITH t AS ({_HOLES}), g AS (SELECT priority, median(price) AS m FROM t WHERE priority IS NOT NULL GROUP BY 1)
SELECT o_orderkey, round(coalesce(price, m, 1.5), 4) AS price FROM t LEFT JOIN g USING (priority)""")
def group_median_counted(spark, sf):
    """Group medians by counting, the plan for groups beyond one task, forced here."""
    out = I.fill_group_median(_holes(spark, sf), ["price"], ["priority"], fallback={"price": 1.5}, one_pass_rows=0)
    return rounded(out.select("o_orderkey", "price"), 4, "price")


for _strategy, _price in (("mean", "avg(price)"), ("median", "quantile_cont(price, 0.5)")):
    @query(f"impute_{_strategy}", f"""
WITH t AS ({_HOLES}) SELECT o_orderkey, round(coalesce(price, (SELECT {_price} FROM t)), 4) AS price, priority FROM t""")
    def single(spark, sf, strategy=_strategy):
        return rounded(I.impute(_holes(spark, sf), strategy), 4, "price").drop("o_orderstatus")

for _strategy, _price in (("auto", "quantile_cont(price, 0.5)"), ("mode", "(SELECT price FROM t WHERE price IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")):
    @query(f"impute_{_strategy}", f"""
WITH t AS ({_HOLES}), p AS (SELECT priority AS top FROM t WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT o_orderkey, round(coalesce(price, (SELECT any_value(v) FROM (SELECT {_price} AS v FROM t))), 4) AS price, coalesce(priority, (FROM p)) AS priority FROM t""")
    def several(spark, sf, strategy=_strategy):
        return rounded(I.impute(_holes(spark, sf), strategy), 4, "price").drop("o_orderstatus")


@query("impute_smart", f"""
WITH t AS ({LISTINGS_SQL}),
g AS (SELECT make_name, model_name, median(mileage) AS m FROM t WHERE make_name IS NOT NULL AND model_name IS NOT NULL GROUP BY 1, 2),
a AS (SELECT quantile_cont(mileage, 0.5) AS mileage, quantile_cont(horsepower, 0.5) AS horsepower, quantile_cont(city_fuel_economy, 0.5) AS city FROM t),
mk AS (SELECT make_name AS top FROM t WHERE make_name IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT l_orderkey, l_linenumber, round(coalesce(t.mileage, g.m, a.mileage), 4) AS mileage, coalesce(t.horsepower, a.horsepower) AS horsepower,
  coalesce(t.city_fuel_economy, a.city) AS city_fuel_economy, (t.city_fuel_economy IS NULL)::INTEGER AS city_fuel_economy_was_missing,
  coalesce(t.make_name, (FROM mk)) AS make_name, coalesce(CASE WHEN l_linenumber = 1 THEN NULL ELSE fuel_type END, 'unknown') AS fuel_type
FROM t LEFT JOIN g USING (make_name, model_name) CROSS JOIN a""")
def smart(spark, sf):
    """City economy is a quarter null (flag), mileage a ninth (group median), horsepower and make few (median, mode),
    fuel type one in seven ('unknown'), owner count mostly null (dropped)."""
    df = listings(spark, sf).select(
        "l_orderkey", "l_linenumber", "make_name", "model_name", "mileage", "horsepower", "city_fuel_economy", "owner_count",
        F.when(F.col("l_linenumber") != 1, F.col("fuel_type")).alias("fuel_type"))
    return rounded(I.fit_smart(df).transform(df).drop("model_name"), 4, "mileage")


@query("impute_leftover", f"""
WITH t AS ({_HOLES}) SELECT o_orderkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM t)), 4) AS price FROM t""")
def leftover(spark, sf):
    return rounded(I.fill_leftover(_holes(spark, sf).select("o_orderkey", "price"), ["price"]), 4, "price")


@query("clean_split_target", "SELECT o_totalprice AS target, count(*) AS n FROM orders GROUP BY 1")
def split_target(spark, sf):
    _, y = C.split_target(table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("target")), "target")
    return y.groupBy("target").agg(F.count("*").alias("n"))


@query("source_read_capped", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def read_capped(spark, sf):
    """A row cap with a column subset, taken in key order."""
    return S.read_table(spark, f"{sf}/orders.parquet", columns=["o_orderkey", "o_totalprice"], max_rows=1000, order_by=["o_orderkey"])


@query("source_csv", "SELECT o_orderkey AS order_key, o_totalprice AS total_price, o_orderpriority AS priority FROM orders")
def csv(spark, sf):
    """The whole table written as CSV with untidy headers, read back with a declared schema and tidy names."""
    from slopeworks.session import shared_folder

    path = f"{shared_folder(spark)}/orders.csv"
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("Order Key"), F.col("o_totalprice").alias("Total-Price"), F.col("o_orderpriority").alias("PRIORITY "))
    o.write.option("header", True).csv(path)
    return S.read_table(spark, path, "`Order Key` long, `Total-Price` double, `PRIORITY ` string", normalise=True)


# The whole preparation job over all listings and copies of every tenth that differ by case only.
_PREPARED = f"""
WITH a AS (SELECT * EXCLUDE (l_orderkey, l_linenumber) FROM (SELECT * FROM ({LISTINGS_SQL})
  UNION ALL SELECT * REPLACE (upper(fuel_type) AS fuel_type) FROM ({LISTINGS_SQL}) WHERE l_orderkey % 10 = 0)),
d AS (SELECT DISTINCT * FROM a WHERE price > 0), q AS (SELECT quantile_cont(price, 0.995) AS q FROM d),
k AS (SELECT price FROM d, q WHERE price < q AND year >= 1900 AND year <= 1991 AND mileage >= 0 AND mileage < 500000)
SELECT count(*) AS n_rows, count(*) AS n_ids, ceil(count(*) * 0.2 - 1e-9)::BIGINT AS n_test, 0::BIGINT AS n_unknown, round(sum(ln(1 + price)), 4) AS label_sum FROM k"""


@query("prepare_listings", _PREPARED)
def prepared(spark, sf):
    from slopeworks.plans.prepare import prepare_listings

    raw = listings(spark, sf)
    cased = raw.filter(F.col("l_orderkey") % 10 == 0).withColumn("fuel_type", F.upper("fuel_type"))
    job = prepare_listings(raw.unionByName(cased), as_of=1990)
    unknown = F.exists("features", lambda x: x.isNull() | F.isnan(x))
    out = job.matrix.agg(F.count("*").alias("n_rows"), F.count_distinct("row_id").alias("n_ids"), F.count_if(F.col("split") == "test").alias("n_test"),
                         F.count_if(unknown).alias("n_unknown"), F.sum("label").alias("label_sum"))
    return rounded(out, 4, "label_sum")
