"""Profile reports over whole tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from slopeworks.functions.numeric import normal_quantiles
from slopeworks.operators import profile as P
from workload.registry import LABELLED_SQL, labelled, query, rounded, table, union_all

DOC_COLUMNS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic", "origin"]
DOC_TYPES = {"doc_id": "bigint", "lang": "string", "source": "string", "n_chars": "bigint", "quality": "int", "toxic": "int", "origin": "string"}
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_CORR = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("profile_overview", f"""
WITH t AS (SELECT lang, source, quality, toxic FROM ({LABELLED_SQL})),
d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM t)),
m AS (SELECT count(*) AS n, sum((quality IS NULL)::INT + (toxic IS NULL)::INT) AS k FROM t)
SELECT m.n AS n_rows, 4::BIGINT AS n_columns, m.k::BIGINT AS missing_cells, round(m.k * 100.0 / (m.n * 4), 2)::DOUBLE AS missing_pct,
  (m.n - d.n)::BIGINT AS duplicate_rows, round((m.n - d.n) * 100.0 / m.n, 2)::DOUBLE AS duplicate_pct,
  2::BIGINT AS numeric_columns, 2::BIGINT AS categorical_columns, 0::BIGINT AS boolean_columns, 0::BIGINT AS datetime_columns
FROM m, d""")
def overview(spark, sf):
    return P.overview(labelled(spark, sf).select("lang", "source", "quality", "toxic"))


_MISSING = f"""
SELECT * FROM (
  SELECT "column", missing_count, round(missing_count * 100.0 / n, 2)::DOUBLE AS missing_pct, type,
    CASE WHEN missing_count * 100.0 / n > 50 THEN 'over_50' WHEN missing_count * 100.0 / n > 20 THEN '20_to_50'
         WHEN missing_count * 100.0 / n > 5 THEN '5_to_20' ELSE 'up_to_5' END AS tier
  FROM ({union_all([f"SELECT '{c}' AS column, count(*) AS n, (count(*) - count({c}))::BIGINT AS missing_count, '{DOC_TYPES[c]}' AS type FROM ({LABELLED_SQL})" for c in DOC_COLUMNS])})
) WHERE missing_count > 0"""


@query("profile_missing_report", _MISSING)
def missing_report(spark, sf):
    return P.missing_report(labelled(spark, sf))


@query("profile_missing_tiers", f"SELECT tier, count(*) AS n_columns FROM ({_MISSING}) GROUP BY tier")
def missing_tiers(spark, sf):
    return P.missing_tiers(labelled(spark, sf))


@query("profile_target_statistics", """
WITH x AS (SELECT o_totalprice AS v FROM orders WHERE o_totalprice > 0),
q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM x)
SELECT count(*) AS count, round(avg(v), 4) AS mean, round(any_value(median), 4) AS median, round(stddev_samp(v), 4) AS std, min(v) AS min, max(v) AS max,
  round(any_value(q1), 4) AS q1, round(any_value(q3), 4) AS q3, round(any_value(q3 - q1), 4) AS iqr,
  round(skewness(v), 6) AS skewness, round(kurtosis(v), 6) AS kurtosis,
  count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers_count,
  round(count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) * 100.0 / count(*), 6)::DOUBLE AS outliers_pct
FROM x, q""")
def target_statistics(spark, sf):
    out = P.target_statistics(table(spark, sf, "orders"), "o_totalprice")
    return rounded(rounded(out, 4, "mean", "median", "std", "q1", "q3", "iqr"), 6, "skewness", "kurtosis", "outliers_pct")


@query("profile_target_statistics_counted", """
WITH x AS (SELECT value AS v FROM events WHERE value > 0),
q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM x)
SELECT count(*) AS count, round(any_value(median), 4) AS median, round(any_value(q1), 4) AS q1, round(any_value(q3), 4) AS q3,
  count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers_count FROM x, q""")
def target_statistics_counted(spark, sf):
    """The plan for tables beyond one task's memory, forced here."""
    out = P.target_statistics(table(spark, sf, "events"), "value", one_pass_rows=0, accuracy=20)
    return rounded(out, 4, "median", "q1", "q3").select("count", "median", "q1", "q3", "outliers_count")


def _histogram_sql(expr: str, source: str, bins: int) -> str:
    return f"""
WITH x AS (SELECT {expr} AS v FROM {source}), b AS (SELECT min(v) AS lo, (max(v) - min(v)) / {bins} AS w FROM x WHERE v IS NOT NULL),
c AS (SELECT least(floor((v - lo) / w), {bins - 1})::INTEGER AS bin, count(*) AS n FROM x, b WHERE v IS NOT NULL GROUP BY 1)
SELECT g.bin::INTEGER AS bin, round(lo + g.bin * w, 4) AS lower, round(lo + (g.bin + 1) * w, 4) AS upper, coalesce(c.n, 0)::BIGINT AS n
FROM (SELECT unnest(range({bins})) AS bin) g CROSS JOIN b LEFT JOIN c ON c.bin = g.bin"""


@query("profile_histogram", _histogram_sql("o_totalprice", "orders", 50))
def histogram(spark, sf):
    return rounded(P.histogram(table(spark, sf, "orders"), "o_totalprice", 50), 4, "lower", "upper")


@query("profile_histogram_log10", _histogram_sql("log10(l_extendedprice)", "lineitem", 30))
def histogram_log(spark, sf):
    return rounded(P.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 30, F.log10), 4, "lower", "upper")


_EDGES, _LABELS = [0, 50000, 150000, 250000, 400000, float("inf")], ["to_50k", "to_150k", "to_250k", "to_400k", "above"]


@query("profile_range_counts", """
SELECT CASE WHEN o_totalprice <= 50000 THEN 'to_50k' WHEN o_totalprice <= 150000 THEN 'to_150k' WHEN o_totalprice <= 250000 THEN 'to_250k'
  WHEN o_totalprice <= 400000 THEN 'to_400k' ELSE 'above' END AS range, count(*) AS n,
  CASE range WHEN 'to_50k' THEN 1 WHEN 'to_150k' THEN 2 WHEN 'to_250k' THEN 3 WHEN 'to_400k' THEN 4 ELSE 5 END::INTEGER AS position
FROM orders WHERE o_totalprice > 0 GROUP BY 1""")
def range_counts(spark, sf):
    return P.range_counts(table(spark, sf, "orders"), "o_totalprice", _EDGES, _LABELS)


_QQ = [(i + 0.5) / 20 for i in range(20)]


@query("profile_normal_qq", union_all([
    f"SELECT {p}::DOUBLE AS p, round({z!r}::DOUBLE, 6) AS theoretical, round(quantile_cont(l_extendedprice, {p}), 6) AS sample FROM lineitem"
    for p, z in zip(_QQ, normal_quantiles(_QQ))]))
def normal_qq(spark, sf):
    return rounded(rounded(P.normal_qq(table(spark, sf, "lineitem"), "l_extendedprice", 20), 6, "theoretical"), 6, "sample")


@query("profile_numeric_summary", union_all([f"""
SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
  round((count(*) - count({c})) * 100.0 / count(*), 4)::DOUBLE AS missing_pct, round(count(*) FILTER ({c} = 0) * 100.0 / count(*), 4)::DOUBLE AS zeros_pct,
  round(quantile_cont({c}, 0.25), 4)::DOUBLE AS q1, round(quantile_cont({c}, 0.5), 4)::DOUBLE AS median, round(quantile_cont({c}, 0.75), 4)::DOUBLE AS q3,
  count(DISTINCT {c}) AS distinct_count FROM lineitem""" for c in ["l_linenumber", *LINE_NUMBERS]]))
def numeric_summary(spark, sf):
    out = P.numeric_summary(table(spark, sf, "lineitem"), ["l_linenumber", *LINE_NUMBERS])
    return rounded(out, 4, "mean", "std", "missing_pct", "zeros_pct", "q1", "median", "q3")


@query("profile_target_correlations", f"""SELECT "column", round(r, 6) AS r, round(abs(r), 6) AS abs_r FROM ({union_all([
    f"SELECT '{c}' AS column, corr({c}, l_extendedprice) AS r FROM lineitem" for c in LINE_CORR if c != "l_extendedprice"])}) WHERE r IS NOT NULL""")
def target_correlations(spark, sf):
    return rounded(P.target_correlations(table(spark, sf, "lineitem"), "l_extendedprice", LINE_CORR), 6, "r", "abs_r")


# A table with nulls: pairs are complete where both sides are.
_NULLED = """SELECT CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS a, l_extendedprice AS b,
  CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_extendedprice * 2 + l_quantity END AS c, l_tax AS d, l_discount - l_tax AS e FROM lineitem"""


def _nulled(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").select(
        F.when(c("l_orderkey") % 7 != 0, c("l_quantity")).alias("a"), c("l_extendedprice").alias("b"),
        F.when(c("l_partkey") % 5 != 0, c("l_extendedprice") * 2 + c("l_quantity")).alias("c"), c("l_tax").alias("d"),
        (c("l_discount") - c("l_tax")).alias("e"))


def _pairs_sql(where: str = "", r: str = "round(r, 6)") -> str:
    parts = [f"SELECT '{x}' AS column_1, '{y}' AS column_2, corr({x}, {y}) AS r FROM ({_NULLED})" for x, y in combinations("abcde", 2)]
    return f"SELECT column_1, column_2, {r} AS r FROM ({union_all(parts)}) {where}"


@query("profile_correlations", _pairs_sql())
def correlations(spark, sf):
    return rounded(P.correlations(_nulled(spark, sf)), 6, "r")


@query("profile_correlations_by_blocks", _pairs_sql())
def correlations_by_blocks(spark, sf):
    from slopeworks.operators.gram import pairwise_correlations

    return rounded(pairwise_correlations(_nulled(spark, sf), list("abcde")), 6, "r")


@query("profile_strong_pairs", _pairs_sql("WHERE abs(r) > 0.5", "round(r, 3)"))
def strong_pairs(spark, sf):
    return P.strong_pairs(_nulled(spark, sf), above=0.5)


@query("profile_correlation_block", f"""
WITH p AS ({_pairs_sql()}), s AS (SELECT CASE WHEN column_1 = 'b' THEN column_2 ELSE column_1 END AS c, abs(r) AS r FROM p WHERE 'b' IN (column_1, column_2)),
t AS (SELECT c FROM s WHERE r IS NOT NULL ORDER BY r DESC, c LIMIT 3)
SELECT column_1, column_2, r FROM p WHERE column_1 IN (FROM t) AND column_2 IN (FROM t)""")
def correlation_block(spark, sf):
    return rounded(P.correlation_block(_nulled(spark, sf), "b", k=3), 6, "r")


def _categorical_sql(source: str, columns: list[str]) -> str:
    parts = [f"""SELECT '{c}' AS column, (SELECT count(DISTINCT {c}) FROM t) AS distinct_count, v AS top_value, n AS top_count,
  (SELECT count(*) FROM t) AS total, (SELECT count(*) - count({c}) FROM t) AS missing
  FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)""" for c in columns]
    return f"""WITH t AS ({source}) SELECT "column", distinct_count, round(missing * 100.0 / total, 4)::DOUBLE AS missing_pct, top_value, top_count,
  round(top_count * 100.0 / total, 4)::DOUBLE AS top_pct,
  CASE WHEN distinct_count > 50 THEN 'high' WHEN distinct_count > 10 THEN 'medium' ELSE 'low' END AS cardinality
FROM ({union_all(["SELECT * FROM (" + p + ")" for p in parts])})"""


_PART_SQL = "SELECT p_name, p_brand, p_type, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS p_size FROM part"


def _part(spark, sf):
    return table(spark, sf, "part").select("p_name", "p_brand", "p_type", F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("p_size"))


@query("profile_categorical_summary", _categorical_sql(_PART_SQL, ["p_name", "p_brand", "p_type", "p_size"]))
def categorical_summary(spark, sf):
    return rounded(P.categorical_summary(_part(spark, sf), ["p_name", "p_brand", "p_type", "p_size"]), 4, "missing_pct", "top_pct")


@query("profile_cardinality_classes",
       f"SELECT cardinality, count(*) AS n_columns FROM ({_categorical_sql(_PART_SQL, ['p_name', 'p_brand', 'p_type', 'p_size'])}) GROUP BY 1")
def cardinality_classes(spark, sf):
    return P.cardinality_classes(_part(spark, sf), ["p_name", "p_brand", "p_type", "p_size"])


@query("profile_top_category_means", """
SELECT p_brand, count(*) AS n, round(avg(l_extendedprice), 4) AS mean_target FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10""")
def top_category_means(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(P.top_category_means(joined, "p_brand", "l_extendedprice"), 4, "mean_target")


_WORDS_SQL = r"SELECT n_chars, unnest(string_split_regex(text, '[\x20\x09-\x0D]+')) AS word FROM documents"


def _words(spark, sf):
    """Every word of every document: a category with a long tail of rare values."""
    words = F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")
    return table(spark, sf, "documents").select("n_chars", words).filter("word <> ''")


@query("profile_top_words", f"""
WITH w AS (SELECT word FROM ({_WORDS_SQL}) WHERE word <> ''), c AS (SELECT word AS value, count(*) AS n FROM w GROUP BY 1)
SELECT 'word' AS column, CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS place, value, n,
  round(100.0::DOUBLE * n / (SELECT count(*) FROM w), 6)::DOUBLE AS pct
FROM c ORDER BY n DESC, value LIMIT 50""")
def top_words(spark, sf):
    return rounded(P.top_value_shares(_words(spark, sf), ["word"], 50, capacity=8192), 6, "pct")


@query("profile_top_word_means", f"""
SELECT word, count(*) AS n, round(avg(n_chars), 4) AS mean_target FROM ({_WORDS_SQL}) WHERE word <> ''
GROUP BY 1 ORDER BY n DESC, word LIMIT 20""")
def top_word_means(spark, sf):
    return rounded(P.top_category_means(_words(spark, sf), "word", "n_chars", 20, capacity=8192), 4, "mean_target")


@query("profile_quality_report", f"""
WITH t AS ({LABELLED_SQL})
SELECT count(*) AS total_rows, 7::BIGINT AS total_columns, (2 * count(*) - count(quality) - count(toxic))::BIGINT AS missing_cells,
  ((count(*) > count(quality))::INT + (count(*) > count(toxic))::INT)::BIGINT AS columns_with_missing, count(quality + toxic) AS complete_rows,
  round(count(quality + toxic) * 100.0 / count(*), 2)::DOUBLE AS complete_pct, 4::BIGINT AS numeric_columns, 3::BIGINT AS categorical_columns,
  0::BIGINT AS boolean_columns, 0::BIGINT AS datetime_columns,
  count(*) FILTER (quality > 0) AS target_valid, count(*) FILTER (quality IS NULL) AS target_missing, count(*) FILTER (quality <= 0) AS target_not_positive,
  round(avg(quality) FILTER (quality > 0), 2) AS target_mean, round(stddev_samp(quality) FILTER (quality > 0), 2) AS target_std FROM t""")
def quality_report(spark, sf):
    return P.quality_report(labelled(spark, sf), "quality")


@query("profile_quality_issues", f"""
WITH t AS ({LABELLED_SQL}), s AS ({union_all([
    f"SELECT '{c}' AS column, count(*) - count({c}) > count(*) * 0.5 AS empty, count(DISTINCT {c}) AS k, {str(DOC_TYPES[c] == 'string').lower()} AS text FROM t" for c in DOC_COLUMNS])})
SELECT 'mostly_null' AS issue, "column" FROM s WHERE empty UNION ALL
SELECT 'high_cardinality', "column" FROM s WHERE text AND k > 100 UNION ALL
SELECT 'constant', "column" FROM s WHERE k <= 1""")
def quality_issues(spark, sf):
    return P.quality_issues(labelled(spark, sf))


@query("profile_recommendations", f"""
WITH t AS ({LABELLED_SQL}), x AS (SELECT n_chars::DOUBLE AS v FROM t WHERE n_chars > 0),
q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM x),
o AS (SELECT count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) * 100.0 / count(*) AS pct FROM x, q)
SELECT type, priority, amount FROM (
SELECT 'DROP_COLUMNS' AS type, 'HIGH' AS priority, ((SELECT count(*) - count(quality) > count(*) * 0.5 FROM t)::INT + (SELECT count(*) - count(toxic) > count(*) * 0.5 FROM t)::INT)::DOUBLE AS amount, 0 AS least UNION ALL
SELECT 'REMOVE_DUPLICATES', 'HIGH', ((SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)))::DOUBLE, 0 UNION ALL
SELECT 'HANDLE_OUTLIERS', 'MEDIUM', round((SELECT pct FROM o), 4)::DOUBLE, 5 UNION ALL
SELECT 'TRANSFORM_TARGET', 'MEDIUM', round((SELECT skewness(v) FROM x), 4)::DOUBLE, 1 UNION ALL
SELECT 'ENCODE_CATEGORICAL', 'HIGH', (((SELECT count(DISTINCT lang) FROM t) > 50)::INT + ((SELECT count(DISTINCT source) FROM t) > 50)::INT)::DOUBLE, 0
) WHERE amount > least""")
def recommendations(spark, sf):
    return rounded(P.recommendations(labelled(spark, sf), "n_chars"), 4, "amount")


# NaN stands for unknown like null, and a column that does not vary has no correlation.
_AWKWARD = """SELECT CASE WHEN l_orderkey % 7 = 0 THEN 'NaN'::DOUBLE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity END AS a, l_extendedprice AS b, 3.0::DOUBLE AS k FROM lineitem"""
_KNOWN = f"SELECT CASE WHEN isnan(a) THEN NULL ELSE a END AS a, b, k FROM ({_AWKWARD})"


def _awkward(spark, sf):
    key, nan = F.col("l_orderkey"), F.lit(float("nan"))
    a = F.when(key % 7 == 0, nan).when(key % 11 != 0, F.col("l_quantity"))
    return table(spark, sf, "lineitem").select(a.alias("a"), F.col("l_extendedprice").alias("b"), F.lit(3.0).alias("k"))


def _guarded(x: str, y: str, source: str) -> str:
    return f"""SELECT '{x}' AS column_1, '{y}' AS column_2, (SELECT CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN round(corr(x, y), 6) END
      FROM (SELECT {x} AS x, {y} AS y FROM ({source}) WHERE {x} IS NOT NULL AND {y} IS NOT NULL)) AS r"""


@query("profile_correlations_with_nan_and_constant", union_all([_guarded(x, y, _KNOWN) for x, y in combinations("abk", 2)]))
def correlations_awkward(spark, sf):
    return rounded(P.correlations(_awkward(spark, sf)), 6, "r")


_WIDE = [f"c{i}" for i in range(20)]


def _wide_sql() -> str:
    columns = [f"CASE WHEN b IS NULL THEN NULL ELSE {'k' if i % 6 == 5 else 'a' if i % 3 == 0 else 'b'} * {i + 1} END AS c{i}" for i in range(20)]
    return f"SELECT {', '.join(columns)} FROM ({_KNOWN})"


@query("profile_correlations_wide_with_nan_and_constant", union_all([_guarded(x, y, _wide_sql()) for x, y in combinations(_WIDE, 2)]))
def correlations_wide_awkward(spark, sf):
    df = _awkward(spark, sf)
    wide = df.select(*[(F.col("k" if i % 6 == 5 else "a" if i % 3 == 0 else "b") * (i + 1)).alias(f"c{i}") for i in range(20)])
    return rounded(P.correlations(wide), 6, "r")


@query("profile_target_statistics_with_nan", f"""
WITH x AS (SELECT a AS v FROM ({_KNOWN}) WHERE a > 0),
q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM x)
SELECT count(*) AS count, round(avg(v), 4) AS mean, round(any_value(median), 4) AS median, round(any_value(q1), 4) AS q1, round(any_value(q3), 4) AS q3,
  max(v) AS max, count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers_count FROM x, q""")
def target_statistics_awkward(spark, sf):
    out = P.target_statistics(_awkward(spark, sf), "a")
    return rounded(out, 4, "mean", "median", "q1", "q3").select("count", "mean", "median", "q1", "q3", "max", "outliers_count")


@query("profile_histogram_with_nan", _histogram_sql("a", f"({_KNOWN})", 12))
def histogram_awkward(spark, sf):
    return rounded(P.histogram(_awkward(spark, sf), "a", 12), 4, "lower", "upper")


def _sketched_sql(where: str = "") -> str:
    return union_all([f"""
SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
  true AS quartiles_ok, true AS distinct_ok FROM lineitem {where}""" for c in ["l_linenumber", *LINE_NUMBERS]])


def _sketched(spark, sf, flags=None):
    """Sketches stored by return flag, merged; estimates are held against ranks and distinct counts of the rows themselves."""
    from slopeworks.operators import sketches as S
    from slopeworks.session import shared_folder

    columns, lines = ["l_linenumber", *LINE_NUMBERS], table(spark, sf, "lineitem")
    folder = shared_folder(spark)
    S.sketch_columns(lines, columns, ["l_returnflag"]).write.parquet(folder)
    parts = spark.read.parquet(folder)
    if flags:
        parts, lines = (d.filter(F.col("l_returnflag").isin(flags)) for d in (parts, lines))
    out = S.sketched_summary(S.merge_sketches(parts))
    found = {r["column"]: r for r in out.collect()}  # one row for each column of the table
    within = S.rank_error(S.KLL_SIZE)
    checks = []
    for c in columns:
        v, n = F.col(c).cast("double"), F.count(c)
        ranks = [(F.count_if(v <= found[c][q]) >= (p - within) * n) & (F.count_if(v < found[c][q]) <= (p + within) * n) for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
        checks.append(lines.agg(F.lit(c).alias("column"), (ranks[0] & ranks[1] & ranks[2]).alias("quartiles_ok"), (F.abs(F.count_distinct(v) / found[c]["distinct_count"] - 1) <= 0.08).alias("distinct_ok")))
    held = checks[0]
    for more in checks[1:]:
        held = held.unionByName(more)
    return rounded(out.select("column", "count", "mean", "std", "min", "max").join(F.broadcast(held), "column"), 4, "mean", "std")


@query("profile_sketched_summary", _sketched_sql())
def sketched_summary(spark, sf):
    return _sketched(spark, sf)


@query("profile_sketched_summary_of_parts", _sketched_sql("WHERE l_returnflag IN ('A', 'R')"))
def sketched_summary_of_parts(spark, sf):
    return _sketched(spark, sf, ["A", "R"])
