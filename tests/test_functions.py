import math

import pytest
from pyspark.sql import functions as F

from slopeworks.functions import numeric as N
from slopeworks.functions import text as T
from slopeworks.functions import vectors as V


def col(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def one(df, *exprs):
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_unit_strings(spark):
    df = col(spark, ["35.1 in", "--", None, "5 seats", "200 hp @ 5,000 rpm", "hp"], "string")
    assert [r[0] for r in one(df, T.extract_number(F.col("x")))] == [35.1, None, None, 5.0, 200.0, None]
    assert [r[0] for r in one(df, T.extract_number(F.col("x"), T.K.AT_RPM))] == [None, None, None, None, 5000.0, None]
    assert [r[0] for r in one(df, T.extract_number(F.col("x"), T.K.HORSEPOWER))] == [None, None, None, None, 200.0, None]


def test_power_and_torque_columns(spark):
    df = spark.createDataFrame([("250 hp @ 6,100 rpm", "260 lb-ft @ 4,800 RPM", "5 seats")], "power string, torque string, maximum_seating string")
    r = T.parse_units(df).first()
    assert (r["power_hp"], r["power_rpm"], r["torque_value"], r["torque_rpm"], r["maximum_seating"]) == (250, 6100, 260, 4800, 5)


def test_clean_text(spark):
    df = col(spark, ["  Foo \t BAR ", "", "   ", None], "string")
    assert [r[0] for r in one(df, T.clean_text(F.col("x")))] == ["foo bar", None, None, None]


def test_names_are_normalised_and_clashes_refused(spark):
    assert T.normalise_columns(spark.createDataFrame([(1, 2)], "` A-B ` int, `C__d` int")).columns == ["a_b", "c_d"]
    with pytest.raises(ValueError, match="collide"):
        T.normalise_columns(spark.createDataFrame([(1, 2)], "`A b` int, `a-B` int"))


def test_bins_are_right_closed(spark):
    df = col(spark, [0.0, 150.0, 150.0001, 250.0, 351.0, None, float("nan")], "double")
    got = [r[0] for r in one(df, N.right_closed_bin(F.col("x"), T.K.PERFORMANCE_EDGES, T.K.PERFORMANCE_LABELS))]
    assert got == [None, "economy", "standard", "standard", "high_performance", None, None]


def test_codes_and_flags(spark):
    df = col(spark, ["a", "b", "z", None], "string")
    assert [r[0] for r in one(df, N.ordered_code(F.col("x"), ["a", "b"]))] == [0, 1, None, None]
    df = col(spark, [30.0, 20.0, None], "double")
    assert [r[0] for r in one(df, N.flag(F.col("x") > 25))] == [1, 0, 0]


def test_finite(spark):
    df = col(spark, [1.0, float("nan"), float("inf"), float("-inf"), None], "double")
    assert [r[0] for r in one(df, N.is_finite(F.col("x")))] == [True, False, False, False, None]
    assert [r[0] for r in one(df, N.finite_or(F.col("x"), 7))] == [1, 7, 7, 7, 7]


def test_sample_moments_match_pandas(spark):
    import pandas as pd

    values = [1.0, 2.0, 2.5, 4.0, 9.0, 30.0]
    got = col(spark, values, "double").agg(N.sample_skewness(F.col("x")), N.sample_kurtosis(F.col("x"))).first()
    s = pd.Series(values)
    assert got[0] == pytest.approx(s.skew()) and got[1] == pytest.approx(s.kurt())
    assert tuple(col(spark, [1.0, 2.0], "double").agg(N.sample_skewness(F.col("x")), N.sample_kurtosis(F.col("x"))).first()) == (None, None)


def test_condition_score_over_all_flag_values(spark):
    from itertools import product

    from slopeworks.operators.features import condition_score

    cases = list(product([True, False, None], repeat=3))
    df = spark.createDataFrame(cases, "a boolean, b boolean, c boolean")
    for r in df.withColumn("score", condition_score("a", "b", "c")).collect():
        assert r["score"] == 3 - sum(v is True for v in (r["a"], r["b"], r["c"]))


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0, 0.5])], "x array<double>, w array<double>")
    r = df.select(V.linear_prediction(F.col("x"), F.col("w")).alias("p"), V.weight_stats(F.col("w")).alias("s"), V.with_bias(F.col("x")).alias("b")).first()
    assert r["p"] == 1.5 and r["b"] == [1.0, 2.0, 1.0]
    assert (r["s"]["n_features"], r["s"]["min_weight"], r["s"]["mean_weight"], r["s"]["std_weight"], r["s"]["bias"]) == (2, -1.0, 1.0, 2.0, 0.5)


def test_standardise_refuses_another_length(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    assert df.select(V.standardise(F.col("x"), [1.0, 0.0], [2.0, 4.0])).first()[0] == [0.0, 0.5]
    with pytest.raises(Exception, match="expected 1 features"):
        df.select(V.standardise(F.col("x"), [1.0], [2.0])).collect()
    with pytest.raises(ValueError):
        V.unrolled_prediction(["a"], [1.0])


def test_normal_quantiles():
    assert N.normal_quantiles([0.5])[0] == 0 and math.isclose(N.normal_quantiles([0.975])[0], 1.959964, abs_tol=1e-6)
