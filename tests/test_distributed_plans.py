"""The plans for large data give what the plans for small data give."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slopeworks.operators import ranking as R
from slopeworks.operators.joins import lookup_join, salted_join, within
from slopeworks.operators.quantiles import _counted, approximate_quantiles, exact_quantiles, quantile_columns
from slopeworks.operators.split import split_exact

PROBS = [0.0, 0.1, 0.25, 0.5, 0.995, 1.0]


def quantiles(rows):
    return {(r["column"], r["p"]): r["value"] for r in rows.collect()}


def test_bracketed_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    n = 30_000
    frame = pd.DataFrame({"a": rng.lognormal(5, 3, n), "b": rng.integers(0, 4, n).astype(float), "c": -rng.pareto(0.3, n)})
    got = quantiles(exact_quantiles(spark.createDataFrame(frame), ["a", "b", "c"], PROBS, one_pass_rows=0, accuracy=100))
    for c in frame:
        for p in PROBS:
            assert got[c, p] == pytest.approx(np.quantile(frame[c], p), rel=1e-9), (c, p)


def test_quantiles_skip_null_and_nan_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (float("nan"), None), (3.0, None)], "a double, b double")
    assert quantiles(exact_quantiles(df, ["a", "b"], [0.5])) == {("a", 0.5): 2.0}
    assert quantiles(exact_quantiles(df, ["a", "b"], [0.5], reuse=True)) == {("a", 0.5): 2.0}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e12, 1e12), min_size=1, max_size=30))
def test_counted_quantiles_on_any_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = quantiles(_counted(df, ["x"], [0.25, 0.5], []))
    for p in (0.25, 0.5):
        assert got["x", p] == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-9)


def test_group_quantiles_with_a_hot_and_a_null_group(spark):
    rows = [("hot", float(i % 50)) for i in range(400)] + [("cold", 1.0), ("cold", 2.0), (None, 5.0), (None, None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r["m"] for r in quantile_columns(df, {"m": ("x", 0.5)}, ["g"], one_pass_rows=100).collect()}
    assert got["hot"] == 24.5 and got["cold"] == 1.5 and got[None] == 5.0


def test_approximate_quantiles(spark):
    got = quantiles(approximate_quantiles(spark.range(1001).withColumn("x", F.col("id").cast("double")), ["x"], [0.5]))
    assert got["x", 0.5] == pytest.approx(500, abs=1)


def test_salted_join_equals_plain_join(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 50).cast("string")).alias("k"), "id")
    table = df.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    plain = sorted(map(str, df.join(table, "k", "left").select("id", "k", "n").collect()))
    for out in (salted_join(df.repartition(7), table, ["k"], "left", [("hot",)], 5), lookup_join(df.repartition(7), table, ["k"], "left", "n", bound=3),
                lookup_join(df.repartition(7), table, ["k"], "left", "n", bound=3, rows_per_task=5),
                lookup_join(df, table, ["k"])):
        assert sorted(map(str, out.select("id", "k", "n").collect())) == plain


def test_within(spark):
    assert within(spark.range(5), 5) and not within(spark.range(6), 5)


def test_hash_row_numbers_are_a_permutation_in_hash_order(spark):
    df = spark.range(5000).withColumn("h", R.key_hash("id", 1))
    out = R.hash_row_number(df, "id", F.col("h"), "rank", n_rows=900_000).toPandas()  # many hash ranges
    assert sorted(out["rank"]) == list(range(5000))
    assert (out.sort_values("rank")["h"].diff().dropna() >= 0).all()


@pytest.mark.parametrize("take", [0, 1, 17, 499, 500, 501])
def test_smallest_by_hash_takes_exactly(spark, take):
    df = spark.range(500).withColumn("h", F.col("id") % 7)  # many ties
    assert df.filter(R.smallest_by_hash(df, "id", F.col("h"), take)).count() == min(take, 500)


def test_exact_split_is_stable_under_repartitioning(spark):
    df = spark.range(1003)
    a = split_exact(df, "id").filter("split = 'test'").select("id")
    b = split_exact(df.repartition(5), "id").filter("split = 'test'").select("id")
    assert a.count() == 201 and a.exceptAll(b).count() == 0
    assert split_exact(df, "id", rounding="floor").filter("split = 'test'").count() == 200


@pytest.mark.parametrize("chunk", [4, 7, 1000])
def test_lags_and_running_minima_over_chunks(spark, chunk):
    rng = np.random.default_rng(chunk)
    rows = [("long", int(i * i % 5000 + i * 5000), float(rng.normal())) for i in range(97)] + [("short", 3, 1.0), ("short", 9, -1.0)]
    df = spark.createDataFrame(rows, "run string, t int, x double")
    want = pd.DataFrame(rows, columns=["run", "t", "x"]).sort_values(["run", "t"]).reset_index(drop=True)
    for k in (1, 4):
        want[f"l{k}"] = want.groupby("run")["x"].shift(k)
    want["m"] = want.groupby("run")["x"].cummin()
    want["p"] = want.groupby("run")["m"].shift(1)
    lags = R.with_lags(df, ["run"], "t", {"l1": ("x", 1), "l4": ("x", 4)}, chunk).toPandas().sort_values(["run", "t"]).reset_index(drop=True)
    mins = R.with_running_min(df, ["run"], "t", "x", "m", "p", chunk).toPandas().sort_values(["run", "t"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(lags[["run", "t", "l1", "l4"]], want[["run", "t", "l1", "l4"]], check_dtype=False)
    pd.testing.assert_frame_equal(mins[["run", "t", "m", "p"]], want[["run", "t", "m", "p"]], check_dtype=False)


def test_short_chunks_do_not_make_a_range_each(spark, monkeypatch):
    df = spark.range(2000).select((F.col("id") % 7).alias("run"), F.col("id").alias("t"))
    asked, plain = [], type(df).repartitionByRange
    monkeypatch.setattr(type(df), "repartitionByRange", lambda self, n, *columns: asked.append(n) or plain(self, n, *columns))
    ranked, release = R._chunked(df, ["run"], "t", 4)
    rows = ranked.select("run", "t", "__rank", "__chunk").collect()
    release()
    assert asked == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
    assert len(rows) == 2000 and all((r["__rank"], r["__chunk"]) == (r["t"] // 7, r["t"] // 28) for r in rows)
