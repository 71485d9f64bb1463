"""Heavy hitters: bounds of the summaries, both paths, ties, awkward values."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopeworks.operators.heavy import add_counts, candidates, shed, top_values
from slopeworks.operators.impute import _modes
from slopeworks.operators.profile import top_category_means, top_value_shares


def brute(values, k):
    return sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("capacity", [1, 3, 17, 400])
def test_summaries_never_lose_more_than_they_say(capacity):
    r = np.random.default_rng(capacity)
    values = np.concatenate([r.zipf(1.4, 6000) % 500, np.full(900, 7)]).astype(np.int64)
    r.shuffle(values)
    keys, counts, lost = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
    for part in np.array_split(values, 40):
        keys, counts = add_counts(keys, counts, part)
        keys, counts, cut = shed(keys, counts, capacity)
        lost += cut
        assert len(keys) <= capacity
    kept = dict(zip(keys.tolist(), counts.tolist()))
    for v, n in Counter(values.tolist()).items():
        assert kept.get(v, 0) <= n <= kept.get(v, 0) + lost
    assert lost <= len(values) / (capacity + 1)


@pytest.mark.parametrize("capacity", [1, 8, 60, 5000])
@pytest.mark.parametrize("partitions", [1, 7])
def test_top_values_are_exact_at_any_capacity(spark, capacity, partitions):
    r = np.random.default_rng(3)
    skewed = [f"w{v}" for v in (r.zipf(1.3, 4000) % 900)]
    flat = [f"f{k % 1000}" for k in range(4000)]  # all tie: the smallest texts win
    hot = ["x" if k % 3 == 0 else None if k % 3 == 1 else f"u{k}" for k in range(4000)]
    df = spark.createDataFrame(list(zip(skewed, flat, hot, [None] * 4000)), "skewed string, flat string, hot string, none string").repartition(partitions)
    got = top_values(df, df.columns, 5, capacity)
    assert got["skewed"] == brute(skewed, 5)
    assert got["flat"] == brute(flat, 5)
    assert got["hot"] == brute(hot, 5)
    assert got["none"] == []


def test_a_heavy_tail_is_answered_without_counting_all_values(spark):
    words = ["a"] * 3000 + ["b"] * 2000 + ["c"] * 1000 + [f"r{k}" for k in range(20_000)]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(6)
    found = candidates(df, ["w"], 3, capacity=200)["w"]
    assert not found.hopeless and len(found.keys) <= 200 and 0 < found.bound < 1000
    assert candidates(df, ["w"], 500, capacity=200)["w"].hopeless
    assert top_values(df, ["w"], 3, 200)["w"] == [("a", 3000), ("b", 2000), ("c", 1000)]


def test_numbers_compare_as_in_a_grouping(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),), (float("nan"),), (2.0,), (None,)], "x double")
    (first, second, third) = top_values(df, ["x"], 3)["x"]
    assert np.isnan(first[0]) and first[1] == 3 and second == (0.0, 2) and third == (2.0, 1)
    assert _modes(spark.createDataFrame([(10, "b", None), (9, "a", None)], "n int, s string, e string"), ["n", "s", "e"]) == {"n": 9, "s": "a", "e": None}


def test_empty_tables_names_and_limits(spark):
    empty = spark.createDataFrame([], "column string, value string")
    assert top_values(empty, ["column", "value"], 2) == {"column": [], "value": []}
    assert top_value_shares(empty).count() == 0 and top_values(empty, [], 2) == {}
    df = spark.createDataFrame([("x", None), ("x", "long" * 100_000), (None, None)], "column string, value string")
    got = [(r["column"], r["place"], r["n"], round(r["pct"], 3)) for r in top_value_shares(df, k=3).collect()]
    assert got == [("column", 1, 2, 66.667), ("value", 1, 1, 33.333)]
    with pytest.raises(ValueError, match="capacity"):
        top_values(df, ["column"], 1, 0)


@pytest.mark.parametrize("capacity", [1, 30, 3000])
def test_means_of_heavy_hitters_are_those_of_the_whole_grouping(spark, capacity):
    df = spark.range(9000).select(F.when(F.col("id") % 4 == 0, F.concat(F.lit("t"), F.col("id").cast("string"))).when(F.col("id") % 4 == 1, None)
                                  .otherwise(F.concat(F.lit("h"), (F.col("id") % 12).cast("string"))).alias("c"), "id")
    assert top_category_means(df, "c", "id", 6, capacity).collect() == top_category_means(df, "c", "id", 6).collect()
    assert top_category_means(df.limit(0), "c", "id", 6, capacity).collect() == []
