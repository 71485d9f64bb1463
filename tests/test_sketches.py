"""Stored sketches: merging, awkward values, and the exact quantiles that take their brackets from them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopeworks.operators.profile import numeric_summary, target_statistics
from slopeworks.operators.quantiles import approximate_quantiles, exact_quantiles
from slopeworks.operators.sketches import merge_sketches, rank_error, sketch_columns, sketched_quantiles, sketched_summary


def test_merged_sketches_describe_all_parts(spark):
    r = np.random.default_rng(1)
    values = np.concatenate([r.normal(1e6, 3, 40_000), np.repeat(5.0, 20_000), [0.0] * 100]).tolist()
    df = spark.createDataFrame([(int(k % 7), v) for k, v in enumerate(values)] + [(1, None), (2, float("nan"))], "part int, x double").withColumn("none", F.lit(None).cast("double"))
    parts = sketch_columns(df, ["x", "none"], ["part"])
    assert parts.count() == 14
    merged = merge_sketches(parts)
    got = {row["column"]: row for row in sketched_summary(merged).collect()}
    x = got["x"]
    assert (x["count"], x["min"], x["max"]) == (len(values), 0.0, max(values))
    assert x["mean"] == pytest.approx(np.mean(values)) and x["std"] == pytest.approx(np.std(values, ddof=1)) and x["zeros_pct"] == pytest.approx(10_000 / (len(values) + 2))
    assert x["distinct_count"] == pytest.approx(len(set(values)), rel=0.08)
    for q in sketched_quantiles(merged, [0.0, 0.2, 0.5, 0.9, 1.0]).collect():
        below, upto = np.mean(np.array(values) < q["value"]), np.mean(np.array(values) <= q["value"])
        assert below - rank_error(4096) <= q["p"] <= upto + rank_error(4096)
    none = got["none"]
    assert none["count"] == none["distinct_count"] == 0 and none["median"] is None and none["mean"] is None and none["missing_pct"] == 100.0
    assert sketched_quantiles(merged, [0.5]).count() == 1


@pytest.mark.parametrize("few_rows", [0, 2_000_000])
def test_quantiles_are_exact_by_either_path(spark, few_rows):
    r = np.random.default_rng(2)
    values = np.concatenate([r.integers(0, 5, 5000), r.normal(0, 1, 5000), [np.inf, -np.inf, 4.0]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.999, 1.0]
    got = {q["p"]: q["value"] for q in exact_quantiles(df, ["x"], probs, one_pass_rows=few_rows, accuracy=40).collect()}
    ordered = np.sort(values)
    ends = {0.0: -np.inf, 1.0: np.inf}  # numpy has no number for these
    assert got == {p: pytest.approx(ends[p] if p in ends else np.quantile(ordered, p), rel=1e-12) for p in probs}


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [7.0] * 50, [1.0] * 99 + [1e300], list(np.exp(np.random.default_rng(3).normal(0, 2, 3000)))])
@pytest.mark.parametrize("few_rows", [0, 2_000_000])
def test_target_statistics_by_either_path(spark, values, few_rows):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (-1.0,), (float("nan"),)], "x double")
    got = target_statistics(df, "x", few_rows=few_rows).first()
    q1, median, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert (got["q1"], got["median"], got["q3"]) == pytest.approx((q1, median, q3)) and got["count"] == len(values)
    assert got["outliers_count"] == sum(v < low or v > high for v in values)


def test_an_approximate_summary_shuffles_no_values(spark):
    df = spark.range(200_000).select((F.col("id") * 0.5).alias("x"), (F.col("id") % 11).cast("double").alias("y"))
    approximate, exact = ({r["column"]: r for r in numeric_summary(df, approximate=a).collect()} for a in (True, False))
    for c in ("x", "y"):
        assert approximate[c]["distinct_count"] == pytest.approx(exact[c]["distinct_count"], rel=0.08)
        assert [approximate[c][k] for k in ("count", "mean", "min", "max")] == pytest.approx([exact[c][k] for k in ("count", "mean", "min", "max")])
    assert approximate["x"]["median"] == pytest.approx(50_000, rel=0.02)
    by_group = approximate_quantiles(df.withColumn("g", F.col("y") > 5), ["x"], [0.5], ["g"]).collect()
    assert len(by_group) == 2 and all(r["value"] == pytest.approx(50_000, rel=0.05) for r in by_group)
