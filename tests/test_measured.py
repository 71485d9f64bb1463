"""Cost of trainings as measured by Spark while the passes run."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopeworks.plans.passes import PassMeter, fit_by_passes, measured_sizes


def lines(spark, n=200):
    return spark.range(n, numPartitions=4).select("id", (F.col("id") / n).alias("x"), (F.col("id") / n * 2 + 1).alias("y"))


def test_meter_counts_the_passes_of_a_line_search(spark):
    meter = PassMeter()
    model = fit_by_passes(lines(spark), ["x"], "y", loss="huber", delta=0.1, max_iter=4, meter=meter)[0].first()
    rows = meter.frame(spark).orderBy("pass").collect()
    assert len(rows) == model["data_passes"] and {r["rows_read"] for r in rows} == {200}
    assert rows[0]["points"] == 1 and rows[1]["points"] > 1
    assert all(r["multiplications"] == 200 * 2 * 2 * r["points"] and r["points"] <= r["partial_rows"] <= 4 * r["points"] for r in rows)


def test_unmetered_training_is_the_same(spark):
    a, b = (fit_by_passes(lines(spark), ["x"], "y", max_iter=5, meter=m)[0].first()["weights"] for m in (None, PassMeter()))
    assert np.allclose(a, b, rtol=1e-12)


def test_shares_are_nested_and_an_empty_share_is_an_error(spark):
    def train(part, meter):
        fit_by_passes(part, ["x"], "y", loss="ols", method="gd", learning_rate=0.1, max_iter=2, tolerance=0.0, meter=meter)

    place = F.col("id") * F.lit(2**32) / F.lit(200)
    rows = measured_sizes(lines(spark), [0.1, 0.5, 1.0], place, train).orderBy("share").collect()
    assert [(r["n"], r["passes"], r["rows_read"]) for r in rows] == [(20, 3, 60), (100, 3, 300), (200, 3, 600)]
    with pytest.raises(ValueError, match="no rows"):
        measured_sizes(lines(spark), [0.0], place, train)
