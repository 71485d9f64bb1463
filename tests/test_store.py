"""The result store: batches become visible as a whole, or not at all."""

import pytest
from pyspark.sql import functions as F

from slopeworks.operators.gram import gram_stats
from slopeworks.plans import compare as CM
from slopeworks.plans.config import Setup
from slopeworks.plans.train import fit_stats
from slopeworks.sources import runs as R


def trained(spark, *names):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(20)], "x double, y double")
    return R.as_comparison_runs(fit_stats(gram_stats(df, ["x"], "y"), [Setup(setup=n, method="newton", check_every=1) for n in names]))


def seen(spark, path):
    runs, history = R.read_written_runs(spark, path)
    ids = sorted(r["run_id"].split("/")[1] for r in runs.select("run_id").collect())
    assert sorted({r["run_id"].split("/")[1] for r in history.select("run_id").collect()}) == sorted(set(ids))
    return ids


def test_a_crash_between_the_writes_leaves_nothing_to_readers(spark, tmp_path, monkeypatch):
    path, append = str(tmp_path / "s"), R._append
    R.write_runs(trained(spark, "a"), path, batch="one")

    def failing(df, where, batch, attempt):
        if where.endswith("/history"):
            raise OSError("executor and driver are gone")
        return append(df, where, batch, attempt)

    monkeypatch.setattr(R, "_append", failing)
    with pytest.raises(OSError):
        R.write_runs(trained(spark, "b", "c"), path, batch="two")
    assert spark.read.parquet(f"{path}/runs").count() == 3  # the rows are there
    assert seen(spark, path) == ["a"] and [r["batch"] for r in R.unfinished(spark, path).collect()] == ["two"]
    monkeypatch.setattr(R, "_append", append)
    R.write_runs(trained(spark, "b", "c"), path, batch="two")
    assert seen(spark, path) == ["a", "b", "c"]


def test_retries_take_the_place_of_their_batch_and_overwrite_of_all(spark, tmp_path):
    path = str(tmp_path / "s")
    R.write_runs(trained(spark, "a", "b"), path, batch="one")
    R.write_runs(trained(spark, "c"), path, batch="two")
    R.write_runs(trained(spark, "d"), path, batch="one")
    assert seen(spark, path) == ["c", "d"]
    R.write_runs(trained(spark, "e"), path, mode="overwrite")
    assert seen(spark, path) == ["e"]
    R.write_runs(trained(spark, "f"), path, batch="two")
    assert seen(spark, path) == ["e", "f"]


def test_a_failed_overwrite_hides_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    R.write_runs(trained(spark, "a"), path)
    with pytest.raises(ValueError), R.Batch(spark, path, replaces=True) as b:
        b.store(trained(spark, "b").drop("history"), "runs")
        raise ValueError("stopped")
    assert seen(spark, path) == ["a"]


def test_names_of_digits_and_empty_batches(spark, tmp_path):
    path = str(tmp_path / "s")
    R.write_runs(trained(spark, "a"), path, batch="007")
    R.write_runs(trained(spark, "b").limit(0), path, batch="8")
    assert seen(spark, path) == ["a"] and R.unfinished(spark, path).count() == 0
    with pytest.raises(ValueError, match="batch name"):
        R.Batch(spark, path, "a/b")


def test_reports_are_one_batch(spark, tmp_path):
    path = str(tmp_path / "s")
    R.write_runs(trained(spark, "a", "b"), path)
    CM.store_reports(*reversed_args(R.read_written_runs(spark, path), path), batch="r")
    CM.store_reports(*reversed_args(R.read_written_runs(spark, path), path), batch="r")
    assert R.read_committed(spark, path, "ordered").count() == 2
    assert R.read_committed(spark, path, "families").agg(F.sum("n_runs")).first()[0] == 2
    assert {r["batch"] for r in R.read_committed(spark, path, "comparison").collect()} == {"r"}


def reversed_args(pair, path):
    runs, history = pair
    return runs, path, history
