"""Matrix tables in buckets of the row key."""

import pytest
from pyspark.sql import functions as F

from slopeworks.sources import tables as S


def stored(spark, tmp_path, buckets=(4, 4)):
    x = spark.range(200).select(F.col("id").alias("row_id"), F.array(F.col("id") * 0.5).alias("features"), F.lit("a b").alias("odd name"))
    y = spark.range(100, 300).select(F.col("id").alias("row_id"), (F.col("id") * 2.0).alias("label"))
    x = x.unionByName(x.limit(1).withColumn("row_id", F.lit(None).cast("long")))
    y = y.unionByName(y.limit(1).withColumn("row_id", F.lit(None).cast("long")))
    for name, df, n in (("x", x, buckets[0]), ("y", y, buckets[1])):
        S.write_buckets(df, str(tmp_path / name), n)
    return S.align_stored(spark, str(tmp_path / "x"), str(tmp_path / "y"))


def test_stored_tables_align_without_a_shuffle(spark, tmp_path):
    both = stored(spark, tmp_path)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    rows = {r["row_id"]: (r["features"][0], r["label"], r["odd name"]) for r in both.collect()}
    assert rows == {i: (i * 0.5, i * 2.0, "a b") for i in range(100, 200)}
    assert S.read_buckets(spark, str(tmp_path / "x")).count() == 201  # the null key is kept


def test_other_bucket_counts_still_align(spark, tmp_path):
    assert stored(spark, tmp_path, (4, 3)).count() == 100


def test_empty_tables_and_existing_paths(spark, tmp_path):
    empty = spark.createDataFrame([], "row_id long, label double")
    S.write_buckets(empty, str(tmp_path / "e"), 4)
    assert S.read_buckets(spark, str(tmp_path / "e")).count() == 0
    with pytest.raises(Exception, match="non-empty"):
        S.write_buckets(empty, str(tmp_path / "e"), 4)
