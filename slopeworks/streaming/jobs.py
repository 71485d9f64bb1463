"""Structured Streaming jobs: cleaned ingest (N1), incremental least squares (N2), scoring."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from slopeworks.functions.text import clean_text_columns, parse_units
from slopeworks.operators.evaluate import score_table
from slopeworks.operators.gram import gram_stats, normal_equations


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def clean_stream(stream: DataFrame) -> DataFrame:
    """Text cleaning and unit parsing: stateless, so the same code as for a table."""
    return parse_units(clean_text_columns(stream))


def score_stream(stream: DataFrame, features: str, model: dict, run_name: str) -> DataFrame:
    """Predictions as a stateless projection."""
    return score_table(stream, features, model, run_name)


def write_stream(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    return stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(
        availableNow=True).start()


def accumulate_stats(stream: DataFrame, features: Sequence[str], label: str, path: str, checkpoint: str,
                     group_cols: Sequence[str] = (), stream_id: str | None = None) -> StreamingQuery:
    """Adds each micro-batch's statistic to a table keyed by stream and batch id.

    A batch that is delivered again overwrites its own partition, so a repeat changes nothing. Batch ids start anew with
    every checkpoint, so the stream's id comes from the checkpoint's place unless it is given.
    """
    stream_key = stream_id or hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def add(batch: DataFrame, batch_id: int) -> None:
        stats = gram_stats(batch, features, label, group_cols).withColumns({"stream_id": F.lit(stream_key), "batch_id": F.lit(batch_id)})
        stats.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream_id", "batch_id").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_stats(spark: SparkSession, path: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """The statistic of everything seen so far: an element-wise sum over batches."""
    parts = spark.read.parquet(path).filter(F.col("zz").isNotNull())
    cells = parts.select(*group_cols, F.posexplode("zz").alias("i", "v")).groupBy(*group_cols, "i").agg(F.sum("v").alias("v"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "v")))  # (d+2)^2 cells per group
    return cells.groupBy(*group_cols).agg(F.transform(ordered, lambda c: c["v"]).alias("zz"))


def compact_stats(spark: SparkSession, path: str, target: str, group_cols: Sequence[str] = ()) -> None:
    """Writes the sum of all batches as one batch of a new table, which a later stream can go on from."""
    merged = merged_stats(spark, path, group_cols).withColumns({"stream_id": F.lit("compacted"), "batch_id": F.lit(0)})
    merged.write.mode("errorifexists").partitionBy("stream_id", "batch_id").parquet(target)


def current_model(spark: SparkSession, path: str, group_cols: Sequence[str] = (), ridge: float = 0.0) -> DataFrame:
    return normal_equations(merged_stats(spark, path, group_cols), group_cols, ridge)
