"""Run results and histories: JSON and CSV trees in, one flat table out; Parquet sinks."""

from __future__ import annotations

import re
import uuid

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slopeworks.operators.joins import lookup_join

# Every place the result files of the different families keep a value.
RESULT_SCHEMA = """
    algorithm string, loss_function string, loss_type string, parameters map<string,string>,
    training_results struct<training_time:double, converged:boolean, final_iteration:int, final_epoch:int, total_iterations:int,
        final_loss:double, final_cost:double, final_gradient_norm:double, best_iteration:int, best_epoch:int, best_loss:double,
        best_gradient_norm:double, final_velocity_norm:double, condition_number:double>,
    weights_analysis struct<n_features:int, bias_value:double, complete_weight_vector:array<double>>,
    convergence_analysis struct<convergence_rate:string, loss_reduction_ratio:double>,
    numerical_analysis struct<hessian_condition_number:double, average_step_size:double>,
    sparsity_analysis struct<sparsity_ratio:double, active_features:int>,
    algorithm_specific struct<gradient_descent_type:string, momentum_used:boolean, acceleration_used:boolean>,
    computational_complexity struct<
        basic_metrics:struct<function_evaluations:bigint, gradient_evaluations:bigint, total_operations:double, peak_memory_size:bigint>,
        per_iteration_averages:struct<operations_per_iter:double>,
        efficiency_metrics:struct<operations_to_convergence:double, convergence_efficiency:double>,
        scalability_metrics:struct<operations_per_problem_unit:double, memory_efficiency:double>>,
    metrics_log_scale struct<mse:double, r2:double, mae:double>,
    metrics_original_scale struct<mse:double, rmse:double, mae:double, r2:double, mape:double>,
    training_time double, training_time_seconds double, converged boolean, iterations int, final_iterations int,
    final_loss double, final_gradient_norm double, function_evaluations bigint, weights array<double>,
    convergence struct<converged:boolean, iterations:int, final_loss:double, final_gradient_norm:double>,
    corrupt string
"""

HISTORY_TYPES = {
    "run_id": "string", "iteration": "int", "loss": "double", "gradient_norm": "double", "velocity_norm": "double",
    "step_size": "double", "line_search_iterations": "int", "condition_number": "double", "learning_rate": "double",
}

# Other names of history columns in some families.
HISTORY_NAMES = {"epoch": "iteration", "line_search_iter": "line_search_iterations"}


def _path_parts(path: Column) -> dict[str, Column]:
    """`.../family/setup/file` to family, setup and run_id; partition folders such as `family=x` count as `x`."""
    path = F.regexp_replace(path, "/[a-z]+=", "/")
    family = F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1)
    setup = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    return {"family": family, "setup": setup, "run_id": F.concat_ws("/", family, setup)}


def read_results(spark: SparkSession, pattern: str, multi_line: bool = True) -> DataFrame:
    """Result files under a glob such as `runs/*/*/results.json`, unflattened; broken files are kept with `corrupt` set.

    Without `multi_line` every line of a file is one document.
    """
    raw = (spark.read.schema(RESULT_SCHEMA).option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt")
           .option("columnNameOfCorruptRecord", "corrupt").json(pattern))
    path = F.col("_metadata.file_path")
    return raw.select("*", path.alias("path"), F.timestamp_seconds(F.unix_timestamp("_metadata.file_modification_time")).alias("modified")
                      ).withColumns(_path_parts(F.col("path")))


def flatten_results(results: DataFrame) -> DataFrame:
    """One flat metric row per run, from whichever place its family uses."""
    t, c, cc = "training_results", "convergence", "computational_complexity"

    def pick(*paths: str) -> Column:
        return F.coalesce(*[F.col(p) for p in paths])

    def number(*names: str) -> Column:
        return F.coalesce(*[F.col("parameters")[n].try_cast("double") for n in names])

    basic, rate = f"{cc}.basic_metrics", f"{cc}.per_iteration_averages"
    keep = [n for n in ("run_id", "family", "setup", "path", "modified") if n in results.columns]
    intact = results.filter(F.col("corrupt").isNull()) if "corrupt" in results.columns else results
    return intact.select(
        *keep, F.coalesce("algorithm", F.lit("Unknown")).alias("algorithm"),
        F.coalesce("loss_function", "loss_type", F.lit("Unknown")).alias("loss_function"), "parameters",
        pick(f"{t}.training_time", "training_time", "training_time_seconds").alias("training_time"),
        F.coalesce(pick(f"{t}.converged", f"{c}.converged", "converged"), F.lit(False)).alias("converged"),
        pick(f"{t}.final_iteration", f"{t}.final_epoch", f"{c}.iterations", "iterations", "final_iterations").alias("iterations"),
        F.coalesce(pick(f"{t}.final_loss", f"{t}.final_cost", f"{c}.final_loss", "final_loss"), F.lit(float("inf"))).alias("final_loss"),
        pick(f"{t}.final_gradient_norm", f"{c}.final_gradient_norm", "final_gradient_norm").alias("final_gradient_norm"),
        F.col(f"{t}.best_loss").alias("best_loss"), pick(f"{t}.best_iteration", f"{t}.best_epoch").alias("best_iteration"),
        F.col(f"{t}.best_gradient_norm").alias("best_gradient_norm"),
        number("learning_rate").alias("learning_rate"), number("max_iterations", "max_epochs").alias("max_iterations"),
        number("tolerance").alias("tolerance"), number("momentum").alias("momentum"),
        number("regularization", "regularization_lambda", "lambda_penalty").alias("regularization"), number("batch_size").alias("batch_size"),
        F.coalesce(F.col("parameters")["step_size_method"], F.lit("constant")).alias("step_size_method"),
        F.coalesce(F.col("parameters")["learning_rate_schedule"], F.lit("constant")).alias("learning_rate_schedule"),
        pick("numerical_analysis.hessian_condition_number", f"{t}.condition_number").alias("condition_number"),
        F.col("convergence_analysis.convergence_rate").alias("convergence_kind"),
        F.col("sparsity_analysis.sparsity_ratio").alias("sparsity_ratio"),
        pick(f"{basic}.function_evaluations", "function_evaluations").alias("function_evaluations"),
        F.col(f"{basic}.gradient_evaluations").alias("gradient_evaluations"), F.col(f"{basic}.total_operations").alias("total_operations"),
        F.col(f"{rate}.operations_per_iter").alias("operations_per_iteration"), F.col(cc).isNotNull().alias("has_complexity"),
        F.col("metrics_log_scale.r2").alias("r2_log_scale"), F.col("metrics_original_scale.r2").alias("r2"),
        F.col("metrics_original_scale.rmse").alias("rmse"), F.col("metrics_original_scale.mape").alias("mape"))


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    return flatten_results(read_results(spark, pattern))


def read_histories(spark: SparkSession, pattern: str) -> DataFrame:
    """History files of all families under a glob, as one long table; columns a family lacks are null.

    Headers differ per family, so each line is matched with the header of its own file.
    """
    lines = spark.read.text(pattern).select("value", F.col("_metadata.file_path").alias("path"))
    is_header = F.col("value").rlike("^(iteration|epoch),")
    headers = lines.filter(is_header).groupBy("path").agg(F.first("value").alias("header"))  # one row per file
    rows = lookup_join(lines.filter(~is_header & (F.col("value") != "")), headers, ["path"], "inner")
    names, cells = F.split("header", ","), F.split("value", ",")
    rows = rows.withColumns(_path_parts(F.col("path"))).withColumn("cells", F.when(F.size(names) == F.size(cells), F.map_from_arrays(names, cells)))

    def read(name: str, kind: str) -> Column:
        options = [name, *[k for k, v in HISTORY_NAMES.items() if v == name]]
        return F.coalesce(*[F.try_element_at("cells", F.lit(o)) for o in options]).try_cast(kind).alias(name)

    return rows.select("run_id", *[read(c, t) for c, t in HISTORY_TYPES.items() if c != "run_id"])


COMMIT_SCHEMA = "batch string, attempt string, version long, replaces boolean, state string"


def _append(df: DataFrame, path: str, batch: str, attempt: str) -> str:
    """One table of a batch, in a folder of its own attempt that nothing else writes to."""
    folder, keys = f"{path}/batch={batch}/attempt={attempt}", [c for c in ("family",) if c in df.columns and len(df.columns) > 1]
    df.write.mode("append").partitionBy(*keys).parquet(folder)
    return folder


def _log(spark: SparkSession, path: str, batch: str, attempt: str, version: int, replaces: bool, state: str) -> None:
    spark.createDataFrame([(batch, attempt, version, replaces, state)], COMMIT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/commits")


class Batch:
    """A batch of tables in a store at `path`; readers see all of its tables or none.

    Used as a context: entering logs the attempt, `store` writes a table, and leaving without an error appends the one commit
    row that makes them visible. Work that fails stays invisible. A later attempt under the same batch name takes the place of
    an earlier one, and a batch that `replaces` hides all batches before it. Nothing is overwritten, so readers that
    have started keep their files. Of writers of one version the larger attempt counts as the later.
    """

    def __init__(self, spark: SparkSession, path: str, batch: str | None = None, replaces: bool = False):
        self.spark, self.path, self.batch, self.replaces = spark, path, batch or uuid.uuid4().hex, replaces
        self.attempt = uuid.uuid4().hex
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", self.batch):
            raise ValueError("a batch name is made of letters, digits and _ . -")

    def __enter__(self) -> Batch:
        _log(self.spark, self.path, self.batch, self.attempt, 0, self.replaces, "started")
        return self

    def store(self, df: DataFrame, table: str) -> DataFrame:
        """Writes a table and returns it as it is stored."""
        folder = _append(df, f"{self.path}/{table}", self.batch, self.attempt)
        return self.spark.read.schema(df.schema).parquet(folder).select(*df.columns)

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            last = attempts(self.spark, self.path).agg(F.max("version")).first()[0]
            _log(self.spark, self.path, self.batch, self.attempt, last + 1, self.replaces, "committed")


def attempts(spark: SparkSession, path: str) -> DataFrame:
    """The log of a store: one row when an attempt starts and one when it is committed."""
    return spark.read.schema(COMMIT_SCHEMA).parquet(f"{path}/commits")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(batch, attempt) that readers see: the latest committed attempt of each batch since the last one that replaced all."""
    done = attempts(spark, path).filter(F.col("state") == "committed").withColumn("at", F.struct("version", "attempt"))
    since = done.agg(F.max(F.when(F.col("replaces"), F.col("at")))).first()[0]
    kept = done.groupBy("batch").agg(F.max("at").alias("at"))
    if since is not None:
        kept = kept.filter(F.col("at") >= F.struct(F.lit(since["version"]).alias("version"), F.lit(since["attempt"]).alias("attempt")))
    return kept.select("batch", F.col("at.attempt").alias("attempt"))


def unfinished(spark: SparkSession, path: str) -> DataFrame:
    """(batch, attempt) that were started and not committed: running, or failed."""
    log = attempts(spark, path)
    return log.select("batch", "attempt").distinct().join(log.filter(F.col("state") == "committed"), ["batch", "attempt"], "left_anti")


def read_committed(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The rows of a table that belong to committed batches, with their `batch`; other attempts' folders are pruned."""
    found = spark.read.parquet(f"{path}/{table}").schema
    text = T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("batch", "attempt", "family") else f for f in found])  # 007 is a name
    rows = spark.read.schema(text).parquet(f"{path}/{table}")
    return rows.join(committed(spark, path), ["batch", "attempt"], "left_semi").drop("attempt")


def write_runs(runs: DataFrame, path: str, group_cols: Sequence[str] = (), mode: str = "append", batch: str | None = None) -> None:
    """Trained runs and their histories as one batch of a store: both are visible to readers, or neither.

    The nested rows are written first and read back, so training happens once. A retry under the same batch name replaces
    that batch; `overwrite` hides all earlier ones.
    """
    with Batch(runs.sparkSession, path, batch, replaces=mode == "overwrite") as b:
        stored = b.store(runs, "nested")
        b.store(stored.drop("history"), "runs")
        b.store(stored.select("family", "run_id", *group_cols, F.explode("history").alias("h")).select("family", "run_id", *group_cols, "h.*"), "history")


def read_written_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_committed(spark, path, "runs").drop("batch"), read_committed(spark, path, "history").drop("batch")


def as_comparison_runs(trained: DataFrame) -> DataFrame:
    """Trained rows under the column names the comparison reports use."""
    return trained.select("*", F.concat_ws(" - ", "method", F.upper("loss")).alias("algorithm"), F.upper("loss").alias("loss_function"),
                          F.col("final_iteration").alias("iterations"))
