"""Training jobs (K1-K27): statistics once, then every (group, setup) pair is a row that trains on the executors."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from dataclasses import fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slopeworks.operators.gram import gram_stats
from slopeworks.plans.config import FAMILY, SETUP_DDL, Setup, setups_frame
from slopeworks.plans.steps import minimise

MAX_SETUPS = 10_000
RESULT_BYTES = 4 * 2**20  # of Python objects that a task gathers before it hands them on
ROW_BYTES, RECORD_BYTES, WEIGHT_BYTES = 2048, 256, 32  # of a result, of a history record without its weights, of a weight
ROWS_AT_ONCE = 256  # statistics a task turns into Python objects at a time

RESULT_DDL = (
    "stopped boolean, converged boolean, reason string, final_iteration int, final_loss double, final_gradient_norm double, "
    "best_iteration int, best_loss double, best_gradient_norm double, weights array<double>, last_weights array<double>, "
    "n double, n_features int, function_evaluations long, gradient_evaluations long, hessian_evaluations long, "
    "skipped_updates long, total_operations double, training_time double, "
    "history array<struct<iteration:int,loss:double,gradient_norm:double,step_size:double,weights:array<double>>>"
)
SETUP_FIELDS = [f.name for f in fields(Setup)]


def pair_with_setups(stats: DataFrame, setups: DataFrame | Sequence[Setup]) -> DataFrame:
    """Each statistic row next to each setup: a bounded list of setups is one scalar array that every row explodes."""
    frame = setups if isinstance(setups, DataFrame) else setups_frame(stats.sparkSession, setups)
    count = frame.count()
    if count <= MAX_SETUPS:
        packed = frame.agg(F.collect_list(F.struct(*SETUP_FIELDS)).alias("all")).scalar()
        return stats.withColumn("s", F.explode(packed)).select(*stats.columns, "s.*")
    # A larger sweep is cut into packs of about that size, and every statistic meets every pack.
    packs = -(-count // MAX_SETUPS)
    pack = F.pmod(F.xxhash64(*SETUP_FIELDS), F.lit(packs)).cast("int")
    packed = frame.groupBy(pack.alias("__pack")).agg(F.collect_list(F.struct(*SETUP_FIELDS)).alias("all"))
    spread = stats.withColumn("__pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
    return spread.join(packed, "__pack").withColumn("s", F.explode("all")).select(*stats.columns, "s.*")


def held_bytes(result: dict) -> int:
    """About what a result takes as Python objects, which is many times its numbers."""
    records, width = len(result["history"]), len(result["weights"])
    kept = sum(r[4] is not None for r in result["history"])
    return ROW_BYTES + records * RECORD_BYTES + (kept + 2) * width * WEIGHT_BYTES


def fit_stats(stats: DataFrame, setups: DataFrame | Sequence[Setup], group_cols: Sequence[str] = ()) -> DataFrame:
    """One row per (group, setup) with the result and the nested history.

    Write or persist the result before reading it twice: both readings would train again.
    """
    groups = list(group_cols)
    rows = pair_with_setups(stats, setups)
    # Few tiny rows with real work each: a fixed number of partitions keeps them apart.
    tasks = stats.sparkSession.sparkContext.defaultParallelism
    rows = rows.repartition(tasks, *groups, "setup")
    schema = T.StructType([*[stats.schema[g] for g in groups], *T.StructType.fromDDL(SETUP_DDL).fields,
                           *T.StructType.fromDDL(RESULT_DDL).fields])

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in frames:
            rows = (row for at in range(0, len(pdf), ROWS_AT_ONCE) for row in pdf.iloc[at : at + ROWS_AT_ONCE].to_dict("records"))
            for row in rows:
                started = time.perf_counter()
                m = np.asarray(row["zz"], dtype=float)
                setup = {k: row[k] for k in SETUP_FIELDS}
                result = minimise(m.reshape(int(len(m) ** 0.5), -1), setup)
                made = {**{g: row[g] for g in groups}, **setup, **result, "training_time": time.perf_counter() - started}
                held.append(made)
                size += held_bytes(made)
                if size > RESULT_BYTES:  # histories can be long
                    yield pd.DataFrame(held, columns=schema.names)
                    held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=schema.names)

    family = F.create_map(*[x for k, v in FAMILY.items() for x in (F.lit(k), F.lit(v))])
    key = F.concat_ws("/", family[F.col("method")], "setup", *[F.col(g).cast("string") for g in groups])
    return rows.mapInPandas(train, schema).withColumns({"family": family[F.col("method")], "run_id": key})


def fit(df: DataFrame, features: Sequence[str], label: str, setups: DataFrame | Sequence[Setup],
        group_cols: Sequence[str] = ()) -> DataFrame:
    """The whole job: one statistics pass over the table, then all setups for all groups."""
    return fit_stats(gram_stats(df, features, label, group_cols), setups, group_cols)


def history_of(runs: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Long history (run_id, group..., iteration, loss, gradient_norm, step_size, weights)."""
    return runs.select("run_id", *group_cols, F.explode("history").alias("h")).select("run_id", *group_cols, "h.*")


def library_baseline(df: DataFrame, features: Sequence[str], label: str, solver: str = "normal", loss: str = "squaredError",
                     regularization: float = 0.0, l1_ratio: float = 0.0, max_iter: int = 100) -> DataFrame:
    """Spark's own linear regression as a cross-check (K25): rows (feature, weight) with 'bias' for the intercept."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    table = VectorAssembler(inputCols=list(features), outputCol="__x").transform(df.select(*features, label))
    model = LinearRegression(featuresCol="__x", labelCol=label, solver=solver, loss=loss, regParam=regularization,
                             elasticNetParam=l1_ratio, maxIter=max_iter, standardization=False).fit(table)
    rows = [(c, float(w)) for c, w in zip([*features, "bias"], [*model.coefficients, model.intercept])]
    return df.sparkSession.createDataFrame(rows, "feature string, weight double")
