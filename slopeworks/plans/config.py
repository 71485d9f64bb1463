"""Training setups as rows: one column per hyper-parameter, so a sweep is a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Setup:
    """One training setup. `method` picks the direction, `step` the step rule, `loss` the objective."""

    setup: str = "gd"
    method: str = "gd"  # gd momentum nesterov adam newton damped_newton bfgs lbfgs sr1 cg newton_cg subgradient prox
    loss: str = "ols"  # ols ridge lasso l1 elastic_net
    step: str = "constant"
    learning_rate: float = 0.1
    regularization: float = 0.0
    l1_ratio: float = 0.5
    momentum: float = 0.9
    decay: float = 0.95
    decay_steps: float = 100.0
    c1: float = 1e-4
    c2: float = 0.9
    rho: float = 0.5
    memory: int = 10
    max_iter: int = 10_000
    tolerance: float = 1e-5
    check_every: int = 100
    keep_weights: bool = False


# Family of each method.
FAMILY = {
    "gd": "gradient_descent", "momentum": "gradient_descent", "nesterov": "gradient_descent", "adam": "gradient_descent",
    "cg": "gradient_descent", "newton": "newton_method", "damped_newton": "newton_method", "newton_cg": "newton_method",
    "bfgs": "quasi_newton", "lbfgs": "quasi_newton", "sr1": "quasi_newton", "subgradient": "subgradient", "prox": "proximal_gd",
}

_TYPES = {"str": "string", "float": "double", "int": "int", "bool": "boolean"}
SETUP_DDL = ", ".join(f"{f.name} {_TYPES[f.type]}" for f in fields(Setup))


def setups_frame(spark: SparkSession, setups: Sequence[Setup]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(s).values()) for s in setups], SETUP_DDL)


def _complete(df: DataFrame, prefix: str) -> DataFrame:
    """Missing hyper-parameters get their defaults; the name lists what varies."""
    varied = [c for c in df.columns if c in {f.name for f in fields(Setup)} and c != "setup"]
    label = F.concat_ws("_", F.lit(prefix), *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in varied])
    out = df.withColumn("setup", label)
    return out.select(*[(F.col(f.name) if f.name in out.columns else F.lit(f.default)).cast(_TYPES[f.type]).alias(f.name)
                        for f in fields(Setup)])


def grid(spark: SparkSession, prefix: str = "grid", **values: Sequence) -> DataFrame:
    """Every combination of the value lists, one row each."""
    df = spark.range(1)
    for name, options in values.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in options])))
    return _complete(df.drop("id"), prefix)


def random_search(spark: SparkSession, n: int, seed: int = 42, prefix: str = "random", fixed: dict | None = None,
                  **ranges: tuple[float, float]) -> DataFrame:
    """`n` rows with log-uniform values in the given positive ranges; the draw is a hash of row number and seed."""
    df = spark.range(n)
    for name, (low, high) in ranges.items():
        u = F.pmod(F.xxhash64(F.col("id"), F.lit(name), F.lit(seed)), F.lit(2**31)) / F.lit(float(2**31))
        df = df.withColumn(name, F.exp(F.log(F.lit(low)) + u * (F.log(F.lit(high)) - F.log(F.lit(low)))))
    for name, value in (fixed or {}).items():
        df = df.withColumn(name, F.lit(value))
    return _complete(df.drop("id"), prefix)
