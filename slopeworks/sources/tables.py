"""Table sources and sinks: declared schemas, model matrix, metadata, model state."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slopeworks.functions.text import normalise_columns
from slopeworks.operators.profile import string_columns


# Column types of a raw listing table (preparation subset).
LISTING_SCHEMA = (
    "price double, year int, make_name string, model_name string, body_type string, fuel_type string, engine_type string, "
    "transmission string, wheel_system string, exterior_color string, interior_color string, listing_color string, "
    "mileage double, horsepower double, engine_displacement double, city_fuel_economy double, highway_fuel_economy double, "
    "seller_rating double, daysonmarket int, owner_count double, length string, width string, height string, wheelbase string, "
    "back_legroom string, front_legroom string, fuel_tank_volume string, maximum_seating string, power string, torque string, "
    "is_new boolean, has_accidents boolean, frame_damaged boolean, fleet boolean")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: Sequence[str] | None = None,
               max_rows: int | None = None, order_by: Sequence[str] = (), fmt: str | None = None, normalise: bool = False) -> DataFrame:
    """CSV, JSON, ORC or Parquet with a column subset and an optional row cap.

    Text formats need a schema: types are declared, not guessed from the data. A cap is taken in `order_by` order.
    """
    fmt = fmt or next((k for k in ("csv", "json", "orc") if path.rstrip("/*").endswith(k)), "parquet")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt in ("csv", "json"):
        raise ValueError(f"a {fmt} table needs a schema")
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    df = normalise_columns(df) if normalise else df
    df = df.select(*columns) if columns else df
    if max_rows is not None:
        if not order_by:
            raise ValueError("a row cap needs order_by: without an order it would keep arbitrary rows")
        df = df.orderBy(*order_by).limit(max_rows)
    return df


def tighten_types(df: DataFrame) -> DataFrame:
    """String columns in which every known value is a number become double (A3); one aggregate decides."""
    names = string_columns(df)
    if not names:
        return df
    row = df.agg(*[F.count(c).alias(f"k__{c}") for c in names],
                 *[F.count(F.col(c).try_cast("double")).alias(f"n__{c}") for c in names]).first()
    numeric = [c for c in names if row[f"k__{c}"] and row[f"k__{c}"] == row[f"n__{c}"]]
    return df.withColumns({c: F.col(c).try_cast("double") for c in numeric}) if numeric else df


# Integer types by their largest value.
INTEGER_TYPES = [("tinyint", 2**7 - 1), ("smallint", 2**15 - 1), ("int", 2**31 - 1), ("bigint", 2**63 - 1)]


def suggest_schema(df: DataFrame) -> DataFrame:
    """Rows (column, type, suggested): the narrowest integer type that holds the data, numbers found in strings (A3)."""
    ints = [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]
    strings = string_columns(df)
    aggs = [a for c in ints for a in (F.min(c).cast("long").alias(f"lo__{c}"), F.max(c).cast("long").alias(f"hi__{c}"))]
    aggs += [(F.count(F.col(c).try_cast("double")) == F.count(c)).alias(f"num__{c}") for c in strings]
    row = df.agg(*aggs) if aggs else df.sparkSession.range(1)

    def narrow(c: str):
        reach = F.greatest(F.col(f"`hi__{c}`"), -(F.col(f"`lo__{c}`") + 1))
        out = F.when(reach.isNull(), F.lit(df.schema[c].dataType.simpleString()))
        for name, bound in INTEGER_TYPES:
            out = out.when(reach <= F.lit(bound), F.lit(name))
        return out

    cells = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        suggested = narrow(f.name) if f.name in ints else (
            F.when(F.col(f"`num__{f.name}`"), F.lit("double")).otherwise(F.lit("string")) if f.name in strings else F.lit(kind))
        cells.append(F.struct(F.lit(f.name).alias("column"), F.lit(kind).alias("type"), suggested.alias("suggested")))
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def assemble(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., features array<double>, label): inputs and target in one row, so nothing is matched by position."""
    return df.select(*keys, F.array(*[F.col(c).cast("double") for c in features]).alias("features"), F.col(label).cast("double").alias("label"))


def align(x: DataFrame, y: DataFrame, key: str = "row_id") -> DataFrame:
    """Features and targets stored apart, joined on an explicit row key."""
    return x.join(y, key)


def write_buckets(df: DataFrame, path: str, buckets: int, key: str = "row_id") -> None:
    """A table stored in hash buckets of its row key, so that tables of as many buckets meet without a shuffle (A4, A5).

    `path` has the rows, in one sorted file per bucket, and a row that declares schema, key and buckets. Rows of a null key are
    kept and never match. `buckets` is to follow the size of the larger table: a task reads one bucket of each.
    """
    spark, name = df.sparkSession, f"slopeworks_{uuid.uuid4().hex}"
    declared = spark.createDataFrame([(df.schema.json(), key, buckets)], "schema string, key string, buckets int")
    rows = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
    rows.mode("errorifexists").option("path", f"{path}/rows").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the session forgets the name; the files stay
    declared.coalesce(1).write.parquet(f"{path}/declared")


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """A table of `write_buckets`, with its buckets known to the planner."""
    d = spark.read.parquet(f"{path}/declared").first()
    name = "slopeworks_" + hashlib.sha256(f"{path} {d['schema']} {d['key']} {d['buckets']}".encode()).hexdigest()[:32]
    columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(d["schema"])))
    key, place = f"`{d['key'].replace('`', '``')}`", f"{path}/rows".replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
              f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {d['buckets']} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def align_stored(spark: SparkSession, x_path: str, y_path: str, key: str = "row_id") -> DataFrame:
    """`align` of two tables of `write_buckets`: a merge of bucket with bucket; no row of either moves."""
    return align(read_buckets(spark, x_path).hint("merge"), read_buckets(spark, y_path), key)


def write_matrix(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Model matrix with `split`, `features`, `label`, partitioned by split (A5).

    The checks run inside the write: a row with another feature count stops it, and an empty split is an error after it.
    """
    size = df.select(F.size("features").alias("n")).first()
    if size is None:
        raise ValueError("nothing to write")
    same = F.when(F.size("features") == size["n"], F.col("features")).otherwise(
        F.raise_error(F.lit("rows differ in feature count")).cast("array<double>"))
    out = df.withColumns({"features": same, "target": F.expm1("label")})
    out.write.mode(mode).partitionBy("split").parquet(path)
    found = {r["split"] for r in df.sparkSession.read.parquet(path).select("split").distinct().collect()}
    if not {"train", "test"} <= found:
        raise ValueError(f"a split is empty, found only {sorted(found)}")


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) by partition pruning (A4)."""
    df = spark.read.parquet(path)
    return df.filter(F.col("split") == "train").drop("split"), df.filter(F.col("split") == "test").drop("split")


def matrix_metadata(df: DataFrame) -> DataFrame:
    """Per split: rows, feature count, label range and mean on both scales, validity."""
    y = F.expm1("label")
    bad = F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.groupBy("split").agg(
        F.count("*").alias("n_rows"), F.max(F.size("features")).cast("long").alias("n_features"),
        F.min("label").alias("min_log"), F.max("label").alias("max_log"), F.avg("label").alias("mean_log"),
        F.min(y).alias("min_target"), F.max(y).alias("max_target"), F.avg(y).alias("mean_target"),
        (F.min(F.size("features")) == F.max(F.size("features"))).alias("same_length"), (F.count_if(bad) == 0).alias("all_finite"))


def model_state(train: DataFrame, model: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One row: weights, parameters and the training statistics scoring needs."""
    def stat(f, name: str):
        return F.array(*[f(F.col(c).cast("double")) for c in features]).alias(name)

    y = F.col(label).cast("double")
    stats = train.agg(stat(F.avg, "means"), stat(F.stddev_pop, "stds"), stat(F.min, "mins"), stat(F.max, "maxs"),
                      F.avg(y).alias("target_mean"), F.stddev_pop(y).alias("target_std"), F.min(y).alias("target_min"), F.max(y).alias("target_max"))
    names = stats.columns
    packed = stats.select(F.struct(*names)).scalar()
    return model.withColumn("s", packed).select(*model.columns, F.array(*[F.lit(c) for c in features]).alias("feature_names"),
                                                *[F.col("s")[n].alias(n) for n in names])


def save_state(state: DataFrame, path: str, mode: str = "errorifexists") -> None:
    state.coalesce(1).write.mode(mode).parquet(path)  # one row per model


def load_state(spark: SparkSession, path: str, run_name: str | None = None) -> dict:
    """One stored model as a plain dict, ready for `evaluate.score_table`."""
    df = spark.read.parquet(path)
    df = df.filter(F.col("run_id") == run_name) if run_name else df
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("expected exactly one model; pass run_name")
    return rows[0].asDict(recursive=True)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report table as JSON lines."""
    df.write.mode(mode).json(path)
