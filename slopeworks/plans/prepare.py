"""The preparation job: clean, impute, engineer, split, encode, scale into a model matrix (B, H, I; Entry 1).

The chain is lazy. Small fitted facts (null shares, cardinalities, means) are read by aggregates of one row per
column; encoders, medians and scalers are fitted on the training rows only.

The rows that several fits read are kept on disk alone: the cleaned ones as a table in the shared folder, of which a fit reads
the columns it needs, and the coded ones on the executors. So the memory of an executor does not follow the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.functions import constants as K
from slopeworks.functions.text import clean_text_columns, parse_units
from slopeworks.operators.clean import clean_listings, final_types, listing_projection
from slopeworks.operators.encode import fit_encoding
from slopeworks.operators.features import add_features
from slopeworks.operators.impute import fit_smart, impute
from slopeworks.operators.profile import column_facts, numeric_columns
from slopeworks.operators.quantiles import quantile_values
from slopeworks.operators.scale import fit_scaler, log_target
from slopeworks.operators.split import split_exact
from slopeworks.session import shared_folder
from slopeworks.sources.tables import assemble

# A stream to or from a held partition keeps up to 100 batches (spark.serializer.objectStreamReset) until it lets them go.
HELD_BATCH_ROWS = 1000


@dataclass
class Prepared:
    matrix: DataFrame  # row_id, split, features, label
    features: list[str]
    kept: DataFrame  # coded rows held on the executors while the plan is fitted and read

    def release(self) -> None:
        """Frees the held rows once the matrix is written."""
        self.kept.unpersist()


def prepare_listings(raw: DataFrame, as_of: int, target: str = "price", test_size: float = 0.2, seed: int = 42,
                     scaler: str = "standard", max_categories: int = 50, group_cols: Sequence[str] = ("make_name", "model_name")) -> Prepared:
    """Model matrix from raw listings. `row_id` is a 128-bit hash of the row, so it does not depend on file or task order."""
    chosen = listing_projection(raw)
    distinct = clean_listings(chosen, as_of, target)
    # Of the values before cleaning: rows that differ only by case or blanks keep ids of their own.
    identity = F.md5(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in distinct.columns]), {"ignoreNullFields": "false"}))
    cleaned = clean_text_columns(distinct.withColumn("row_id", identity), skip=["row_id"])
    parsed = _stored(parse_units(cleaned).drop("power", "torque"), f"{shared_folder(raw.sparkSession)}/cleaned")
    parted = split_exact(parsed, "row_id", test_size, seed)
    plain = ["row_id", "split", target]

    def train(df: DataFrame) -> DataFrame:
        return df.filter(F.col("split") == "train")

    filled = fit_smart(train(parted).drop("row_id", "split"), group_cols, skip=[target], reuse=False).transform(parted)
    rich = add_features(filled, as_of)
    encoder = fit_encoding(train(rich).drop("row_id", "split", "performance_category"), target, max_categories=max_categories)
    # The fits below and the matrix read the coded rows; a lost part is computed again from the cleaned ones.
    coded = _held(encoder.transform(rich))
    coded.count()
    typed = final_types(coded, plain, {"performance_category": K.PERFORMANCE_LABELS})
    features = [c for c in numeric_columns(typed) if c not in plain]
    doubled = typed.withColumns({c: F.col(c).cast("double") for c in features})
    whole = _fill_from_train(doubled, train(doubled), features)
    scaled = fit_scaler(train(whole), features, scaler).transform(whole)
    labelled = log_target(scaled.filter(F.col(target).isNotNull()), target)
    return Prepared(assemble(labelled, features, "label", ["row_id", "split"]), features, coded)


def _stored(df: DataFrame, path: str) -> DataFrame:
    """The rows as a Parquet table. A column without a type, which has no values, becomes text."""
    df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "void"}).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _held(df: DataFrame) -> DataFrame:
    """The rows on the disks of the executors, in short batches; the plan of a held frame takes its settings when it is marked."""
    conf, setting = df.sparkSession.conf, "spark.sql.inMemoryColumnarStorage.batchSize"
    before = conf.get(setting, None)
    conf.set(setting, HELD_BATCH_ROWS)
    try:
        return df.persist(StorageLevel.DISK_ONLY)
    finally:
        conf.unset(setting) if before is None else conf.set(setting, before)


def _fill_from_train(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Leftover nulls get the median of the training rows."""
    nulls = column_facts(df, {c: [F.count_if(F.col(c).isNull()).alias(c)] for c in columns})
    open_cols = [c for c in columns if nulls[c]]
    if not open_cols:
        return df
    medians = quantile_values(train, {c: (c, 0.5) for c in open_cols})
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0 if medians[c] is None else medians[c])) for c in open_cols})


def quick_prepare(df: DataFrame, target: str, strategy: str = "auto", columns: Sequence[str] | None = None) -> DataFrame:
    """Impute and keep numeric columns only: the short path for tables that are already numeric."""
    filled = impute(df.select(*columns, target) if columns else df, strategy)
    return filled.select(*[c for c in numeric_columns(filled)])
