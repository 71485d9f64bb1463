"""String functions: cleaning, unit parsing, safe conversion, name normalising."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slopeworks.functions import constants as K


def clean_text(c: Column) -> Column:
    """Lower-case, collapse white space, trim; an empty text becomes null (H1)."""
    squeezed = F.regexp_replace(F.lower(c), r"\s+", " ")
    return F.nullif(F.trim(squeezed), F.lit(""))


def clean_text_columns(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]
    return df.withColumns({n: clean_text(F.col(n)) for n in names}) if names else df


def to_number(c: Column) -> Column:
    """Number or null, never an error (H4)."""
    return c.try_cast("double")


def extract_number(c: Column, pattern: str = K.FIRST_NUMBER) -> Column:
    """First match of a one-group number pattern, thousands commas removed (H2, H3)."""
    plain = F.when(F.contains(c, F.lit(",")), F.regexp_replace(c, r"(?<=\d),(?=\d)", "")).otherwise(c)
    return to_number(F.nullif(F.regexp_extract(plain, pattern, 1), F.lit("")))


def parse_units(df: DataFrame) -> DataFrame:
    """Numbers out of unit strings; power and torque give a value and an rpm column (H2, H3)."""
    strings = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    out = {n: extract_number(F.col(n)) for n in K.UNIT_COLUMNS if n in strings}
    if "power" in strings:
        out["power_hp"] = extract_number(F.col("power"), K.HORSEPOWER)
        out["power_rpm"] = extract_number(F.col("power"), K.AT_RPM)
    if "torque" in strings:
        out["torque_value"] = extract_number(F.col("torque"), K.LEADING_INTEGER)
        out["torque_rpm"] = extract_number(F.col("torque"), K.AT_RPM)
    return df.withColumns(out) if out else df


def joined_key(*cols: Column) -> Column:
    """`a_b`, with 'unknown' in the place of a null part (H5)."""
    return F.concat_ws("_", *[F.coalesce(c, F.lit("unknown")) for c in cols])


def head_of(c: Column, separator: str = " - ") -> Column:
    """Text before the first separator."""
    return F.split_part(c, F.lit(separator), F.lit(1))


def normal_name(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def normalise_columns(df: DataFrame) -> DataFrame:
    """Lower-case snake names; two columns that would share a name are an error (A2)."""
    names = [normal_name(n) for n in df.columns]
    clash = sorted(n for n, k in Counter(names).items() if k > 1)
    if clash:
        raise ValueError(f"column names collide after normalising: {clash}")
    return df.toDF(*names)
