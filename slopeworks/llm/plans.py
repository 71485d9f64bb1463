"""Small helpers for plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fenced(column: Column) -> Column:
    """The same values, behind a call that Catalyst may not repeat: a later filter then reads the column and is not pushed
    below it with a second copy of the whole expression."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def broadcast_within(small: DataFrame, rows: int) -> tuple[DataFrame, bool]:
    """`small`, which must be stored or persisted, marked for broadcast if it has at most `rows` rows; and whether it has."""
    fits = small.count() <= rows
    return (F.broadcast(small) if fits else small), fits


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out
