"""A reproducible shuffle into shards: a keyed permutation of global row numbers, so that place is computed and not sorted.

The permutation is a Feistel network on pairs (left, right) with left in [0, a) and right in [0, b), a * b >= n; rows that
land outside [0, n) walk on along their cycle until they are inside. Shard and slot of a row follow from its new number by
division, and shard sizes differ by one row at most. Only DataFrame functions are used.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopeworks.llm.plans import broadcast_within, spare_names

ROUNDS = 6
SEED = 20_240_611
FILES_BROADCAST = 100_000


def feistel(x: Column, n: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """The place of row number x, 0 <= x < n, under the permutation of [0, n) that `seed` fixes. A null stays null."""
    a = max(1, isqrt(n))
    b = -(-n // a)
    outside = a * b - n

    def once(v: Column) -> Column:
        right = v % b
        start = F.struct(F.call_function("div", v, F.lit(b)).alias("left"), right.alias("right"))

        def turn(s: Column, k: Column) -> Column:
            left, right = s["left"], s["right"]
            odd = k % 2 == 1
            return F.struct(
                F.when(odd, F.pmod(left + F.pmod(F.xxhash64(right, k, F.lit(seed)), F.lit(a)), F.lit(a))).otherwise(left).alias("left"),
                F.when(odd, right).otherwise(F.pmod(right + F.pmod(F.xxhash64(left, k, F.lit(seed)), F.lit(b)), F.lit(b))).alias("right"))

        return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(2 * ((rounds + 1) // 2)).cast("long")), start, turn, lambda s: s["left"] * b + s["right"])

    placed = once(x)
    if outside:
        # There are no more places outside than this, so a walk of as many steps has come back inside.
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(outside)), placed, lambda s, _: F.when(s < n, s).otherwise(once(s)))
        placed = F.when(placed < n, placed).otherwise(walked)
    return placed


def numbered(table: DataFrame, name: str = "row_number") -> DataFrame:
    """Adds global row numbers from 0 to a table just read from Parquet: rows of the files before it plus its row in the file.

    They depend on the stored table alone, not on how Spark splits it, and no rows move. The window sees one row for each file.
    """
    file, row, first = spare_names(table, "_file", "_row", "_first")
    parts = table.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    counts = table.select(F.col("_metadata.file_path").alias(file)).groupBy(file).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    firsts, _ = broadcast_within(counts.select(file, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first)).persist(), FILES_BROADCAST)
    return parts.join(firsts, file).withColumn(name, F.col(first) + F.col(row)).drop(file, row, first)


def shard_rows(table: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """Adds `shard` and `slot` to every row of a table just read from Parquet; slots of a shard run from 0 without a gap.

    Nulls, repeated rows and texts of any length are rows like others. An empty table stays empty. Columns `shard` and `slot`
    of the input are replaced.
    """
    n = table.count()
    number, place = spare_names(table, "_number", "_place")
    rows = numbered(table.drop("shard", "slot"), number).withColumn(place, feistel(F.col(number), max(n, 1), seed))
    return rows.withColumns({"shard": (F.col(place) % shards).cast("int"), "slot": F.call_function("div", F.col(place), F.lit(shards))}).drop(number, place)


def row_of(shard: int, slot: int, n: int, shards: int = 16) -> int:
    """The new number of the row at a place, for readers that compute where a row lies; -1 if there is none."""
    place = slot * shards + shard
    return place if 0 <= place < n and 0 <= shard < shards else -1
