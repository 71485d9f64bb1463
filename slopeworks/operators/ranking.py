"""Row numbers, lags and running minima that do not gather a whole table or a hot group in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopeworks.operators.joins import lookup_join

HASH_SPACE = 2**32
CHUNK_ROWS = 1_000_000
HIGH_BITS = 20
MAX_BUCKETS = 2**20  # offsets of this many ranges are broadcast: 16 MB


def key_hash(key: str, seed: int = 42) -> Column:
    """Seeded hash of a row key in [0, 2^32)."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(HASH_SPACE))


def multiplicative_hash(key: str, seed: int = 0) -> Column:
    """Portable hash of an integer key: any SQL engine can compute it (fixed value: Knuth's 2654435761)."""
    return F.pmod(F.pmod(F.col(key) + F.lit(seed), F.lit(2**31)) * F.lit(2654435761), F.lit(HASH_SPACE))


def smallest_by_hash(df: DataFrame, key: str, hashed: Column, take: int) -> Column:
    """Condition that holds for exactly the `take` rows with the smallest (hash, key).

    Two small jobs over the key column find the threshold: counts per high-bit bucket, then the rank inside the
    one bucket on the border. The table itself is not sorted or shuffled. Keys must be unique.
    """
    if take <= 0:
        return F.lit(False)
    keyed = df.select(F.col(key), hashed.alias("h"))
    shift = 32 - HIGH_BITS
    counts = keyed.groupBy(F.shiftright("h", shift).alias("b")).agg(F.count("*").alias("n"))  # at most 2^20 rows
    running = counts.withColumn("end", F.sum("n").over(Window.orderBy("b")))
    border = running.filter(F.col("end") >= take).orderBy("b").select("b", (F.col("end") - F.col("n")).alias("start")).first()
    if border is None:
        return F.lit(True)
    inside = keyed.filter(F.shiftright("h", shift) == border["b"]).orderBy("h", key)
    last = inside.offset(take - border["start"] - 1).first()
    return (hashed < last["h"]) | ((hashed == last["h"]) & (F.col(key) <= F.lit(last[key])))


def hash_row_number(df: DataFrame, key: str, hashed: Column, name: str = "rank", n_rows: int | None = None) -> DataFrame:
    """0-based position of every row in (hash, key) order, ranked inside hash ranges and offset by their sizes."""
    n_rows = df.count() if n_rows is None else n_rows
    buckets = min(MAX_BUCKETS, max(1, n_rows // 100_000))
    h = df.withColumns({"__h": hashed, "__b": F.floor(hashed * buckets / HASH_SPACE).cast("int")})
    local = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key)) - 1
    sizes = h.groupBy("__b").agg(F.count("*").alias("n"))  # at most MAX_BUCKETS rows
    offsets = sizes.select("__b", (F.sum("n").over(Window.orderBy("__b")) - F.col("n")).alias("__o"))
    out = h.withColumn("__r", local).join(F.broadcast(offsets), "__b")
    return out.withColumn(name, F.col("__r") + F.col("__o")).drop("__b", "__h", "__r", "__o")


def _largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _chunked(df: DataFrame, keys: list[str], order: str, chunk_rows: int) -> tuple[DataFrame, Callable[[], None]]:
    """Adds the group as text (`__g`, nulls are a value), the exact rank of a row in it (`__rank`) and a chunk of `chunk_rows` rows.

    Ranks come from range partitions of (group, order), so neither a hot group nor an outlying order value fills one task.
    Their number follows the rows alone: short chunks share a range. Null orders come first. The second value releases
    what is kept.
    """
    spark = df.sparkSession
    group = F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]), {"ignoreNullFields": "false"})
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // CHUNK_ROWS))
    cut = df.withColumn("__g", group).repartitionByRange(parts, "__g", order).withColumn("__b", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = cut.groupBy("__g", "__b").agg(F.count("*").alias("__m"))
    before = F.sum("__m").over(Window.partitionBy("__g").orderBy("__b")) - F.col("__m")
    offsets = sizes.withColumn("__o", before)
    local = F.row_number().over(Window.partitionBy("__g", "__b").orderBy(order)) - 1
    ranked = lookup_join(cut.withColumn("__r", local), offsets, ["__g", "__b"], "inner", weight="__m")
    ranked = ranked.withColumn("__rank", F.col("__r") + F.col("__o")).drop("__b", "__m", "__o", "__r")
    return ranked.withColumn("__chunk", F.floor(F.col("__rank") / chunk_rows).cast("long")), cut.unpersist


def with_lags(df: DataFrame, keys: Sequence[str], order: str, lags: dict[str, tuple[str, int]],
              chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds `name = lag(column, k)` for each `name: (column, k)`, per group in `order`.

    Groups within `chunk_rows` use a plain window. A larger group is cut into chunks by exact rank, and the last
    rows of a chunk are copied to the next one so that no lag looks past its own chunk. `order` is numeric and
    unique in its group.
    """
    keys = list(keys)
    if _largest_group(df, keys) <= chunk_rows:
        w = Window.partitionBy(*keys).orderBy(order)
        return df.withColumns({n: F.lag(c, k).over(w) for n, (c, k) in lags.items()})
    reach = max(k for _, k in lags.values())
    if reach > chunk_rows:
        raise ValueError("chunk_rows must be at least the largest lag")
    ranked, _ = _chunked(df, keys, order, chunk_rows)
    ranked = ranked.withColumn("__halo", F.lit(False))
    tail = ranked.filter(F.col("__rank") % chunk_rows >= chunk_rows - reach)
    both = ranked.unionByName(tail.withColumns({"__chunk": F.col("__chunk") + 1, "__halo": F.lit(True)}))
    w = Window.partitionBy("__g", "__chunk").orderBy("__rank")
    out = both.withColumns({n: F.lag(c, k).over(w) for n, (c, k) in lags.items()})
    return out.filter(~F.col("__halo")).drop("__halo", "__chunk", "__rank", "__g")


def with_running_min(df: DataFrame, keys: Sequence[str], order: str, column: str, name: str = "running_min",
                     previous: str | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds the running minimum of a column per group, and with `previous` the minimum before the row."""
    keys = list(keys)
    if _largest_group(df, keys) <= chunk_rows:
        w = Window.partitionBy(*keys).orderBy(order)
        out = df.withColumn(name, F.min(column).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        if previous:
            out = out.withColumn(previous, F.min(column).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        return out
    ranked, _ = _chunked(df, keys, order, chunk_rows)
    mins = ranked.groupBy("__g", "__chunk").agg(F.min(column).alias("__m"), F.count("*").alias("__n"))
    over_chunks = Window.partitionBy("__g").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = mins.select("__g", "__chunk", "__n", F.min("__m").over(over_chunks).alias("__before"))
    joined = lookup_join(ranked, carried, ["__g", "__chunk"], "inner", weight="__n")
    w = Window.partitionBy("__g", "__chunk").orderBy("__rank")
    here = F.min(column).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = joined.withColumn(name, F.least(F.col("__before"), here))
    if previous:
        before = F.min(column).over(w.rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn(previous, F.least(F.col("__before"), before))
    return out.drop("__chunk", "__rank", "__n", "__before", "__g")
