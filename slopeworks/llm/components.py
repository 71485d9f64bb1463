"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.llm.tasks import released
from slopeworks.session import shared_folder

LINKS_A_TASK = 2**20


def _forest(batches):
    """(id, component) of the links of one task: each id with the smallest one it reaches inside the task."""
    import numpy as np
    import pyarrow as pa

    sides = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not sides:
        return
    a, b = (np.concatenate(x) for x in zip(*sides))
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[:len(a)], place[len(a):]
    least = np.arange(len(ids))
    while True:
        # Roots take the smallest root they touch, then all ids follow their pointers to the end.
        x, y = least[a], least[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least[least] != least).any():
            least = least[least]
    yield pa.RecordBatch.from_pydict({"id": ids, "component": ids[least]})


def connected_components(edges: DataFrame, links_a_task: int = LINKS_A_TASK) -> DataFrame:
    """(id, component) for every id of `edges` (a long, b long); component is the smallest id that is reachable.

    A task solves up to `links_a_task` links at once and hands on stars: each id with the smallest one it reached there. When
    more links are left than one task takes, large-star and small-star steps turn the stars of all tasks into those of the
    whole: every id is tied to the smallest neighbour of its larger, then of its smaller neighbours, until nothing changes.
    Tables go to the shared folder; nothing is collected. Links of an id with itself keep it; null ends are no links.
    """
    spark = edges.sparkSession
    folder = shared_folder(spark)

    def store(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    links = store(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL"), "links")
    n = links.count()
    tasks = -(-n // links_a_task)
    dealt = links.coalesce(1) if tasks <= 1 else links.repartition(tasks, F.least("a", "b"))
    stars = store(dealt.mapInArrow(released(_forest), "id long, component long"), "stars")
    if tasks <= 1:
        return stars
    now = stars.select(F.col("id").alias("a"), F.col("component").alias("b")).filter("a <> b")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before, k = mark(now), 0
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Stored, so that the join has shuffles of its own and Spark can split an id of very many links.
        least = store(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), f"large{k}")
        large = store(both.join(least.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), f"linked{k}")
        least = store(large.groupBy("a").agg(F.min("b").alias("m")), f"small{k}")
        tied = large.join(least.hint("merge"), "a")
        ends = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        now = store(tied.select(ends).select("e.*").filter("a <> b").distinct(), f"tied{k}")
        after = mark(now)
        if after == before:
            break
        before, k = after, k + 1
    found = stars.select("id").union(stars.select("component")).distinct().join(now.select(F.col("a").alias("id"), F.col("b").alias("m")).hint("merge"), "id", "left")
    return found.select("id", F.coalesce("m", "id").alias("component"))
