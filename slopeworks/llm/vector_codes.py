"""Product codes of vectors, with codebooks trained by Lloyd's rounds over cover trees.

Vectors become integers and are cut into four parts. A task gathers bounded blocks of vectors and builds a cover tree for each
block and part once; the blocks are stored. A node of a tree is a point, the points near it, and the range they have in the
block's order, so that running sums give the sum of a whole subtree. In a round, a node whose point is nearer to one entry than
to any other by more than twice the node's radius gives that entry all its points at once, by the triangle inequality; only
the other nodes are opened, down to single points, which are compared exactly. Sums by entry go through Spark; a codebook has
a fixed size.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.llm.plans import broadcast_within
from slopeworks.llm.tasks import released
from slopeworks.session import shared_folder

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
MOST = 2**24  # of a component's size: larger ones count as this, so that squares stay exact
BLOCK = 2048
LEAF = 16  # points that are compared one by one
LABELS_BROADCAST = 1_000_000

BLOCKS = "ids binary, labels binary, null_ids binary, null_labels binary, points binary, n int, trees array<struct<order: binary, nodes: binary, radius: binary>>"


def integers(vectors, width: int):
    """floor(1024 x) of a list of vectors, as rows of `width` components filled with zeros."""
    import numpy as np

    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, :len(v)] = np.clip(np.floor(SCALE * np.asarray(v, np.float64)), -MOST, MOST)
    return out


def distances(points, entries):
    """Squared distances of integer points and entries; exact in 64-bit floats while they are below 2^53, else in integers."""
    import numpy as np

    size = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * points.shape[1] * size * size < 2**53:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return (p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)[None, :]
    return np.stack([((points - e) ** 2).sum(1) for e in entries], 1)


def cover_tree(points):
    """(order, nodes, radius): `order` puts the points of every subtree side by side; a node is (from, to, first child, end of
    the children, centre), places in that order, and its radius is the distance of its farthest point.

    The children of a node are a net: centres of half the node's reach cover all its points, and no centre lies within that
    of an earlier one. The node's own point is the first of them. A node of few points, or of equal ones, has no children.
    """
    import numpy as np

    n = len(points)
    between = np.sqrt(np.maximum(distances(points, points), 0).astype(np.float64))
    order = np.arange(n)
    nodes, radius = [[0, n, 0, 0, 0]], [float(between[0].max(initial=0.0))]
    open_nodes = [0]
    while open_nodes:
        k = open_nodes.pop()
        start, end = nodes[k][:2]
        if end - start <= LEAF or radius[k] == 0:
            continue
        mine, reach = order[start:end].copy(), radius[k] / 2
        nodes[k][2] = len(nodes)
        at, left = start, mine
        while len(left):
            # The first of what is left is a centre; the node's own point comes first of all.
            far = between[left[0], left]
            near = far <= reach
            took = int(near.sum())
            order[at:at + took] = left[near]
            nodes.append([at, at + took, 0, 0, at])
            radius.append(float(far[near].max()))
            open_nodes.append(len(nodes) - 1)
            at, left = at + took, left[~near]
        nodes[k][3] = len(nodes)
    return order, np.array(nodes, np.int64).reshape(-1, 5), np.array(radius)


def assign(points, nodes, radius, entries):
    """The nearest entry of each point (lowest of equals), points in tree order; and how many points were compared one by one."""
    import numpy as np

    found = np.full(len(points), -1, np.int64)
    live = np.array([0]) if len(points) else np.empty(0, np.int64)
    single = []
    while len(live):
        here = distances(points[nodes[live, 4]], entries)
        best = here.argmin(1)
        if len(entries) > 1:
            first = np.sqrt(here[np.arange(len(live)), best].astype(np.float64))
            here = here.astype(np.float64)
            here[np.arange(len(live)), best] = np.inf
            margin = np.sqrt(here.min(1)) - first
            # A little more than twice the radius: the roots are rounded.
            sure = (margin > 2 * radius[live] * (1 + 1e-9) + 1e-9 * (1 + first)) | (radius[live] == 0)
        else:
            sure = np.ones(len(live), bool)
        for k, e in zip(live[sure], best[sure]):
            found[nodes[k, 0]:nodes[k, 1]] = e
        rest = live[~sure]
        leaf = nodes[rest, 3] == 0
        single += [np.arange(nodes[k, 0], nodes[k, 1]) for k in rest[leaf]]
        live = np.concatenate([np.arange(nodes[k, 2], nodes[k, 3]) for k in rest[~leaf]]) if (~leaf).any() else np.empty(0, np.int64)
    at = np.concatenate(single) if single else np.empty(0, np.int64)
    if len(at):
        found[at] = distances(points[at], entries).argmin(1)
    return found, len(at)


def subtree_sums(points, found, entries: int):
    """(count, sum) by entry, from running sums over the runs of points that share an entry in tree order."""
    import numpy as np

    running = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, 0)])
    cuts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1], [True]]))
    counts, sums = np.zeros(entries, np.int64), np.zeros((entries, points.shape[1]), np.int64)
    np.add.at(counts, found[cuts[:-1]], np.diff(cuts))
    np.add.at(sums, found[cuts[:-1]], running[cuts[1:]] - running[cuts[:-1]])
    return counts, sums


def _blocks_task(width: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        part = width // PARTS
        ids, labels, held, n = [], [], [], 0

        def block():
            points = np.concatenate(held)[:BLOCK]
            who, what = (pa.concat_arrays(x).slice(0, BLOCK) for x in (ids, labels))
            trees = []
            for k in range(PARTS):
                order, nodes, radius = cover_tree(points[:, k * part:(k + 1) * part])
                trees.append({"order": order.astype("<i4").tobytes(), "nodes": nodes.astype("<i4").tobytes(), "radius": radius.astype("<f8").tobytes()})
            plain = lambda x: np.asarray(x.fill_null(0)).astype("<i8").tobytes()
            null = lambda x: np.packbits(np.asarray(x.is_null())).tobytes()
            row = {"ids": plain(who), "labels": plain(what), "null_ids": null(who), "null_labels": null(what), "points": points.astype("<i4").tobytes(), "n": len(points), "trees": trees}
            return pa.RecordBatch.from_pylist([row], schema)

        tree = pa.struct([("order", pa.binary()), ("nodes", pa.binary()), ("radius", pa.binary())])
        schema = pa.schema([*[(c, pa.binary()) for c in ("ids", "labels", "null_ids", "null_labels", "points")], ("n", pa.int32()), ("trees", pa.list_(tree))])
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                some = batch.slice(start, BLOCK)
                ids.append(some.column(0))
                labels.append(some.column(1))
                held.append(integers(some.column(2).to_pylist(), width))
                n += some.num_rows
                if n >= BLOCK:
                    yield block()
                    ids, labels, held = [pa.concat_arrays(ids).slice(BLOCK)], [pa.concat_arrays(labels).slice(BLOCK)], [np.concatenate(held)[BLOCK:]]
                    n -= BLOCK
        if n:
            yield block()
    return run


def _opened(row: dict, width: int):
    """(order, points, nodes, radius) of each part of a stored block."""
    import numpy as np

    part = width // PARTS
    points = np.frombuffer(row["points"], "<i4").reshape(row["n"], width).astype(np.int64)
    for k, t in enumerate(row["trees"]):
        order = np.frombuffer(t["order"], "<i4")
        yield order, points[order, k * part:(k + 1) * part], np.frombuffer(t["nodes"], "<i4").reshape(-1, 5), np.frombuffer(t["radius"], "<f8")


def _round_task(books, width: int):
    """(part, entry, n, sums) over all blocks of a task."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        codebooks = books.value
        counts = np.zeros((PARTS, codebooks.shape[1]), np.int64)
        sums = np.zeros(codebooks.shape, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                for p, (_, points, nodes, radius) in enumerate(_opened(batch.slice(k, 1).to_pylist()[0], width)):
                    c, s = subtree_sums(points, assign(points, nodes, radius, codebooks[p])[0], codebooks.shape[1])
                    counts[p] += c
                    sums[p] += s
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(counts[p, e], pa.int64()),
                                          "sums": pa.array(list(sums[p, e]), pa.list_(pa.int64()))})
    return run


def _codes_task(books, width: int):
    """(vec_id, label, code, error) of each vector."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        codebooks = books.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                codes, error = np.empty((row["n"], PARTS), np.uint8), np.zeros(row["n"], np.int64)
                for p, (order, points, nodes, radius) in enumerate(_opened(row, width)):
                    found, _ = assign(points, nodes, radius, codebooks[p])
                    codes[order, p] = found
                    error[order] += ((points - codebooks[p][found]) ** 2).sum(1)
                null = lambda c: np.unpackbits(np.frombuffer(row[c], np.uint8))[:row["n"]].astype(bool)  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({
                    "vec_id": pa.array(np.frombuffer(row["ids"], "<i8"), pa.int64(), mask=null("null_ids")), "label": pa.array(np.frombuffer(row["labels"], "<i8"), pa.int64(), mask=null("null_labels")),
                    "code": pa.array([c.tobytes().hex() for c in codes]), "error": pa.array(error)})
    return run


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every row of `vectors` (vec_id, embedding, label) that can be coded.

    Rows whose vector is null or holds nulls, NaN or infinities are left out. Vectors shorter than the longest one, or than a
    multiple of four, are filled with zeros; components beyond 16,384 count as that. Repeated vec_ids are rows of their own,
    a null vec_id comes after all others, null labels are one label. Other columns are ignored. An empty table gives no row.
    """
    import numpy as np

    spark = vectors.sparkSession
    folder = shared_folder(spark)

    def store(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter(F.col("embedding").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    longest = kept.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    width = max(PARTS, -(-longest // PARTS) * PARTS)
    # Written by Spark's own top-k, so that the driver reads no more than the entries themselves.
    firsts = store(kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).select("vec_id", "embedding"), "firsts")
    start = integers([r["embedding"] for r in firsts.orderBy(F.asc_nulls_last("vec_id"), "embedding").collect()], width)
    books = start.reshape(len(start), PARTS, width // PARTS).transpose(1, 0, 2).copy()
    blocks = store(kept.select("vec_id", "label", "embedding").mapInArrow(released(_blocks_task(width)), BLOCKS), "blocks")
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(books)
        partial = blocks.mapInArrow(released(_round_task(shared, width)), "part int, entry int, n long, sums array<long>")
        cells = partial.select("part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        means = cells.select("part", "entry", "at", F.call_function("div", F.col("s") - F.pmod("s", "n"), F.col("n")).alias("mean")).toPandas()  # as many cells as the codebooks have
        books = books.copy()
        books[means["part"], means["entry"], means["at"]] = means["mean"].to_numpy(np.int64)
        shared.unpersist()
    digest = sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    coded = store(blocks.mapInArrow(released(_codes_task(spark.sparkContext.broadcast(books), width)), "vec_id long, label long, code string, error long"), "codes")
    sums, _ = broadcast_within(store(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels"), LABELS_BROADCAST)
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """Plain Lloyd rounds: every part is compared with every entry."""
    near = """SELECT vec_id, part, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist FROM (
  SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM parts p JOIN {book} b USING (part)) GROUP BY ALL"""
    rounds = []
    for k in range(ROUNDS):
        rounds.append(f"near{k} AS MATERIALIZED ({near.format(book=f'book{k}')})")
        rounds.append(f"""cell{k} AS (SELECT part, entry, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS x FROM near{k} JOIN parts USING (vec_id, part), (SELECT unnest(range(1, {{width}} + 1)) AS i) GROUP BY ALL),
book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN (SELECT part, entry, list(x ORDER BY i) AS v FROM cell{k} GROUP BY ALL) m USING (part, entry))""")
    body = ",\n".join(rounds).replace("{width}", "(SELECT max(len(v)) FROM parts)")
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS v FROM kept, (SELECT unnest(range({PARTS})) AS part)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {ENTRIES}),
book0 AS MATERIALIZED (SELECT part, entry, v FROM parts JOIN firsts USING (vec_id)),
{body},
last AS MATERIALIZED ({near.format(book=f'book{ROUNDS}')}),
codes AS (SELECT vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM last GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN kept USING (vec_id), digest
"""


ORACLE = _sql()
