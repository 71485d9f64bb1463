"""Exact join of documents whose sets of word shingles are alike, by vertical partitioning.

One global order of all shingles (rare ones by hash, then frequent ones by frequency) is cut into fragments.

1. Copies: documents of one set are one class, and the smallest doc_id stands for it from here on.
2. Prefix fragment: two similar sets share k shingles among the first n - ceil(0.75 n) + k of each, with k a twentieth of the
   smaller set and one more; sets that share fewer with all others together are done. Frequent shingles come last in the
   order, so common passages are seldom in a prefix. Any set of frequent shingles gives the same links; the count finds the
   set that saves most work.
3. Stars: every document is compared with one first member of its shingles' groups, the one it meets most often, in two
   rounds. The overlap of a pair is counted fragment by fragment, in separate rows, and summed per pair.
4. Groups whose members are one component already are done. Of the others, small ones compare the pairs across components.
   Large ones (frequent shingles) are gathered to families, cut into blocks, and blocks are compared with blocks; a task
   returns a spanning forest of the links it found and never the pairs.

So no link between two components is ever missed, and pairs are listed for bounded groups only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slopeworks.llm.components import connected_components
from slopeworks.llm.plans import broadcast_within, spare_names
from slopeworks.llm.shingles import WORDS, prefix_length, shingle_set
from slopeworks.llm.tasks import released
from slopeworks.session import shared_folder

PERCENT = 75
FREQUENT = 50  # documents of a shingle above which it goes to the end of the order
MOST_FREQUENT = 500_000  # shingles in that list; with more of them the limit above is raised
IDS_BROADCAST = 1_000_000
SAMPLED, HEAVY, MOST_HEAVY, SALTS = 64, 16, 500_000, 1024  # one document in so many shows which shingles need splitting, and how
FRAGMENTS = 4
STAR_ROUNDS = 2
BLOCK_SETS, BLOCK_SHINGLES = 256, 400_000
MIXED = -2**63  # stands for the labels of few members, which share blocks


def _sets_task(words: int, percent: int):
    """(id, n, sig, marks) of each document; a mark is the low half of a shingle's hash, for those in the prefix by hash."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                sizes, signs, marks = [], [], []
                for text in part.column(1).to_pylist():
                    s = shingle_set(text, words)
                    sizes.append(len(s))
                    signs.append(xxhash.xxh3_128_digest(s.tobytes()))
                    marks.append(s[:prefix_length(len(s), percent)].astype(np.uint32))
                lists = _lists(marks, np.uint32, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary()), lists], names=["id", "n", "sig", "marks"])
    return run


def _prefix_task(words: int, percent: int, frequent):
    """(id, n, prefix) of each document, in the global order that has the marks of `frequent` last."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        known, rank = frequent.value if frequent is not None else (np.empty(0, np.uint32), np.empty(0, np.int64))
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                sets = [shingle_set(text, words) for text in part.column(1).to_pylist()]
                lists = _lists([_first(s, prefix_length(len(s), percent), known, rank) for s in sets], np.uint64, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, sets), pa.int64()), lists], names=["id", "n", "prefix"])
    return run


def _lists(rows, kind, signed):
    import numpy as np
    import pyarrow as pa

    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, kind)
    return pa.ListArray.from_arrays(offsets, pa.array(flat.view(signed)))


def _first(s, size: int, known, rank):
    """The first `size` of a set in the global order: by hash, and the frequent ones by rank after all others."""
    import numpy as np

    if not len(known) or not len(s):
        return s[:size]
    marks = s.astype(np.uint32)
    at = np.minimum(np.searchsorted(known, marks), len(known) - 1)
    common = known[at] == marks
    if not common[:size].any():
        return s[:size]
    late = s[common]
    return np.concatenate([s[~common], late[np.argsort(rank[at[common]], kind="stable")]])[:size]


def _segments_task(words: int):
    """(id, fragment, n, segment): the set of a document cut at fixed points of the order of hashes."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        edges = np.array([(k << 64) // FRAGMENTS for k in range(1, FRAGMENTS)], np.uint64)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingle_set(text, words)
                cut = np.split(s, np.searchsorted(s, edges))
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * FRAGMENTS, pa.int64()), pa.array(range(FRAGMENTS), pa.int32()), pa.array([len(s)] * FRAGMENTS, pa.int64()), pa.array([c.view(np.int64) for c in cut], pa.list_(pa.int64()))], names=["id", "fragment", "n", "segment"])
    return run


SETS = "id long, n long, sig binary, marks array<int>"
PREFIXES = "id long, n long, prefix array<long>"
SEGMENTS = "id long, fragment int, n long, segment array<long>"


class _Job:
    def __init__(self, spark: SparkSession, percent: int, words: int):
        self.spark, self.percent, self.words, self.folder = spark, percent, words, shared_folder(spark)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def alike(self, overlap, a, b):
        return 100 * overlap >= self.percent * (a + b - overlap)

    def may_be(self, a, b):
        """Whether sets of these sizes can be alike at all."""
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)

    def frequent(self, sets: DataFrame):
        """Marks of frequent shingles and their place among each other, as a broadcast of bounded size; None if there are none.
        A mark stands for all shingles that have it, which changes the order and no result."""
        import numpy as np

        counts = self.store(sets.select(F.explode("marks").alias("t")).groupBy("t").count().filter(F.col("count") > FREQUENT), "frequent")
        steps = {r["s"]: r["count"] for r in counts.groupBy(F.floor(F.log2("count")).alias("s")).count().collect()}  # at most 64 rows
        least, total = 0, sum(steps.values())
        for s in sorted(steps):
            if total <= MOST_FREQUENT:
                break
            total -= steps[s]
            least = 2 ** (s + 1)
        if not total:
            return None
        found = counts.filter(F.col("count") >= least).toPandas()
        found = found.sort_values(["count", "t"])
        mark, rank = found["t"].to_numpy(np.int32).view(np.uint32), np.arange(len(found))
        order = np.argsort(mark)
        return self.spark.sparkContext.broadcast((mark[order], rank[order]))

    def verify(self, pairs: DataFrame, segments: DataFrame) -> DataFrame:
        """The pairs (a, b) whose overlap, counted by fragment and summed, is large enough."""
        left = segments.select(F.col("id").alias("a"), "fragment", F.col("n").alias("na"), F.col("segment").alias("sa"))
        right = segments.select(F.col("id").alias("b"), "fragment", F.col("n").alias("nb"), F.col("segment").alias("sb"))
        part = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("c"))
        summed = part.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
        return summed.filter(self.alike(F.col("c"), F.col("na"), F.col("nb"))).select("a", "b")

    def links(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(id, n, class) of all `docs` (id, text), with a class for those that have shingles; and links between classes."""
        text = docs.select("id", F.encode("text", "UTF-8").alias("text"))
        base = self.store(text.mapInArrow(released(_sets_task(self.words, self.percent)), SETS), "sets")
        thin = base.select("id", "n", "sig")
        # Stored, so that the join below has a shuffle of its own, which can split a signature of very many copies.
        firsts = self.store(thin.filter("n > 0").groupBy("sig").agg(F.min("id").alias("class")), "firsts")
        copies = self.store(thin.filter("n > 0").join(firsts.hint("merge"), "sig").select("id", "n", "class"), "classes")
        copied = copies.unionByName(thin.filter("n = 0").select("id", "n", F.lit(None).cast("long").alias("class")))
        others, _ = broadcast_within(copies.filter("id <> class").select("id"), IDS_BROADCAST)
        originals = text.join(others, "id", "left_anti")
        frequent = self.frequent(base.select("id", "marks").join(others, "id", "left_anti"))
        task = released(_prefix_task(self.words, self.percent, frequent))
        tokens = lambda of: of.filter("n > 0").select(F.explode("prefix").alias("t"), "id", "n")
        some = originals.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0)
        heavy = self.heavy(tokens(some.mapInArrow(task, PREFIXES)))
        shared = self.promising(tokens(originals.mapInArrow(task, PREFIXES)), heavy)
        involved, _ = broadcast_within(self.store(shared.select("id").distinct(), "involved"), IDS_BROADCAST)
        segments = self.store(originals.join(involved, "id", "left_semi").mapInArrow(released(_segments_task(self.words)), SEGMENTS), "segments")
        links, groups = None, shared.withColumn("label", F.col("id"))
        for k in range(STAR_ROUNDS):
            found = self.verify(self.star(groups, k), segments)
            # What is linked already goes on as one star a component, not as all its links.
            parts = connected_components(found if links is None else links.unionByName(found))
            links = parts.select(F.col("id").alias("a"), F.col("component").alias("b"))
            labelled = self.store(shared.join(parts.hint("merge"), "id", "left").select("t", "id", "n", "k", F.coalesce("component", "id").alias("label")), f"labelled{k}")
            mixed = self.store(labelled.groupBy("t").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("t"), f"mixed{k}")
            groups = self.store(labelled.join(mixed.hint("merge"), "t"), f"open{k}")
            if groups.isEmpty():
                return copied, links
        light = groups.filter(F.col("k") <= FREQUENT)
        x, y = (light.select("t", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "label")]) for s in "xy")
        across = x.join(y, "t").filter((F.col("id_x") < F.col("id_y")) & (F.col("label_x") != F.col("label_y")) & self.may_be(F.col("n_x"), F.col("n_y")))
        # A pair that shares a frequent shingle too is compared in the blocks; of others all shared ones are counted here.
        counted = across.groupBy(F.col("id_x").alias("a"), F.col("id_y").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.least(F.min("n_x"), F.min("n_y")).alias("least"))
        pairs = counted.filter(F.col("c") >= 1 + F.expr("least div 20")).select("a", "b")
        block_links = self.families(groups.filter(F.col("k") > FREQUENT), segments)
        return copied, links.unionByName(self.verify(pairs, segments)).unionByName(block_links)

    def heavy(self, sample: DataFrame) -> DataFrame:
        """Shingles that many documents of a sample have, as a list of bounded size. It says which groups to count in parts and
        changes no result."""
        counts = self.store(sample.groupBy("t").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > HEAVY), "sample")
        total = counts.agg(F.sum("k")).first()[0] or 0
        return F.broadcast(self.store(counts.filter(F.col("k") > total // MOST_HEAVY).select("t", F.lit(True).alias("heavy")), "heavy"))

    def promising(self, tokens: DataFrame, heavy: DataFrame) -> DataFrame:
        """(t, id, n, k): shingles of k > 1 documents, of documents that share enough of them with others to be alike to one at all."""
        salted = tokens.join(heavy, "t", "left").withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0))
        parts = Window.partitionBy("t", "salt")
        once = self.store(salted.withColumn("k", F.count(F.lit(1)).over(parts)).filter("heavy OR k > 1").drop("salt"), "once")
        whole = self.store(once.filter("heavy").groupBy("t").agg(F.count(F.lit(1)).alias("whole")), "whole")  # within the heavy list
        once = once.join(F.broadcast(whole), "t", "left").withColumn("k", F.coalesce("whole", "k")).filter("k > 1")
        enough = once.groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n")).filter(F.col("c") >= 1 + F.expr(f"cast(ceil({self.percent} * n / 100.0) as bigint) div 20"))
        likely = self.store(once.select("t", "id", "n").join(enough.select("id").hint("merge"), "id"), "likely")
        # Counts are summed in parts and stored, so that the join can split a shingle of very many documents.
        counts = self.store(likely.groupBy("t").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "counts")
        return self.store(likely.join(counts.hint("merge"), "t"), "shared")

    def star(self, groups: DataFrame, k: int) -> DataFrame:
        """(a, b): each document with the one among its groups' first members with which it shares most of its groups."""
        order = F.col("id") if k == 0 else F.xxhash64("id", F.lit(k))
        hubs = self.store(groups.groupBy("t").agg(F.min_by(F.struct("id", "n", "label"), order).alias("hub")), f"hubs{k}")
        near = groups.join(hubs.hint("merge"), "t").filter((F.col("label") != F.col("hub.label")) & self.may_be(F.col("n"), F.col("hub.n")))
        best = near.groupBy(F.col("id").alias("b"), F.col("hub.id").alias("a")).count().groupBy("b").agg(F.max(F.struct("count", F.col("a"))).alias("m"))
        return best.select(F.col("m.a").alias("a"), "b")

    def families(self, heavy: DataFrame, segments: DataFrame) -> DataFrame:
        """A spanning forest of the links across labels among members of groups of frequent shingles."""
        firsts = heavy.groupBy("t").agg(F.min("id").alias("b"))
        near = heavy.join(firsts, "t").select(F.col("id").alias("a"), "b")
        family = connected_components(near)
        members = heavy.select("id", "n", "label").distinct().join(family, "id").withColumnRenamed("component", "family")
        # Sets of one size class are alike only to sets of the same class or a neighbouring one.
        members = members.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(max(100 / self.percent, 1.01))) + 1e-9))
        sizes = members.groupBy("family", "size", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
        pure = (F.col("m") >= BLOCK_SETS // 2)
        kinds = sizes.withColumn("kind", F.when(pure, F.col("label")).otherwise(F.lit(MIXED)))
        totals = kinds.groupBy("family", "size", "kind").agg(F.sum("m").alias("m"), F.sum("s").alias("s"))
        totals = totals.withColumn("blocks", F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("s") / BLOCK_SHINGLES)))
        placed = members.join(kinds.select("family", "size", "label", "kind"), ["family", "size", "label"]).join(totals.select("family", "size", "kind", "blocks"), ["family", "size", "kind"])
        block = F.struct("size", "kind", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("part")).alias("block")
        placed = self.store(placed.select("family", block, "label", "id"), "placed")
        blocks = placed.select("family", "block").distinct()
        p, q = (blocks.select("family", F.col("block").alias(s)) for s in "pq")
        worth = (F.col("p") <= F.col("q")) & (F.col("q.size") - F.col("p.size") <= 1) & ((F.col("p.kind") != F.col("q.kind")) | (F.col("p.kind") == MIXED))
        tasks = p.join(q, "family").filter(worth)
        sides = tasks.select("family", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))
        work = sides.join(placed, ["family", "block"]).join(segments.select("id", "fragment", "segment"), "id")
        return work.groupBy("family", "p", "q").applyInArrow(_block_task(self.percent), "a long, b long")


def _block_task(percent: int):
    def run(table):
        import numpy as np
        import pyarrow as pa

        ids, first, place = np.unique(table.column("id").to_numpy(), return_index=True, return_inverse=True)
        labels = table.column("label").to_numpy()[first]
        fragment = table.column("fragment").to_numpy()
        overlap, sizes = np.zeros((len(ids), len(ids)), np.int32), np.zeros(len(ids), np.int64)
        for f in range(FRAGMENTS):  # the overlaps of each fragment apart, summed per pair
            rows = np.flatnonzero(fragment == f)
            lists = table.column("segment").take(pa.array(rows)).combine_chunks()
            tokens, lengths = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            np.add.at(sizes, place[rows], lengths)
            owner = np.repeat(place[rows], lengths)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.empty(0, int)
            ends = np.append(starts[1:], len(tokens))
            several = ends - starts > 1
            for s, e in zip(starts[several], ends[several]):
                who = owner[s:e]
                overlap[np.ix_(who, who)] += 1
        total = sizes[:, None] + sizes[None, :]
        alike = (100 * overlap.astype(np.int64) >= percent * (total - overlap)) & (labels[:, None] != labels[None, :])
        a, b = np.nonzero(np.triu(alike, 1))
        # One link for each merge of two components is enough.
        root = {int(x): int(x) for x in set(labels.tolist())}

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        kept = []
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = top(int(labels[i])), top(int(labels[j]))
            if x != y:
                root[x] = y
                kept.append((i, j))
        return pa.table({"a": ids[[i for i, _ in kept]].astype("int64") if kept else pa.array([], pa.int64()), "b": ids[[j for _, j in kept]].astype("int64") if kept else pa.array([], pa.int64())})
    return run


def _unique_ids(docs: DataFrame) -> bool:
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").isEmpty()


def _components(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """(id, n, component) of `docs` (id, text), whose ids are unique and not null."""
    rows, links = _Job(docs.sparkSession, percent, words).links(docs)
    parts = connected_components(links).withColumnRenamed("id", "class")
    return rows.join(parts, "class", "left").select("id", "n", F.coalesce("component", "class", "id").alias("component"))


def _rows_numbered(docs: DataFrame, name: str) -> DataFrame:
    """`docs`, stored with a number for each row, for tables where doc_id does not tell rows apart."""
    folder = shared_folder(docs.sparkSession)
    docs.withColumn(name, F.monotonically_increasing_id()).write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def shingle_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`.

    Null, empty and blank texts have no shingles and are linked with nothing. Where a doc_id is repeated, every row is a
    document of its own and linked by its text alone. A row with a null doc_id is linked with nothing and has a null
    component. Other columns are ignored. An empty table gives an empty result.
    """
    if _unique_ids(docs):
        found = _components(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), percent, words)
        return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    rows = _rows_numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "id")
    found = _components(rows.filter("doc_id IS NOT NULL").select("id", "text"), percent, words).join(rows.select("id", "doc_id"), "id")
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = found.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.filter("doc_id IS NULL").select("id", F.encode("text", "UTF-8").alias("text")).mapInArrow(released(_sets_task(words, percent)), SETS)
    return named.unionByName(alone.select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def drop_near_copies(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """`docs` with one row of each component: that of the smallest doc_id, null ones last. Rows without shingles all stay, and
    so do all columns. Rows of one doc_id go only where their texts are alike."""
    folder = shared_folder(docs.sparkSession)
    unique = _unique_ids(docs)
    row = "doc_id" if unique else spare_names(docs, "_row")[0]
    rows = docs if unique else _rows_numbered(docs, row)
    _components(rows.select(F.col(row).cast("long").alias("id"), "text"), percent, words).write.parquet(folder)
    found = docs.sparkSession.read.parquet(folder)
    if unique:
        others = found.filter("id <> component")
    else:
        named = found.join(rows.select(F.col(row).alias("id"), "doc_id"), "id")
        best = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id")).alias("best"))
        found.join(best.select(F.col("best.id").alias("id")), "id", "left_anti").write.parquet(f"{folder}-others")
        others = docs.sparkSession.read.parquet(f"{folder}-others")
    gone, _ = broadcast_within(others.select(F.col("id").alias(row)), IDS_BROADCAST)
    return rows.join(gone, row, "left_anti").select(*docs.columns)
