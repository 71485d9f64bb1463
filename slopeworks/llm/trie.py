"""The trie of conversation prefixes, built by union-find over the common prefixes of sorted neighbours.

1. Turns become 16-byte hashes; a conversation is the string of its turns' hashes, and equal ones are one sequence.
2. The sequences are dealt into ranges of their sorted order. A task sorts one range; neighbours with d turns in common are an
   edge of depth d. Edges are taken from the deepest to the shallowest, and every merge of two components meets in a node at
   the edge's depth. The turns between one merge and the next are nodes of one child.
3. A node that reaches over the edge of its range is open. Only open nodes, a path to the root at either end of a range, leave
   the task unfinished; their counts add up across ranges, since the common prefix with the next range tells which range owns
   a node that several have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopeworks.session import shared_folder

FAMILY = 20  # conversations that share the first turns of one
MOST_SHARED = 4
TURNS_IN_RANGE = 200_000
IDS_IN_PIECE = 4096
HASH = 16
ROOT = bytes(HASH)

NODES = ("pid int, depth long, id binary, parent binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "spent long, owned long, ends string, open boolean")


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, hashes, words) of each conversation in the order of its turns, null first, equal turns by hash."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    hashed = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), hashed.alias("hash"), n_words(text).alias("words"))
    lists = conversations.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return lists.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turns.hash").alias("hashes"), F.col("turns.words").alias("words"))


def with_shared_starts(lists: DataFrame) -> DataFrame:
    """Each conversation with its first turns replaced by as many of the first of its family, as a hash of its number tells."""
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    own = lists.withColumns({"first": F.col("conv_id") - F.col("conv_id") % FAMILY, "shared": shared.cast("int")})
    starts = lists.filter(F.col("conv_id") % FAMILY == 0)
    starts = starts.select(F.col("conv_id").alias("first"), *[F.slice(c, 1, MOST_SHARED).alias(f"start_{c}") for c in ("hashes", "words")])

    def rebuilt(c: str, kind: str) -> Column:
        start = F.slice(F.coalesce(f"start_{c}", F.array().cast(kind)), F.lit(1), F.col("shared"))
        return F.concat(start, F.slice(c, F.col("shared") + 1, F.greatest(F.size(c) - F.col("shared"), F.lit(0)))).alias(c)

    return own.join(starts, "first", "left").select("conv_id", rebuilt("hashes", "array<string>"), rebuilt("words", "array<int>"))


def _pieces(batches):
    """(sig, first, ids): the numbers of a sequence's conversations as text, in pieces; rows come sorted."""
    import pyarrow as pa

    sig, ids = None, []

    def piece():
        return pa.RecordBatch.from_pydict({"sig": pa.array([sig], pa.binary()), "first": pa.array([ids[0]], pa.int64()), "ids": pa.array([",".join(map(str, ids))])})

    for batch in batches:
        for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (s != sig or len(ids) == IDS_IN_PIECE):
                yield piece()
                ids = []
            sig = s
            ids.append(c)
    if ids:
        yield piece()


def _digests(batches):
    """(sig, ends): the SHA-256 of the pieces of each sequence, joined by commas; rows come sorted and are not kept."""
    from hashlib import sha256

    import pyarrow as pa

    sig, state = None, None
    for batch in batches:
        sigs, ends = [], []
        for s, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if s != sig:
                if state is not None:
                    sigs.append(sig)
                    ends.append(state.hexdigest())
                sig, state = s, sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        yield pa.RecordBatch.from_pydict({"sig": pa.array(sigs, pa.binary()), "ends": pa.array(ends, pa.string())})
    if state is not None:
        yield pa.RecordBatch.from_pydict({"sig": pa.array([sig], pa.binary()), "ends": pa.array([state.hexdigest()])})


def common(a: bytes, b: bytes) -> int:
    """How many first turns two sequences share."""
    most = min(len(a), len(b)) // HASH
    d = 0
    while d < most and a[d * HASH:(d + 1) * HASH] == b[d * HASH:(d + 1) * HASH]:
        d += 1
    return d


class Forest:
    """Nodes over one sorted range of different sequences. `before` and `after` are the turns that its first and last sequence
    share with the neighbours outside, -1 where there is none."""

    def __init__(self, keys: list[bytes], counts, firsts, words, ends, before: int, after: int):
        from xxhash import xxh3_128_digest

        self.words, self.before, self.after, self.last = words, before, after, len(keys) - 1
        self.root = list(range(len(keys)))
        # Of each component: its top node, which may still grow, and the sequences it reaches from and to.
        self.tops = [{"depth": len(k) // HASH, "from": i, "to": i, "conv_id": firsts[i], "n_convs": counts[i], "n_children": 0, "bare": True,
                      "n_leaves": 0, "spent": 0, "owned": 0, "ends": ends[i]} for i, k in enumerate(keys)]
        self.nodes: list[dict] = []
        edges = [common(a, b) for a, b in zip(keys, keys[1:])]
        self.ids: list[list[bytes]] = []
        for i, key in enumerate(keys):
            chain = self.ids[-1][:edges[i - 1] + 1] if i else [ROOT]
            while len(chain) <= len(key) // HASH:
                d = len(chain) - 1
                chain.append(xxh3_128_digest(chain[-1] + key[d * HASH:(d + 1) * HASH]))
            self.ids.append(chain)
        for i in sorted(range(len(edges)), key=edges.__getitem__, reverse=True):
            self.merge(self.find(i), self.find(i + 1), edges[i])
        if keys:
            top = self.find(0)
            self.lift(top, 0)
            self.finish(self.tops[top])

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def merge(self, a: int, b: int, depth: int) -> None:
        """Two components meet in a node at this depth."""
        self.lift(a, depth)
        self.lift(b, depth)
        x, y = self.tops[a], self.tops[b]
        for c in ("n_convs", "n_children", "n_leaves", "spent", "owned"):
            x[c] += y[c]
        x |= {"conv_id": min(x["conv_id"], y["conv_id"]), "bare": x["bare"] and y["bare"], "ends": x["ends"] or y["ends"], "from": min(x["from"], y["from"]), "to": max(x["to"], y["to"])}
        self.root[b] = a
        self.tops[b] = None

    def finish(self, top: dict) -> dict:
        """No more can join the top node: its row, with its own words added to the sums."""
        depth = top["depth"]
        shared = top["from"] == 0 and depth <= self.before
        reaches = top["to"] == self.last and depth <= self.after
        ids = self.ids[top["from"]]
        word = self.words[top["from"]][depth - 1] if depth else 0
        leaves = int(not reaches) if top["bare"] else top["n_leaves"]
        node = top | {"id": ids[depth], "parent": ids[depth - 1] if depth else None, "n_leaves": leaves, "spent": top["spent"] + top["n_convs"] * word,
                      "owned": top["owned"] + (0 if shared else word), "open": shared or reaches, "shared": shared}
        self.nodes.append(node)
        return node

    def lift(self, i: int, depth: int) -> None:
        """Finishes the nodes of a component that lie deeper than this."""
        while self.tops[i]["depth"] > depth:
            node = self.finish(self.tops[i])
            self.tops[i] = self.tops[i] | {"depth": node["depth"] - 1, "n_children": int(not node["shared"]), "bare": False, "n_leaves": node["n_leaves"],
                                           "spent": node["spent"], "owned": node["owned"], "ends": None}


def _range_nodes(key, left, right):
    """The nodes of one range, finished or open."""
    import pyarrow as pa

    rows = sorted(zip(left.column("key").to_pylist(), left.column("n").to_pylist(), left.column("conv_id").to_pylist(), left.column("words").to_pylist(), left.column("ends").to_pylist()), key=lambda r: r[0])
    bound = right.to_pylist()[0]
    keys, counts, firsts, words, ends = (list(c) for c in zip(*rows))
    before = -1 if bound["prior"] is None else common(bound["prior"], keys[0])
    after = -1 if bound["next"] is None else common(keys[-1], bound["next"])
    nodes = Forest(keys, counts, firsts, words, ends, before, after).nodes
    ready = {n["id"]: n["conv_id"] for n in nodes if not n["open"]}
    out = {c: [n[c] for n in nodes] for c in ("depth", "id", "parent", "conv_id", "n_convs", "n_children", "n_leaves", "spent", "owned", "ends", "open")}
    out |= {"pid": [key[0].as_py()] * len(nodes), "parent_conv_id": [ready.get(n["parent"]) for n in nodes]}
    kinds = {"pid": pa.int32(), "id": pa.binary(), "parent": pa.binary(), "ends": pa.string(), "open": pa.bool_()}
    names = [c.split()[0] for c in NODES.split(", ")]
    return pa.table({c: pa.array(out[c], kinds.get(c, pa.int64())) for c in names})


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie of `sequences` (conv_id, hashes array<string> of 32 hex digits a turn, words array<int> a turn).

    One row for each distinct start of a sequence, the empty one included, as the query's contract has it: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. conv_id is unique and not null. An empty table
    gives no row. A sequence travels as one row of 20 bytes a turn; a range of sequences is one task's.
    """
    spark = sequences.sparkSession
    folder = shared_folder(spark)

    def store(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    key = F.unhex(F.concat_ws("", "hashes"))
    whole = store(sequences.select("conv_id", key.alias("key"), "words").withColumn("sig", F.unhex(F.md5("key"))), "sequences")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The numbers of equal conversations, however many, are joined in pieces by many tasks; only their digest is sequential.
    pieces = whole.select("sig", "conv_id").repartitionByRange(parts, "sig", "conv_id").sortWithinPartitions("sig", "conv_id").mapInArrow(_pieces, "sig binary, first long, ids string")
    ends = store(pieces.repartition("sig").sortWithinPartitions("sig", "first").mapInArrow(_digests, "sig binary, ends string"), "ends")
    distinct = whole.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.first("key").alias("key"), F.first("words").alias("words"))
    distinct = store(distinct.join(ends, "sig").drop("sig"), "distinct")
    turns = distinct.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    ranged = distinct.repartitionByRange(max(parts, -(-turns // TURNS_IN_RANGE)), "key").withColumn("pid", F.spark_partition_id())
    ranged = store(ranged, "ranged")
    # One row for each range: the neighbours' keys.
    order = Window.orderBy("pid")
    bounds = ranged.groupBy("pid").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    bounds = bounds.select("pid", F.lag("hi").over(order).alias("prior"), F.lead("lo").over(order).alias("next"))
    nodes = store(ranged.groupBy("pid").cogroup(bounds.groupBy("pid")).applyInArrow(_range_nodes, NODES), "nodes")
    opened = nodes.filter("open").groupBy("id", "depth").agg(
        F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "spent", "owned")], F.max("ends").alias("ends"))
    opened = store(opened, "opened")
    above = opened.select(F.col("id").alias("parent"), F.col("conv_id").alias("above"))
    merged = opened.join(above, "parent", "left").withColumnRenamed("above", "parent_conv_id")
    # By range as well, so that the children of one node are not one key.
    there = nodes.filter("open").select("pid", F.col("id").alias("parent")).join(above, "parent")
    closed = nodes.filter("NOT open").join(there, ["pid", "parent"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("spent") - F.col("owned")).alias("saved_tokens"),
               F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256")]
    return merged.select(*columns).unionByName(closed.select(*columns))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of all conversations after each has taken its family's first turns.

    Null roles and texts are empty, null turns come first, equal turns of one number are ordered by hash, rows without a
    conv_id belong to no conversation. Other columns are ignored. An empty table gives an empty result.
    """
    spark = conversations.sparkSession
    folder = shared_folder(spark)
    lists = turn_lists(conversations)
    lists.write.parquet(folder)
    return prefix_trie(with_shared_starts(spark.read.schema(lists.schema).parquet(folder)))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, md5(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
  len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS w FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (SELECT conv_id AS c, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(w ORDER BY turn NULLS FIRST, k) AS ws,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 4 AS h FROM t GROUP BY conv_id),
seq AS MATERIALIZED (SELECT o.c, list_concat(coalesce(b.ks[1:o.h], []), o.ks[o.h + 1:]) AS ks, list_concat(coalesce(b.ws[1:o.h], []), o.ws[o.h + 1:]) AS ws
  FROM own o LEFT JOIN own b ON b.c = o.c - o.c % 20),
steps AS (SELECT c, ks, ws, unnest(range(0, len(ks) + 1)) AS d FROM seq),
member AS (SELECT c, d, array_to_string(ks[1:d], '') AS id, CASE WHEN d = 0 THEN 0 ELSE ws[d] END AS w, len(ks) = d AS ended FROM steps),
node AS MATERIALIZED (SELECT id, d, min(c) AS conv_id, count(*) AS n, min(w) AS w, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '')) AS ends FROM member GROUP BY id, d),
kids AS (SELECT left(id, 32 * (d::INT - 1)) AS id, d - 1 AS d, count(*) AS k FROM node WHERE d > 0 GROUP BY ALL),
full_node AS MATERIALIZED (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kids USING (id, d)),
up AS (SELECT *, unnest(range(0, d + 1)) AS a FROM full_node),
sums AS (SELECT left(id, 32 * a::INT) AS id, a AS d, count(*) FILTER (k = 0) AS n_leaves, sum((n - 1) * w) AS saved FROM up GROUP BY ALL)
SELECT f.conv_id::BIGINT AS conv_id, f.d::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, f.n::BIGINT AS n_convs, f.k::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM full_node f JOIN sums USING (id, d) LEFT JOIN full_node p ON p.d = f.d - 1 AND p.id = left(f.id, 32 * (f.d::INT - 1))
"""
