"""Packing of documents into sequences by linear grouping and best fit.

Only the counts of pieces by length (at most `capacity` rows) reach the driver. There the plan is made:

1. lengths above `large` are sorted and cut into groups of equal cardinality, each rounded up to its longest member;
2. configurations of the few rounded sizes are chosen by column generation for the linear relaxation, rounded down;
3. the real lengths take the slots of their groups, longest first, so that room is left over; large pieces without a slot
   go by best fit;
4. small lengths go, longest first, each to the fullest sequence that still takes it.

Sequences of one content are one entry of the plan with a number of copies, so the plan grows with the number of lengths and
not with the input. Pieces then find their place from their length and their rank among the pieces of that length.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slopeworks.llm.plans import spare_names
from slopeworks.llm.tasks import released
from slopeworks.llm.tokens import WordEncoder, encoder
from slopeworks.session import shared_folder

CAPACITY = 4096
GROUPS = 32
PLAN_BROADCAST = 500_000
RANK_BLOCK = 50_000  # rows of one length that a window ranks at once


def _configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 400) -> list[tuple[list[int], int]]:
    """(slots of each size, copies) of configurations that take at most `counts`; column generation with a knapsack by length."""
    import numpy as np

    k, demand = len(sizes), np.asarray(counts, float)
    columns = [[capacity // s if i == j else 0 for j in range(k)] for i, s in enumerate(sizes)]
    basis = np.asarray(columns, float).T
    for _ in range(rounds):
        x = np.linalg.solve(basis, demand)
        worth = np.linalg.solve(basis.T, np.ones(k))
        best = np.zeros(capacity + 1)
        for size, value in zip(sizes, worth):
            if value > 0:
                for _ in range(capacity // size):
                    np.maximum(best[size:], best[:-size] + value, out=best[size:])
        if best[capacity] <= 1 + 1e-7:
            break
        new, room = np.zeros(k), capacity
        while best[room] > 1e-12:
            j = next((j for j in range(k) if sizes[j] <= room and worth[j] > 0 and best[room - sizes[j]] + worth[j] >= best[room] - 1e-12), None)
            if j is None:
                room -= 1
            else:
                new[j] += 1
                room -= sizes[j]
        ray = np.linalg.solve(basis, new)
        ratio = np.full(k, np.inf)
        np.divide(x, ray, out=ratio, where=ray > 1e-9)
        basis[:, int(np.argmin(ratio))] = new
    x = np.linalg.solve(basis, demand)
    return [([int(round(v)) for v in basis[:, i]], int(x[i] + 1e-6)) for i in range(k) if x[i] >= 1]


def _groups(large: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
    """(length, count) from long to short, cut into `groups` runs of about equal cardinality; a length may be in two of them."""
    total = sum(c for _, c in large)
    share, out, room = max(1, -(-total // groups)), [], 0
    for length, count in large:
        while count:
            if not room:
                out.append([])
                room = share
            take = min(room, count)
            out[-1].append([length, take])
            room -= take
            count -= take
    return out


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: int | None = None) -> list[tuple[int, list[tuple[int, int]]]]:
    """(copies, [(length, how many in each copy)]) of all sequences, for counts of pieces by length from 1 to `capacity`."""
    large = large or capacity // 8
    bins: dict[int, list[tuple]] = {}  # by free room: [copies, contents]
    rooms: list[int] = []  # those in use, in order

    def put(room: int, copies: int, contents: list) -> None:
        if copies:
            if not bins.get(room):
                bins[room] = []
                insort(rooms, room)
            bins[room].append((copies, contents))

    big = sorted(((n, c) for n, c in histogram.items() if n >= large and n < capacity and c), reverse=True)
    put(0, histogram.get(capacity, 0), [(capacity, 1)])
    left: dict[int, int] = {n: c for n, c in histogram.items() if n < large and c}
    cut = _groups(big, groups)
    if cut:
        # Groups of the same longest member are one size.
        merged: dict[int, list[list[int]]] = {}
        for g in cut:
            merged.setdefault(g[0][0], []).extend(g)
        sizes = list(merged)
        members = [merged[s] for s in sizes]
        for slots, copies in sorted(_configurations(sizes, [sum(c for _, c in m) for m in members], capacity), key=lambda p: [-v for v in p[0]]):
            wanted = [j for j, v in enumerate(slots) for _ in range(v)]
            while copies:
                # Each slot takes the longest member left of its group; a run of copies lasts as long as all those lengths do.
                head = {j: members[j][0] for j in set(wanted) if members[j]}
                if len(head) < len(set(wanted)):
                    break
                run = min([copies, *(head[j][1] // slots[j] for j in head)])
                if run:
                    contents = [(head[j][0], slots[j]) for j in head]
                    for j in head:
                        head[j][1] -= run * slots[j]
                        if not head[j][1]:
                            members[j].pop(0)
                else:  # a length ends inside a copy
                    run, contents, short = 1, [], False
                    for j in head:
                        need = slots[j]
                        while need and members[j]:
                            take = min(need, members[j][0][1])
                            contents.append((members[j][0][0], take))
                            members[j][0][1] -= take
                            need -= take
                            if not members[j][0][1]:
                                members[j].pop(0)
                        short |= bool(need)
                    if short:
                        copies = run
                put(capacity - sum(n * c for n, c in contents), run, contents)
                copies -= run
        for m in members:
            for n, c in m:
                left[n] = left.get(n, 0) + c
    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            k = bisect_left(rooms, n)
            if k == len(rooms):  # new sequences
                full, rest = divmod(count, capacity // n)
                put(capacity - n * (capacity // n), full, [(n, capacity // n)])
                put(capacity - n * rest, 1 if rest else 0, [(n, rest)])
                break
            room = rooms[k]
            copies, contents = bins[room].pop()
            if not bins[room]:
                rooms.pop(k)
            each = room // n
            full = min(copies, count // each)
            rest = min(count - full * each, each - 1) if full < copies else 0
            put(room - each * n, full, [*contents, (n, each)])
            put(room - rest * n, 1 if rest else 0, [*contents, (n, rest)])
            put(room, copies - full - (1 if rest else 0), contents)
            count -= full * each + rest
    return [(copies, contents) for entries in bins.values() for copies, contents in entries]


def _piece_task(tokenizer: str, end_id: int, capacity: int):
    def cut(batches):
        import pyarrow as pa

        end, size = struct.pack("<I", end_id), 4 * capacity
        ids_of = encoder(WordEncoder, tokenizer).encode
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                rows = []
                for doc_id, row, ids in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), ids_of(part.column(1).to_pylist())):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), size)):
                        own = ids[at:at + size]
                        rows.append((doc_id, row, piece, at // 4, len(own) // 4, zlib.crc32(own)))
                names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
    return cut


PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document, with the ids of its text and the end id; a null text is an empty one."""
    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(released(_piece_task(tokenizer, end_id, capacity)), PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces (doc_id, row, piece, length, ...).

    Any columns may follow. Null doc_ids and repeated rows are pieces like others. An empty table gives an empty result.
    Read the table from storage: it is used three times.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    entries, first = [], 0
    taken: dict[int, int] = {}
    for copies, contents in plan_packing(histogram, capacity, groups):
        at = 0
        for n, each in contents:
            rank = taken.get(n, 0)
            entries.append((n, rank, rank + copies * each, first, each, at))
            taken[n] = rank + copies * each
            at += n * each
        first += copies
    plan = spark.createDataFrame(entries, "length long, from_rank long, to_rank long, first_sequence long, each long, at long")
    blocks = max(1, sum(histogram.values()) // RANK_BLOCK)
    block, inside, rank, before = spare_names(pieces, "_block", "_inside", "_rank", "_before")
    spread = pieces.withColumn(block, F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)))
    counts = spread.groupBy("length", block).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", block, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias(before))
    order = F.row_number().over(Window.partitionBy("length", block).orderBy("row", "piece")) - 1
    ranked = spread.withColumn(inside, order).join(counts, ["length", block]).withColumn(rank, F.col(before) + F.col(inside))
    # The plan has a few entries for each length, of which there are at most `capacity`.
    small = F.broadcast(plan) if len(entries) <= PLAN_BROADCAST else plan
    placed = ranked.join(small, (ranked["length"] == plan["length"]) & (ranked[rank] >= plan["from_rank"]) & (ranked[rank] < plan["to_rank"]))
    within = F.col(rank) - plan["from_rank"]
    return placed.select(*[ranked[c] for c in pieces.columns], (plan["first_sequence"] + F.floor(within / plan["each"])).alias("sequence_id"),
                         (plan["at"] + (within % plan["each"]) * ranked["length"]).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Extra columns of `docs` are ignored."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    pieces_of(docs, tokenizer, end_id, capacity).write.parquet(folder)
    return pack(spark.read.schema(PIECES).parquet(folder), capacity, groups).drop("row")
