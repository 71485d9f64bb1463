"""SGD over stored blocks of rows (K12-K17, I26): epochs without a sort of rows, sequential runs in parallel.

`store_blocks` orders the rows once by the hash of their key and stores them as blocks of a fixed number of rows, each one
row with a binary matrix. An epoch permutes the blocks by a keyed hash of the block, and the rows of a block by a keyed hash
of their place, inside the task that reads it. Batches do not cross blocks.

`exact` (OLS, ridge): a block becomes the composed affine map of its batches, and maps are multiplied in the order of the
epoch. No row is shuffled.

`sequential` (any rule): the order of an epoch is cut into chunks. All chunks run at once from predicted states; then every
chunk whose start differs from the end of the chunk before it runs again, until no start moves. The first chunk is right
after one round, the second after two at the latest, so the rounds end, and the result is that of one run over all rows
(up to `settled`) whatever the number of chunks. Updates that forget their start need few rounds; `rounds` reports them.

Null or NaN features or labels make the run stop with a reason, as in `fit_sgd`. Repeated keys are ordered arbitrarily, but once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeworks.operators.gram import gram_stats
from slopeworks.operators.ranking import HASH_SPACE, hash_row_number, key_hash
from slopeworks.plans.sgd import FAN_IN, SgdSetup, apply_map, batch_gradient, batch_map, epoch_rate, poisson_numbers, run_epochs, update

BLOCK_ROWS = 4096
EPOCHS_A_JOB = 10  # whose maps one job makes
MAX_CHUNKS = 1024  # states of that many chunks are sent to tasks and back each round

# Odd multipliers of the order hash, a bijection of 32-bit numbers that any SQL engine can compute.
FIRST_MULTIPLIER, SECOND_MULTIPLIER, SEED_MULTIPLIER = 2654435761, 739982445, 1000003


@dataclass(frozen=True)
class StoredBlocks:
    path: str
    features: tuple[str, ...]
    n_rows: int
    block_rows: int
    zz: np.ndarray  # statistic of the whole table

    @property
    def n_blocks(self) -> int:
        return math.ceil(self.n_rows / self.block_rows)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("block long, n int, data binary").parquet(self.path)


def order_hash(value: Column, seed: int) -> Column:
    """Keyed hash in [0, 2^32) of a number below 2^31; different numbers have different hashes."""
    space = F.lit(HASH_SPACE)
    h = F.pmod(F.pmod(value, F.lit(2**31)) * F.lit(FIRST_MULTIPLIER) + F.lit(seed * SEED_MULTIPLIER % HASH_SPACE), space)
    h = F.pmod(h.bitwiseXOR(F.shiftright(h, 15)) * F.lit(SECOND_MULTIPLIER), space)
    return h.bitwiseXOR(F.shiftright(h, 12))


def order_hash_numbers(value: np.ndarray, seed: int) -> np.ndarray:
    """`order_hash` of an array, inside a task."""
    h = (value.astype(np.int64) % 2**31 * FIRST_MULTIPLIER + seed * SEED_MULTIPLIER % HASH_SPACE) % HASH_SPACE
    h = (h ^ (h >> 15)) * SECOND_MULTIPLIER % HASH_SPACE
    return h ^ (h >> 12)


def store_blocks(df: DataFrame, features: Sequence[str], label: str, key: str, path: str, hashed: Column | None = None,
                 seed: int = 42, block_rows: int = BLOCK_ROWS) -> StoredBlocks:
    """Writes the blocks; the only sort of rows that any number of epochs needs."""
    names = [*features, label]
    zz = np.array(gram_stats(df, list(features), label).first()["zz"], dtype=float).reshape(len(features) + 2, -1)
    n = int(np.nan_to_num(zz[-2, -2]))  # sums over no rows are null
    if n == 0:
        raise ValueError("no rows to train on")
    cells = df.select(key, *[F.col(c).cast("double").alias(c) for c in names])
    ranked = hash_row_number(cells, key, key_hash(key, seed) if hashed is None else hashed, "__rank", n)
    rows = ranked.select(F.floor(F.col("__rank") / block_rows).cast("long").alias("block"), "__rank", *names)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__rank")
        cells = np.column_stack([pdf[list(features)].to_numpy(float), np.ones(len(pdf)), pdf[label].to_numpy(float)])
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "n": [len(pdf)], "data": [cells.astype("<f8").tobytes()]})

    rows.groupBy("block").applyInPandas(pack, "block long, n int, data binary").write.parquet(path)
    return StoredBlocks(path, tuple(features), n, block_rows, zz)


def _batches_of(block: int, n: int, data: bytes, h: int, s: SgdSetup, block_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, weights) of each batch of a block in the order of the epoch; `h` is the hash of the block in that epoch."""
    cells = np.frombuffer(data, dtype="<f8").reshape(n, -1)
    weights = np.ones(n)
    if s.order != "once":
        order = np.argsort(order_hash_numbers(np.arange(n), h))
        cells = cells[order]
        if s.order == "bootstrap":
            weights = poisson_numbers(order_hash_numbers(block * block_rows + order, h + 1) / HASH_SPACE)
    for i in range(0, n, s.batch_size):
        x, y, w = cells[i:i + s.batch_size, :-1], cells[i:i + s.batch_size, -1], weights[i:i + s.batch_size]
        if w.sum() > 0:
            yield x, y, w


def _placed(spark: SparkSession, blocks: StoredBlocks, s: SgdSetup, epoch: int, parts: int) -> DataFrame:
    """Blocks with their place `h` in the order of an epoch and the part of the order that they are in."""
    if s.order == "once":
        place, part = F.col("block"), F.floor(F.col("block") * parts / F.lit(blocks.n_blocks))
    else:
        place = order_hash(F.col("block"), s.seed + epoch)
        part = F.floor(F.col("h") * parts / F.lit(HASH_SPACE))
    return blocks.read(spark).withColumn("h", place.cast("long")).withColumn("part", part.cast("int"))


def _part(place: int, parts: int, blocks: StoredBlocks, s: SgdSetup) -> int:
    """The part of an epoch's order that a place is in, of `parts` about equal ones."""
    return place * parts // (blocks.n_blocks if s.order == "once" else HASH_SPACE)


def _exact_maps(spark: SparkSession, blocks: StoredBlocks, s: SgdSetup, wanted: Sequence[tuple[int, float]]) -> list[np.ndarray]:
    """The composed map of a whole epoch for each (epoch, learning rate): maps do not depend on weights, so one job makes many."""
    block_rows, seed = blocks.block_rows, s.seed
    lam = s.regularization if s.loss == "ridge" else 0.0
    width = (len(blocks.features) + 1) * (2 if s.momentum else 1) + 1
    parts = math.ceil(blocks.n_blocks / FAN_IN)
    rates: dict[int, list[tuple[int, float]]] = {}
    for i, (epoch, lr) in enumerate(wanted):
        rates.setdefault(epoch, []).append((i, float(lr)))

    def map_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                for epoch, asked in rates.items():
                    h = row.block if s.order == "once" else int(order_hash_numbers(np.array([row.block]), seed + epoch)[0])
                    out = [np.eye(width) for _ in asked]
                    for x, y, w in _batches_of(row.block, row.n, row.data, h, s, block_rows):
                        total = w.sum()
                        gram, moment = (x * w[:, None]).T @ x / total, x.T @ (w * y) / total
                        out = [batch_map(gram, moment, lr, s.momentum, lam) @ m for (_, lr), m in zip(asked, out)]
                    yield pd.DataFrame({"part": _part(h, parts, blocks, s), "h": h, "i": [i for i, _ in asked], "m": [m.ravel().tolist() for m in out]})

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.eye(width)
        for m in pdf.sort_values("h")["m"]:
            total = np.asarray(m, dtype=float).reshape(width, width) @ total
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "h": [0], "i": [int(pdf["i"].iloc[0])], "m": [total.ravel().tolist()]})

    schema = "part int, h long, i int, m array<double>"
    maps = blocks.read(spark).mapInPandas(map_blocks, schema).groupBy("part", "i").applyInPandas(compose, schema)
    while parts > 1:
        above = maps.select(F.floor(F.col("part") / FAN_IN).cast("int").alias("part"), F.col("part").cast("long").alias("h"), "i", "m")
        maps = above.groupBy("part", "i").applyInPandas(compose, schema)
        parts = math.ceil(parts / FAN_IN)
    rows = {r["i"]: np.asarray(r["m"], dtype=float) for r in maps.select("i", "m").collect()}  # one matrix a wanted epoch
    return [rows[i] for i in range(len(wanted))]


class _Sequential:
    """One sequential run in chunks; the states between chunks are kept as the next epoch's prediction."""

    def __init__(self, spark: SparkSession, blocks: StoredBlocks, s: SgdSetup, chunks: int, settled: float):
        self.spark, self.blocks, self.s, self.settled = spark, blocks, s, settled
        self.chunks = max(1, min(chunks, blocks.n_blocks, MAX_CHUNKS))
        self.cut, self.gains, self.rounds = None, None, []

    def _cut(self, epoch: int) -> DataFrame:
        """Blocks by chunk, in the order of the epoch; in a fixed order they are cut once."""
        if self.cut is None or self.s.order != "once":
            self.release()
            placed = _placed(self.spark, self.blocks, self.s, epoch, self.chunks)
            self.cut = placed.repartitionById(self.chunks, F.col("part")).sortWithinPartitions("part", "h").persist(StorageLevel.MEMORY_AND_DISK)
        return self.cut

    def release(self) -> None:
        if self.cut is not None:
            self.cut.unpersist()

    def _ends(self, cut: DataFrame, starts: dict[int, np.ndarray], lr: float) -> dict[int, np.ndarray]:
        """The state of each of these chunks after its blocks; a chunk without blocks is not in the result."""
        s, block_rows, p = self.s, self.blocks.block_rows, len(self.blocks.features) + 1

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part, w, v = None, None, None
            for pdf in frames:
                for row in pdf.itertuples(index=False):
                    if row.part != part:
                        if part is not None:
                            yield pd.DataFrame({"part": [part], "state": [np.concatenate([w, v]).tolist()]})
                        part, w, v = row.part, starts[row.part][:p], starts[row.part][p:]
                    for x, y, weight in _batches_of(row.block, row.n, row.data, row.h, s, block_rows):
                        w, v = update(w, v, batch_gradient(x, y, weight, w, s), s, lr)
            if part is not None:
                yield pd.DataFrame({"part": [part], "state": [np.concatenate([w, v]).tolist()]})

        todo = cut.filter(F.col("part").isin(list(starts)))
        rows = todo.mapInPandas(run, "part int, state array<double>").collect()  # one state a chunk, at most MAX_CHUNKS
        return {r["part"]: np.asarray(r["state"], dtype=float) for r in rows}  # NaN comes back as null

    def epoch(self, epoch: int, lr: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut, first = self._cut(epoch), np.concatenate([w, v])
        # Prediction: each chunk moves the state as the chunk in its place did in the epoch before.
        starts = [first + (self.gains[c] if self.gains is not None else 0.0) for c in range(self.chunks)]
        ends, todo, rounds = {}, range(self.chunks), 0
        while todo:
            rounds += 1
            done = self._ends(cut, {c: starts[c] for c in todo}, lr)
            ends.update({c: done.get(c, starts[c]) for c in todo})
            todo = []
            for c in range(1, self.chunks):
                gap = np.abs(ends[c - 1] - starts[c])
                if np.isfinite(ends[c - 1]).all() and not (gap <= self.settled).all():
                    todo.append(c)
                    starts[c] = ends[c - 1]
        self.rounds.append(rounds)
        last = ends[self.chunks - 1]
        broken = [e for _, e in sorted(ends.items()) if not np.isfinite(e).all()]
        if broken:
            last = broken[0]
        self.gains = [start - first for start in starts]
        return last[:len(w)], last[len(w):]


def fit_stored(spark: SparkSession, blocks: StoredBlocks, s: SgdSetup, mode: str = "exact", chunks: int | None = None,
               settled: float = 1e-12) -> tuple[DataFrame, DataFrame]:
    """(model row, history rows); the history of a sequential run also has the rounds of each epoch.

    `chunks` is the number of tasks of a sequential run (the parallelism of the cluster unless given). It does not change the result.
    """
    if blocks.block_rows % s.batch_size:
        raise ValueError("block_rows must be a multiple of the batch size")
    if mode == "sequential":
        run = _Sequential(spark, blocks, s, chunks or spark.sparkContext.defaultParallelism, settled)
        try:
            model, history = run_epochs(spark, s, mode, blocks.zz, run.epoch)
        finally:
            run.release()
        rounds = F.array(*[F.lit(r) for r in run.rounds])
        return model, history.withColumn("rounds", F.element_at(rounds, F.col("epoch")))
    if mode != "exact":
        raise ValueError(f"unknown mode {mode!r}")
    if s.loss not in ("ols", "ridge") or s.step_length:
        raise ValueError("exact mode needs OLS or ridge without unit-length steps; use sequential")
    maps: dict[tuple[int, float], np.ndarray] = {}

    def epoch_step(epoch: int, lr: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        this = (0 if s.order == "once" else epoch, lr)
        if this not in maps:  # in one order, the maps of all rates; else those of the next epochs
            maps.clear()
            wanted = (sorted({(0, epoch_rate(s, e)) for e in range(s.epochs)}) if s.order == "once"
                      else [(e, epoch_rate(s, e)) for e in range(epoch, min(epoch + EPOCHS_A_JOB, s.epochs))])
            maps.update(zip(wanted, _exact_maps(spark, blocks, s, wanted)))
        return apply_map(maps[this], w, v, s)

    return run_epochs(spark, s, mode, blocks.zz, epoch_step)
