"""Token ids in files of independent zstandard frames with a trailing seek table.

Layout of a file, all integers little-endian:

* data frames: each the ids (unsigned 32-bit) of a run of documents, compressed on its own;
* one skippable frame: the compressed directory of documents, (doc_id int64, ids int64) each;
* one skippable frame, the seek table of the public "zstd seekable format": for each data frame its compressed size, its
  size and the low 32 bits of xxh64 of its content; then the number of frames, a flag byte and the closing magic number.

A reader fetches the tail, finds the frames it needs, checks each against its checksum and decompresses only those.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slopeworks.llm.tasks import released
from slopeworks.llm.tokens import ByteEncoder, encoder
from slopeworks.session import shared_folder

SKIPPABLE, DIRECTORY, SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1  # fixed values of the format
CHECKSUMS = 0x80
FRAME_BYTES = 1 << 20  # ids of a frame before compression, at least one document
LEVEL = 3
MANIFEST = "file string, place long, docs long, ids long"


class Writer:
    """Writes one file; add(doc_id, ids) in any order the caller wants kept."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.sink, self.frame_bytes = sink, frame_bytes
        self.compress = zstandard.ZstdCompressor(level=LEVEL).compress
        self.waiting: list[bytes] = []
        self.size = 0
        self.frames: list[bytes] = []
        self.documents = bytearray()
        self.docs = self.ids = 0

    def add(self, doc_id: int, ids: bytes) -> None:
        self.waiting.append(ids)
        self.size += len(ids)
        self.documents += struct.pack("<qq", doc_id, len(ids) // 4)
        self.docs += 1
        self.ids += len(ids) // 4
        if self.size >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        import xxhash

        if self.size:
            content = b"".join(self.waiting)
            packed = self.compress(content)
            self.sink.write(packed)
            self.frames.append(struct.pack("<III", len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
            self.waiting, self.size = [], 0

    def close(self) -> None:
        self._flush()
        listed = self.compress(bytes(self.documents))
        table = b"".join(self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE)
        self.sink.write(struct.pack("<II", DIRECTORY, len(listed)) + listed + struct.pack("<I", len(listed)))
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class Reader:
    """Reads documents of one file. `source` needs seek(), tell(), read()."""

    def __init__(self, source):
        import numpy as np
        import zstandard

        self.source = source
        self.decompress = zstandard.ZstdDecompressor().decompress
        end = source.seek(0, 2)
        frames, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        start = end - 9 - 12 * frames
        self.frames = np.frombuffer(self._at(start, 12 * frames), "<u4").reshape(-1, 3).astype("int64")
        (listed,) = struct.unpack("<I", self._at(start - 12, 4))
        documents = np.frombuffer(self.decompress(self._at(start - 12 - listed, listed)) if listed else b"", "<i8").reshape(-1, 2)
        self.doc_ids, self.lengths = documents[:, 0], documents[:, 1]
        self.ends = np.cumsum(self.lengths) * 4  # bytes of ids up to and with each document
        self.tops = np.concatenate([[0], np.cumsum(self.frames[:, 1])])
        self.offsets = np.concatenate([[0], np.cumsum(self.frames[:, 0])])

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        import xxhash

        packed, size, checksum = (int(x) for x in self.frames[k])
        content = self.decompress(self._at(int(self.offsets[k]), packed), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} does not match its checksum")
        return content

    def documents(self) -> Iterator[tuple[int, bytes]]:
        """All documents in the order of the file; a frame holds whole documents."""
        import numpy as np

        at = 0
        for k in range(len(self.frames)):
            content, top = self.frame(k), int(self.tops[k])
            last = int(np.searchsorted(self.ends, top + len(content), side="right"))
            for i in range(at, last):
                size, end = int(self.lengths[i]) * 4, int(self.ends[i]) - top
                yield int(self.doc_ids[i]), content[end - size:end]
            at = last
        for i in range(at, len(self.doc_ids)):  # documents without ids at the end
            yield int(self.doc_ids[i]), b""

    def fetch(self, doc_ids: Iterable[int]) -> Iterator[tuple[int, bytes]]:
        """The documents asked for; frames without any of them are not read."""
        import numpy as np

        held: tuple[int, bytes] = (-1, b"")
        for i in np.nonzero(np.isin(self.doc_ids, list(doc_ids)))[0]:
            size, end = int(self.lengths[i]) * 4, int(self.ends[i])
            if not size:
                yield int(self.doc_ids[i]), b""
                continue
            k = int(np.searchsorted(self.tops, end - size, side="right")) - 1
            if held[0] != k:
                held = (k, self.frame(k))
            top = int(self.tops[k])
            yield int(self.doc_ids[i]), held[1][end - size - top:end - top]


def _open(path: str):
    """The file system of a folder that every executor reaches, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _write_task(folder: str, tokenizer: str, end_id: int) -> Callable:
    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        place, writer, sink = task.partitionId(), None, None
        files, root = _open(folder)
        name, draft = f"{root}/ids-{place:06d}.zst", f"{root}/.draft-{place:06d}-{task.taskAttemptId()}"
        end = struct.pack("<I", end_id)
        ids_of = encoder(ByteEncoder, tokenizer).encode
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                for doc_id, ids in zip(part.column(0).to_pylist(), ids_of(part.column(1).to_pylist())):
                    if writer is None:
                        files.create_dir(root, recursive=True)
                        sink = files.open_output_stream(draft)
                        writer = Writer(sink)
                    writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            sink.close()
            files.move(draft, name)  # a task that runs again replaces the file by the same content
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/ids-{place:06d}.zst"], "place": pa.array([place], pa.int64()), "docs": pa.array([writer.docs], pa.int64()), "ids": pa.array([writer.ids], pa.int64())})
    return write


NO_ID = -2**63
DOCS_A_FILE = 1_000_000


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, files: int | None = None) -> DataFrame:
    """Encodes `text` of `docs` and writes one file for each range of doc_id; returns the manifest, read back from `folder`.

    Null and empty texts give the end id alone. Rows of the same doc_id all stay, next to each other. A null doc_id comes first;
    the files hold it as the smallest 64-bit number, which is read back as null. An empty table gives an empty manifest. Other columns are ignored, whatever their names.
    `folder` must be in storage that all executors reach (file, hdfs, s3 or gs address).
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("doc_id"), "text")
    # A writer holds the directory of its file, 16 bytes a document.
    count = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // DOCS_A_FILE))
    # The second key parts rows of one doc_id, should there be very many.
    placed = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(count, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    made = placed.select("doc_id", "text").mapInArrow(released(_write_task(f"{folder}/data", tokenizer, end_id)), MANIFEST)
    made.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _read_task(batches):
    import pyarrow as pa

    for batch in batches:
        for file, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist()):
            files, path = _open(file)
            with files.open_input_file(path) as source:
                rows: list[tuple] = []
                for doc_id, ids in Reader(source).documents():
                    rows.append((doc_id, first, len(ids) // 4, zlib.crc32(ids)))
                    first += len(ids) // 4
                    if len(rows) == 10_000:
                        yield _rows(pa, rows)
                        rows = []
                yield _rows(pa, rows)


def _rows(pa, rows):
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens, ids_crc32. The window sees one row for each file."""
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("first", F.coalesce(F.sum("ids").over(before), F.lit(0))).select("file", "place", "first")
    spread = placed.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "place")
    rows = spread.mapInArrow(released(_read_task), "doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    return read_token_files(write_token_files(docs, shared_folder(spark), tokenizer))
