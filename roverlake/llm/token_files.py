"""Token ids as Arrow stream files of equal-length sequences (operator 3).

Documents are range-partitioned and sorted by id, and each task streams its
ids into one file in the shared folder: an Arrow IPC stream whose batches hold
``BATCH`` rows of two fixed-size lists, ``ids`` (uint16 or uint32) and ``mask``
(one bit for each id, 0 where the last sequence is padded). All batches but the
last have the same number of bytes, so the place of any sequence follows from
its number, and a memory map gives its ids without a copy. An index table says
for each document in which file and where its ids lie.

A file counts only if the index names it: an attempt that is lost with its
executor leaves a file of another name behind, and the retry writes its own.

Defined results: a null text is an empty one (its end id alone); a null id sorts
first; repeated rows are documents of their own, one behind the other; an empty table
gives an empty index.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roverlake.llm.common import new_folder
from roverlake.llm.tokens import encoded, encoder

SEQUENCE, BATCH = 2048, 64


def _schema(kind: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(pa.field("id", kind, nullable=False), length), nullable=False), pa.field("mask", pa.list_(pa.field("on", pa.bool_(), nullable=False), length), nullable=False)])


class Writer:
    """Appends ids to a stream file in batches of equal size."""

    def __init__(self, uri: str, kind: np.dtype, length: int = SEQUENCE, batch: int = BATCH) -> None:
        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.length, self.rows, self.kind = length, batch, np.dtype(kind)
        self.schema = _schema(pa.from_numpy_dtype(self.kind), length)
        self.sink = store.open_output_stream(path)
        self.stream = pa.ipc.new_stream(self.sink, self.schema)
        self.rest: list[np.ndarray] = []
        self.held = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        full = self.length * self.rows
        if self.held >= full:
            ids = np.concatenate(self.rest)
            whole = len(ids) - len(ids) % full
            for lo in range(0, whole, full):
                self._write(ids[lo:lo + full], full)
            self.rest, self.held = [ids[whole:].copy()], len(ids) - whole

    def _write(self, ids: np.ndarray, used: int) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(x, type=f.type) for x, f in zip((pa.array(ids, self.schema.field("ids").type.value_type), pa.array(np.arange(len(ids)) < used)), self.schema, strict=True)]
        self.stream.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            ids = np.concatenate(self.rest)
            self._write(np.pad(ids, (0, -len(ids) % self.length)), len(ids))
        self.stream.close()
        self.sink.close()


class Reader:
    """Random access to the sequences of a stream file; a local file is mapped, not read."""

    def __init__(self, uri: str) -> None:
        store, path = fs.FileSystem.from_uri(uri)
        if isinstance(store, fs.LocalFileSystem):
            self.file = pa.memory_map(path)
        else:
            self.file = store.open_input_file(path)
        self.schema = pa.ipc.read_schema(self.file)
        self.length = self.schema.field("ids").type.list_size
        self.first = self.file.tell()
        head = pa.ipc.read_message(self.file)
        self.step = self.file.tell() - self.first
        self.rows = pa.ipc.read_record_batch(head, self.schema).num_rows

    def batch(self, k: int) -> pa.RecordBatch:
        self.file.seek(self.first + k * self.step)
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema)

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """ids and mask of sequence k, views of the file."""
        batch, row = self.batch(k // self.rows), k % self.rows
        ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)
        return ids[row * self.length:(row + 1) * self.length], batch.column(1).flatten().slice(row * self.length, self.length)

    def spans(self, starts: list[int], sizes: list[int]) -> Iterator[np.ndarray]:
        """ids[start:start+size] for each pair; a batch that follows pairs share is opened once."""
        full, now, ids = self.length * self.rows, -1, None
        for start, size in zip(starts, sizes, strict=True):
            out = []
            for k in range(start // full, (start + size - 1) // full + 1):
                if k != now:
                    now, ids = k, self.batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
                out.append(ids[max(0, start - k * full):start + size - k * full])
            yield out[0] if len(out) == 1 else np.concatenate(out)


def write(documents: DataFrame, path: str, end: int, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files and their index; returns the index: file, part, id, start (in the file), n_tokens."""

    def store(batches):
        writer, uri, part = None, f"{folder}/files/{uuid.uuid4().hex}.arrows", TaskContext.get().partitionId()
        for batch in batches:
            for a, b, ids, sizes in encoded(path, batch.column(1), end):
                if writer is None:
                    writer = Writer(uri, encoder(path).kind)
                starts = writer.total + np.cumsum(sizes) - sizes
                writer.add(ids)
                n = b - a
                yield pa.RecordBatch.from_arrays([pa.array([uri] * n), pa.array(np.full(n, part), pa.int32()), batch.column(0).slice(a, n), pa.array(starts), pa.array(sizes)], names=["file", "part", "id", "start", "n_tokens"])
        if writer is not None:
            writer.close()

    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id")
    index = f"{folder}/index"
    rows.mapInArrow(store, "file string, part int, id long, start long, n_tokens long").write.parquet(index)
    return documents.sparkSession.read.schema("file string, part int, id long, start long, n_tokens long").parquet(index)


def read_checksums(index: DataFrame) -> DataFrame:
    """doc_id, start (over all files), n_tokens, ids_crc32 of every document, from the files."""
    sums = index.groupBy("part").agg(F.sum("n_tokens").alias("s"))  # one row for each file
    ahead = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("ahead"))

    def check(batches):
        name, reader = None, None
        for batch in batches:
            files, ids, ahead, start, size = (batch.column(i).to_pylist() for i in range(5))
            crc = []
            lo = 0
            while lo < len(files):
                hi = lo
                while hi < len(files) and files[hi] == files[lo]:
                    hi += 1
                if files[lo] != name:
                    name, reader = files[lo], Reader(files[lo])
                crc.extend(zlib.crc32(x.astype("<u4").tobytes()) for x in reader.spans(start[lo:hi], size[lo:hi]))
                lo = hi
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "start": pa.array([x + y for x, y in zip(ahead, start, strict=True)], pa.int64()), "n_tokens": pa.array(size, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    rows = index.join(F.broadcast(ahead), "part").select("file", "id", "ahead", "start", "n_tokens")
    return rows.mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, documents: DataFrame, path: str, end: int) -> DataFrame:
    """Write all documents, read the files back."""
    return read_checksums(write(documents, path, end, new_folder(spark, "tokens")))
