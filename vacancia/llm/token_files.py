"""Operator 1: token ids in Arrow files of fixed-size-list batches.

Documents are range-partitioned by id. Each range becomes one shard: an Arrow IPC file
(the stream format with a footer) whose record batches hold equally many sequences of
equal length. Columns `ids` (fixed_size_list of uint16 or uint32, as the vocabulary needs)
and `mask` (fixed_size_list of bool, false for the padding of a shard's last sequence)
have fixed widths and no nulls, so sequence i lies in batch i // rows at row i % rows and
is a zero-copy view of the mapped file. A second Arrow file holds doc_id, start (in the
shard) and n_tokens of each document.

Defined cases: null and empty texts hold the end id alone; a very long text runs over as many
sequences as it needs; null ids come first; documents of one id are ordered by the first
PREFIX characters of their text, its hash and their place in the scan, and may fill several
ranges, so a repeated or
missing id makes no large task; an empty table gives no shard; other columns of the input
are not read. A task writes under a name of its own attempt and renames the file
when it is whole, so a lost executor or a second attempt leaves no broken shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import file_system, partitions, slices, work_path
from .tokens import encoder

PREFIX = 64
MANIFEST = "shard int, path string, index_path string, n_docs long, n_tokens long"


def schema_of(dtype: np.dtype, length: int) -> pa.Schema:
    kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
    ids = pa.field("ids", pa.list_(pa.field("item", kind, False), length), False)
    mask = pa.field("mask", pa.list_(pa.field("item", pa.bool_(), False), length), False)
    return pa.schema([ids, mask])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class ShardWriter:
    """Appends documents to one shard; memory is bounded by a batch and one document."""

    def __init__(self, sink, dtype: np.dtype, length: int, rows: int):
        self.schema, self.length, self.rows, self.dtype = schema_of(dtype, length), length, rows, dtype
        self.file = pa.ipc.new_file(sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.waiting = self.total = 0

    def append(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= self.length * self.rows:
            self._write(False)

    def _write(self, last: bool) -> None:
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, self.dtype)
        size = self.length * self.rows
        whole = len(ids) // size * size
        for at in range(0, whole, size):
            self._batch(ids[at : at + size], size)
        left = ids[whole:]
        if last and len(left):
            padded = np.zeros(-(-len(left) // self.length) * self.length, self.dtype)
            padded[: len(left)] = left
            self._batch(padded, len(left))
            left = left[:0]
        self.parts, self.waiting = [left], len(left)

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((ids, mask), self.schema)]
        self.file.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        self._write(True)
        self.file.close()


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, rows: int = 64, shards: int | None = None, path: str | None = None) -> DataFrame:
    """Write docs as shards below path and return their manifest in ascending id order:
    shard, path, index_path, n_docs, n_tokens, base (ids in all shards before)."""
    spark = docs.sparkSession
    path = path or work_path(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        files, top = file_system(path)
        files.create_dir(top, recursive=True)
        shard, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        names = [f"{top}/{shard:06d}.{kind}" for kind in ("arrow", "index.arrow")]
        writer = None
        index: list[tuple[np.ndarray, ...]] = []
        for batch in slices(batches, "text"):
            if writer is None:
                sink = files.open_output_stream(f"{names[0]}.{own}")
                writer = ShardWriter(sink, code.dtype, length, rows)
            starts, counts = [], []
            for text in batch.column(1):
                ids = np.append(np.frombuffer(code.encode(text.as_py()), code.dtype), code.dtype.type(end_id))
                starts.append(writer.total)
                counts.append(len(ids))
                writer.append(ids)
            index.append(pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=INDEX))
        if writer is None:
            return
        code.rest()
        writer.close()
        sink.close()
        with files.open_output_stream(f"{names[1]}.{own}") as sink, pa.ipc.new_file(sink, INDEX) as out:
            for batch in index:
                out.write_batch(batch)
        for name in names:
            files.move(f"{name}.{own}", name)
        uris = [f"{path}/{name.rpartition('/')[2]}" for name in names]
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [uris[0]], "index_path": [uris[1]], "n_docs": pa.array([sum(map(len, index))], pa.int64()), "n_tokens": pa.array([writer.total], pa.int64())})

    text = F.col(text_col).cast("string")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.substring(text, 1, PREFIX).alias("prefix"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("place"))
    key = ("doc_id", "prefix", "hash", "place")
    ordered = keyed.repartitionByRange(shards or partitions(spark), *key).sortWithinPartitions(*key).select("doc_id", "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    # One row for each shard, so one window over all of them stays small.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Sequences:
    """Random access to the sequences of one shard, without a copy where the file is local."""

    def __init__(self, uri: str):
        files, name = file_system(uri)
        source = pa.memory_map(name) if files.type_name == "local" else files.open_input_file(name)
        self.file = pa.ipc.open_file(source)
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self.length = self.file.schema.field("ids").type.list_size

    def batch_ids(self, b: int) -> np.ndarray:
        return self.file.get_batch(b).column(0).flatten().to_numpy(zero_copy_only=True)

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return (n - 1) * self.rows + self.file.get_batch(n - 1).num_rows if n else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence i; both are views of the file."""
        batch = self.file.get_batch(i // self.rows)
        at = i % self.rows * self.length
        return batch.column(0).flatten().to_numpy(zero_copy_only=True)[at : at + self.length], batch.column(1).flatten().slice(at, self.length)

    def run(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from position start of the shard on, n of them, in views."""
        size = self.rows * self.length
        while n:
            ids = self.batch_ids(start // size)[start % size :][:n]
            yield ids
            start, n = start + len(ids), n - len(ids)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Read the shards back: doc_id, start, n_tokens, ids_crc32 of every document."""
    n = manifest.count()  # shards

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, name = file_system(row["index_path"])
                shard = Sequences(row["path"])
                with files.open_input_file(name) as source:
                    index = pa.ipc.open_file(source)
                    for i in range(index.num_record_batches):
                        docs = index.get_batch(i)
                        crcs = []
                        for start, many in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist()):
                            crc = 0
                            for ids in shard.run(start, many):
                                crc = zlib.crc32(ids.astype("<u4"), crc)
                            crcs.append(crc)
                        yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(docs.column(1).to_numpy() + row["base"]), docs.column(2), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.repartition(max(n, 1)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
