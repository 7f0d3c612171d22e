"""Helpers that several operators share: shared folders, written tables, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from spark.checkpoint.dir. Only where that is unset and all runs on one
    machine, as in tests, a temporary folder is made and set; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_made: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/llm-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def file_system(uri: str):
    """The file system and path of a URI; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def remove_written() -> int:
    """Delete the tables and files that operators have written in this session; to be called
    when the results made of them have been stored. Returns how many there were."""
    paths, _made[:] = _made[:], []
    for path in paths:
        files, name = file_system(path)
        if files.get_file_info(name).type.name == "Directory":
            files.delete_dir(name)
    return len(paths)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def range_number(key: list[Column], splitters: list[tuple]) -> Column:
    """How many of the sorted splitters are at most the key: a binary search as a fold."""
    if not splitters:
        return F.lit(0)
    lists = [F.array(*map(F.lit, (x[i] for x in splitters))) for i in range(len(key))]
    n = len(splitters)
    own = F.struct(*(c.alias(f"c{i}") for i, c in enumerate(key)))

    def step(low: Column, j: Column) -> Column:
        mid = low + j
        at = F.struct(*(F.get(x, mid - 1).alias(f"c{i}") for i, x in enumerate(lists)))
        return F.when((mid <= n) & (at <= own), mid).otherwise(low)

    powers = [1 << j for j in reversed(range(n.bit_length()))]
    return F.aggregate(F.array(*map(F.lit, powers)), F.lit(0), step)


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each hold about max_bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()  # the worker lives on and serves other stages


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1)
    offsets = offsets.astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]
