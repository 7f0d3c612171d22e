"""Operator 6: first-fit decreasing packing with a tournament tree of bin capacities.

Documents become token ids, cut into pieces of the sequence length and one shorter rest.
Pieces are dealt into randomised groups (by a hash of their place, about `group_rows`
documents each, so that equal rows and rows of one id spread out like others) and each group
is packed by itself: pieces in descending length (ties in the order of `key_cols`), each into
the first sequence with enough room, found by descending a tournament tree whose inner nodes
hold the largest free capacity below them. A group of more than `chunk_rows` pieces is packed
in chunks of that many, so a task's memory is bounded.

Defined cases: null and empty texts hold the end id alone; a very long text gives as many
full pieces as it needs; repeated rows are packed each; an empty table gives no row; other
columns of the documents are not read, those of the pieces are kept, but for columns named
sequence_id and offset, which the result replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices
from .tokens import encoder

PIECE = "doc_id long, start long, length int, doc_tokens long, ids binary"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most `length` ids of every document; ids as little-endian uint32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        end = np.array([end_id], code.dtype).tobytes()
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(code.encode(text.as_py()) + end, code.dtype).astype("<u4")
                rows += [(doc, at, min(length, len(ids) - at), len(ids), ids[at : at + length].tobytes()) for at in range(0, len(ids), length)]
            doc, start, size, total, ids = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int32()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "ids"])
        code.rest()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECE)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    full = int((sizes >= capacity).sum())  # these come first and fill a bin each
    bins[order[:full]] = np.arange(full)
    width = 1 << max(0, (len(sizes) - full - 1).bit_length())
    tree = [capacity] * (2 * width)
    for i, size in zip(order[full:].tolist(), sizes[order[full:]].tolist()):
        node = 1
        while node < width:
            node += node
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = full + node - width, capacity - tree[node]
        tree[node] -= size
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            best = left if left > right else right
            if tree[node] == best:
                break
            tree[node] = best
            node >>= 1
    return bins, offsets


def pack(pieces: DataFrame, n_docs: int, length: int = 1024, size_col: str = "length", key_cols: tuple[str, ...] = ("doc_id",), group_rows: int = 8192, chunk_rows: int = 65536, seed: int = 7) -> DataFrame:
    """pieces with sequence_id and offset. All other columns of pieces are kept."""
    groups = max(1, -(-n_docs // group_rows))
    pieces = pieces.drop("sequence_id", "offset")
    at = pieces.schema.names.index(size_col)
    group_col = next(c for i in range(len(pieces.columns) + 1) if (c := f"_pack_group_{i}") not in pieces.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, made, held, rows = None, 0, [], 0

        def flush(part: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            if not part:
                return
            table = pa.Table.from_batches(part).combine_chunks()
            bins, offsets = first_fit_decreasing(table.column(at).to_numpy().astype(np.int64), length)
            table = table.drop_columns([group_col]).append_column("sequence_id", pa.array(bins + made + (group << 40))).append_column("offset", pa.array(offsets))
            made += int(bins.max()) + 1
            yield from table.to_batches()

        for batch in batches:
            keys = batch.column(batch.num_columns - 1).to_numpy()
            for part in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys)) + 1):
                if not len(part):
                    continue
                if keys[part[0]] != group:
                    yield from flush(held)
                    group, made, held, rows = int(keys[part[0]]), 0, [], 0
                held.append(batch.slice(part[0], len(part)))
                rows += len(part)
                if rows >= chunk_rows:
                    yield from flush(held)
                    held, rows = [], 0
        yield from flush(held)

    grouped = pieces.withColumn(group_col, F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)))
    sizes = grouped.repartition(group_col).sortWithinPartitions(group_col, F.desc(size_col), *key_cols)
    out = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return sizes.mapInArrow(run, out)
