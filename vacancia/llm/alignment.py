"""Operator 11: alignment of two tokenizers of one corpus, in Arrow.

Each text is encoded by a byte-level tokenizer (A, of a blank and the text) and by a
SentencePiece model (B, which adds that blank). The ids of a slice of documents are two list
columns; flattening them with their parent indices and a cumulative sum of token lengths,
less what lies before the document, gives the byte at which each token ends. A full outer hash
join on (document, end) brings both sides together: rows with both sides end a group, and every
row is a link, of the A and the B token that end there or next. Links are counted by
Table.group_by, for each document and then for each task, and Spark adds the tasks' counts.

The counts come back to the documents in two ways. Of all links only fewer than `heavy` id pairs
can hold more than one in `heavy`; these, and no others, are broadcast and looked up. The rest
is joined by a shuffle in which no pair has more than that share of the links.

Defined cases: texts that are null or empty, or that either side does not spell byte by byte
(as where a text holds U+2581), have no tokens: zeros and an empty hash; a very long text is
aligned whole in one task; ids may be null or repeated, and every row is aligned and counted; an
empty table gives no row; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentencepieces import prefix_table
from .shared import slices, written
from .tokens import PIECES, RARE, RUNS, Encoder

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, counts binary"
ROWS_HELD = 2_000_000

_encoders: dict[str, "SpacedEncoder"] = {}


class SpacedEncoder(Encoder):
    """Encodes a blank and the text; the strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.library.encode_special_tokens = True
        code = {c: b for b, c in self.alphabet.items()}
        spelt = (self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size()))
        self.spelt = pa.array([bytes(code[c] for c in x) if all(c in code for c in x) else x.encode() for x in spelt], pa.large_binary())

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.splits or RARE.search(text):
            return self._whole(f" {text}")
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in RUNS):
            found = PIECES.findall(f" {text}")
            keys = [x[1:] if x[0] == " " and x[1:2] not in ("", " ", "\n") else x for x in found]
        else:
            keys = text.replace("\n", " \n").split(" ")
        return b"".join(map(self.pieces.__getitem__, keys))


def spaced_encoder(path: str) -> SpacedEncoder:
    if path not in _encoders:
        _encoders[path] = SpacedEncoder(path)
    return _encoders[path]


class Side:
    """The token ids of the documents of a slice, as a list column."""

    def __init__(self, ids: list[bytes], dtype: np.dtype, spelt: pa.Array):
        self.sizes = np.fromiter((len(x) // dtype.itemsize for x in ids), np.int64, len(ids))
        offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        flat = np.frombuffer(b"".join(ids), dtype).astype(np.int32)
        self.lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat))
        self.offsets, self.spelt = offsets, spelt

    def texts(self) -> Iterator[memoryview]:
        """The joined bytes of each document's tokens."""
        joined = self.spelt.take(self.lists.flatten())
        at = np.frombuffer(joined.buffers()[1], np.int64)[self.offsets].tolist() if len(joined) else [0] * len(self.offsets)
        data = memoryview(joined.buffers()[2] or b"").cast("B") if len(joined) else memoryview(b"")
        return (data[a:b] for a, b in zip(at, at[1:]))

    def ends(self, name: str) -> pa.Table:
        """One row for each token: the key of document and end byte, and the id."""
        ids, doc = pc.list_flatten(self.lists), pc.list_parent_indices(self.lists)
        running = pc.cumulative_sum(pc.cast(pc.binary_length(self.spelt).take(ids), pa.int64()))
        before = pa.concat_arrays([pa.array([0], pa.int64()), running]).take(pa.array(self.offsets[:-1]))
        end = pc.subtract(running, before.take(doc))
        return pa.table({"key": pc.add(pc.shift_left(doc, pa.scalar(32, pa.int64())), end), name: ids})


def id_strings(n: int) -> pa.Array:
    """Every id with the sign that may follow it: a comma, a bar, a semicolon."""
    return pa.array([f"{i}{sign}".encode() for i in range(n) for sign in ",|;"], pa.large_binary())


def align(a: Side, b: Side, strings: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Groups and links of each document, the hashes of its groups, and its links' id pairs
    a * |B| + b with their counts, in order, and where each document's pairs begin."""
    n = len(a.sizes)
    # Both tokenizations end where the text ends, so filling backwards stays in a document.
    joined = a.ends("a").join(b.ends("b"), "key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
    has_a, has_b = (pc.is_valid(joined[c]).to_numpy() for c in "ab")
    doc = joined["key"].to_numpy() >> 32
    ids_a, ids_b = (pc.fill_null_backward(joined[c]).to_numpy().astype(np.int64) for c in "ab")
    closes = has_a & has_b
    n_groups, n_links = np.bincount(doc[closes], minlength=n), np.bincount(doc, minlength=n)

    group = np.cumsum(closes) - closes
    group_a, group_b = group[has_a], group[has_b]
    many = int(closes.sum())
    upto_a, upto_b = (np.cumsum(np.bincount(g, minlength=many)) for g in (group_a, group_b))
    codes = np.empty(len(group_a) + len(group_b), np.int64)
    codes[np.arange(len(group_a)) + np.concatenate([[0], upto_b])[group_a]] = 3 * ids_a[has_a] + closes[has_a]
    if len(group_b):
        codes[np.arange(len(group_b)) + upto_a[group_b]] = 3 * ids_b[has_b] + 2 * closes[has_b]
    text = strings.take(pa.array(codes))
    at = np.frombuffer(text.buffers()[1], np.int64)[a.offsets + b.offsets].tolist() if len(codes) else [0] * (n + 1)
    data = memoryview(text.buffers()[2]) if len(codes) else memoryview(b"")
    hashes = [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at, at[1:])]

    span = len(a.spelt) * len(b.spelt)
    links = pa.table({"code": doc * span + ids_a * len(b.spelt) + ids_b})
    counted = links.group_by("code", use_threads=False).aggregate([([], "count_all")]).sort_by("code").combine_chunks()
    codes, counts = counted["code"].to_numpy(), counted["count_all"].to_numpy()
    return n_groups, n_links, hashes, codes % span, counts, np.searchsorted(codes // span, np.arange(n + 1))


def align_documents(docs: DataFrame, tokenizer: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the
    id pairs of its links (little-endian uint64, a * |B| + b, ascending) with their counts (uint32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = spaced_encoder(tokenizer), prefix_table(model)
        strings = id_strings(max(len(left.spelt), len(right.spelt)))
        for batch in slices(batches, "text", 2 << 20):
            texts = batch.column(1).to_pylist()
            ids_a, ids_b = [left.encode(x) for x in texts], right.encode(texts)
            a, b = Side(ids_a, left.dtype, left.spelt), Side(ids_b, right.dtype, right.spelt)
            wanted = (f" {x}".encode() if x else b"" for x in texts)
            wrong = [i for i, (w, x, y) in enumerate(zip(wanted, a.texts(), b.texts())) if x != w or y != w]
            if wrong:
                for i in wrong:
                    ids_a[i] = ids_b[i] = b""
                a, b = Side(ids_a, left.dtype, left.spelt), Side(ids_b, right.dtype, right.spelt)
            n_groups, n_links, hashes, pairs, counts, at = align(a, b, strings)
            pairs, counts = pairs.astype("<u8"), counts.astype("<u4")
            cut = [slice(x, y) for x, y in zip(at.tolist(), at[1:].tolist())]
            columns = [batch.column(0), pa.array(a.sizes), pa.array(b.sizes), pa.array(n_groups), pa.array(n_links), pa.array(hashes, pa.string())]
            columns += [pa.array([x[c].tobytes() for c in cut], pa.binary()) for x in (pairs, counts)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts"])
        left.rest()
        right.rest()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ALIGNED)


def _joined(column: pa.Array, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def count_pairs(aligned: DataFrame) -> DataFrame:
    """pair and n: how many links of all documents hold each id pair."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def add() -> pa.Table:
            return pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                held.append(pa.table({"pair": _joined(part.column(0), "<u8").astype(np.int64), "n": _joined(part.column(1), "<u4").astype(np.int64)}))
                if sum(map(len, held)) > ROWS_HELD:
                    held = [add()]
                    if len(held[0]) > ROWS_HELD // 2:
                        yield from held[0].to_batches()
                        held = []
        if held:
            yield from add().to_batches()

    return aligned.select("pairs", "counts").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def link_statistics(aligned: DataFrame, pairs: DataFrame, heavy: int = 1 << 21) -> DataFrame:
    """aligned (with a column place that tells its rows apart) without its pairs, and with
    n_best and count_sum, from pairs: pair, n, best."""
    spark = aligned.sparkSession
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") > total / heavy
    # Fewer than `heavy` pairs can hold more than 1 / heavy of all links each.
    few = pairs.where(often).select("pair", "n", "best").toArrow().sort_by("pair")
    known = spark.sparkContext.broadcast(tuple(few[c].to_numpy() for c in ("pair", "n", "best")))
    light = "array<struct<pair: long, n: long>>"
    kept = [f for f in aligned.schema.fields if f.name not in ("pairs", "counts")]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, totals, bests = known.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                pair, n = _joined(batch.column(0), "<u8").astype(np.int64), _joined(batch.column(1), "<u4").astype(np.int64)
                sizes = np.fromiter((len(x) // 4 for x in batch.column(1).to_pylist()), np.int64, batch.num_rows)
                at = np.searchsorted(keys, pair)
                found = at < len(keys)
                found[found] = keys[at[found]] == pair[found]
                row = np.repeat(np.arange(batch.num_rows), sizes)[found]
                sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
                np.add.at(sums[0], row, n[found] * bests[at[found]])
                np.add.at(sums[1], row, n[found] * totals[at[found]])
                left = np.concatenate([[0], np.cumsum(~found)])[np.concatenate([[0], np.cumsum(sizes)])]
                structs = pa.StructArray.from_arrays([pa.array(pair[~found]), pa.array(n[~found])], ["pair", "n"])
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(left, pa.int32()), structs)], [*(f.name for f in kept), "n_best", "count_sum", "light"])

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    looked = aligned.select("pairs", "counts", *(f.name for f in kept)).mapInArrow(look_up, f"{columns}, n_best long, count_sum long, light {light}")
    looked = written(looked, "aligned-sums")
    rest = looked.select("place", F.explode("light").alias("link")).select("place", F.col("link.pair").alias("pair"), F.col("link.n").alias("times"))
    found = rest.join(pairs.where(~often), "pair").groupBy("place").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    joined = looked.drop("light").join(found, "place", "left")
    return joined.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).drop("more_best", "more_sum")


def align_corpus(docs: DataFrame, tokenizer: str, model: str, id_col: str = "doc_id", text_col: str = "text", heavy: int = 1 << 21) -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    aligned = align_documents(docs, tokenizer, model, id_col, text_col).withColumn("place", F.monotonically_increasing_id())
    aligned = written(aligned, "aligned", compression="zstd")
    n_b = len(prefix_table(model).spelt)
    pairs = written(count_pairs(aligned).withColumn("b", F.col("pair") % n_b), "pair-counts")
    best = pairs.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of B at most
    pairs = pairs.join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    return link_statistics(aligned, pairs, heavy).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
