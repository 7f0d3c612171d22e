"""Operator 3: document fingerprints as threshold-scaled sketches.

A sketch retains every hash of a document's five-word shingles below a fixed fraction of
the hash range, so its size follows the document's and sketches merge by union. Containment
of one document in another, and their resemblance, are estimated from retained hashes alone,
however unequal the sizes. A document none of whose hashes falls below the threshold retains
its least hash instead; merging keeps all below the threshold, or else the least.

A fingerprint is the retained hashes, ascending, six bytes each in base 64; a sole hash above
the threshold stands after a '~'. The likeness of two fingerprints is their resemblance
below the threshold; if neither has a hash there, it is 1 for equal fingerprints and 0 for
others.

Neighbours: rows are dealt out by ranges of (id, first characters of the text, its hash),
so a repeated or missing id makes no large task, and rows alike in both are counted in the
task that scans them; texts are shuffled once.

Defined cases: null and empty texts, and texts without words, have the empty fingerprint
(likeness 1 to each other, 0 to others); a very long text is hashed whole; null ids come
first; documents of one id are ordered by the first PREFIX characters of their text, then
by its hash; a repeated row is followed by its copy; a single document is its own successor;
an empty table gives no row; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import SPACED, document_shingles, words
from .shared import partitions, range_number, slices, text_buffer

#: Hashes have 50 bits in a sketch; those below RANGE / SCALE are retained, in 48 bits.
BITS, SCALE, PREFIX = 50, 4, 64
LIMIT = (1 << BITS) // SCALE
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def sketches(texts: list[str]) -> list[np.ndarray]:
    """Retained hashes of each text, ascending."""
    _, _, hashes, pointers = words(*text_buffer(pa.array(texts, pa.large_string())), SPACED)
    sets, at = document_shingles(hashes, pointers, 5)
    sets = sets >> np.uint64(64 - BITS)
    below = np.concatenate([[0], np.cumsum(sets < np.uint64(LIMIT))])
    many = below[at[1:]] - below[at[:-1]]
    return [sets[a : a + max(int(n), min(1, int(b - a)))] for a, b, n in zip(at[:-1], at[1:], many)]


def fingerprint(sketch: np.ndarray) -> str:
    if len(sketch) and sketch[0] >= LIMIT:
        return f"~{int(sketch[0]):x}"
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def parse(text: str) -> np.ndarray:
    if text[:1] == "~":
        return np.array([int(text[1:], 16)], np.uint64)
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both documents' shingles together."""
    both = np.union1d(a, b)
    low = both[both < np.uint64(LIMIT)]
    return low if len(low) else both[:1]


def _shared(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    a, b = a[a < np.uint64(LIMIT)], b[b < np.uint64(LIMIT)]
    return len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has."""
    same, n, _ = _shared(a, b)
    return same / n if n else float(len(a) == 0 or bool(np.isin(a, b).all()))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    same, n, m = _shared(a, b)
    return same / (n + m - same) if n + m else float(np.array_equal(a, b))


def counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text (null: empty) and n: how many rows of a batch are alike in both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if pc.count_distinct(batch.column(0), mode="all").as_py() == batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.ones(batch.num_rows, np.int64))], ["doc_id", "text", "n"])
            else:
                found = pa.Table.from_batches([batch]).group_by(["doc_id", "text"]).aggregate([([], "count_all")])
                yield from found.select(["doc_id", "text", "count_all"]).rename_columns(["doc_id", "text", "n"]).combine_chunks().to_batches()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, n long")


def neighbours(docs: DataFrame, id_col: str, text_col: str, seed: int = 5) -> DataFrame:
    """Rows (part, tail, doc_id, text, n) of every range, in order: those of the range itself
    (tail 0), then the row that follows its last (tail 1). The first row of each range is
    sent to the range before it as well."""
    parts = partitions(docs.sparkSession)
    least_id = F.lit(-(1 << 63))
    own_id = F.coalesce(F.col(id_col).cast("long"), least_id)
    total, first_id = docs.agg(F.count(F.lit(1)), F.min(own_id)).first()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(own_id.alias("a"), F.substring(text, 1, PREFIX).alias("b"), F.xxhash64(text).alias("c"))
    # A sample of keys, bounded by the number of partitions; a cut is the key of a row.
    drawn = plain.where(F.rand(seed) * max(total, 1) < 16 * parts).collect()
    keys = sorted(tuple(x) for x in drawn)
    least = plain.where(F.col("a") == first_id).agg(F.min(F.struct("a", "b", "c"))).first()[0]
    cuts = sorted({keys[len(keys) * i // parts] for i in range(1, parts)} - {tuple(least)}) if keys else []

    rows = counted(docs, id_col, text_col)
    key = [F.coalesce("doc_id", least_id), F.substring("text", 1, PREFIX), F.xxhash64("text")]
    rows = rows.select("*", *(c.alias(f"k{i}") for i, c in enumerate(key)))
    key = [F.col(f"k{i}") for i in range(3)]
    rows = rows.withColumn("own", range_number(key, cuts))
    def is_row(values: list) -> Column:
        return reduce(and_, (k == v for k, v in zip(key, values)))

    begins = is_row([F.lit(x) for x in least]) if least else F.lit(False)
    if cuts:
        begins = begins | ((F.col("own") > 0) & is_row([F.get(F.array(*map(F.lit, (x[i] for x in cuts))), F.col("own") - 1) for i in range(3)]))
    home = lambda part, tail: F.struct(part.alias("part"), F.lit(tail).alias("tail"))
    mine, before = home(F.col("own"), 0), home(F.pmod(F.col("own") - 1, F.lit(len(cuts) + 1)), 1)
    placed = rows.select(F.explode(F.when(begins, F.array(mine, before)).otherwise(F.array(mine))).alias("home"), "doc_id", "text", "n", "k0", "k1", "k2")
    return placed.select("home.*", "doc_id", "text", "n", "k0", "k1", "k2").repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "tail", "k0", "k1", "k2").select("part", "tail", "doc_id", "text", "n")


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sketch of every document, of its edited text, and its likeness to that and to the
    next document in ascending order of id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, last = None, False, None  # last: (doc_id, text, sketch) that waits for its successor
        for batch in slices(batches, "text", 2 << 20):
            rows = zip(*(batch.column(i).to_pylist() for i in range(5)), sketches(batch.column(3).to_pylist()))
            pairs, times = [], []
            for p, tail, doc, text, n, sketch in rows:
                if p != part:
                    part, done, last = p, False, None
                if done:  # further rows alike to the successor
                    continue
                this = (doc, text, sketch)
                if last is not None:
                    pairs.append((last, this))
                    times.append(1)
                if n > 1 and not tail:
                    pairs.append((this, this))
                    times.append(n - 1)
                last, done = this, tail == 1
            if not pairs:
                continue
            edited = []
            for (_, text, _), (_, other, _) in pairs:
                half = len(text) // 2
                edited.append(text[: len(text) - half] + other[:half])
            marks = sketches(edited)
            columns = [
                pa.array([a[0] for a, _ in pairs], pa.int64()), pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                pa.array([fingerprint(a[2]) for a, _ in pairs], pa.string()), pa.array([fingerprint(m) for m in marks], pa.string()),
                pa.array([likeness(a[2], m) for (a, _), m in zip(pairs, marks)], pa.float64()), pa.array([likeness(a[2], b[2]) for a, b in pairs], pa.float64()),
            ]
            made = pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            yield made
            for at in np.flatnonzero(np.array(times) > 1):  # repeated rows, in short batches
                for left in range(times[at] - 1, 0, -1024):
                    yield made.take(pa.array(np.full(min(left, 1024), at)))

    return neighbours(docs, id_col, text_col).mapInArrow(run, OUT)
