"""Operator 7: benchmark decontamination by winnowing.

Of every window of `SPAN - GRAM + 1` consecutive GRAM-word hashes the least is kept as a
fingerprint, in documents and in benchmark items alike, so any shared span of SPAN words
shares a fingerprint. Documents' fingerprints are joined with those of the items; each hit
is extended to the SPAN-word windows around it, and a window that is one of an item marks
its words. Items of fewer than SPAN words, too short for the guarantee, are looked up as
one window of their own length at every position.

A benchmark of at most `block_bytes` of text, which is counted, is broadcast. A greater one is
joined in one pass over the documents: each window of a document carries its fingerprint, those
whose fingerprint a bit map of bounded size (`MAP_BITS`) excludes are left out, and the distinct
rest are joined with the benchmark's windows by fingerprint and window. What matched is joined
with the documents' windows in `SALTS` parts a window, so a passage of many documents is divided.
Words and windows are compared by 64 bits of hash.

Defined cases: null and empty texts have no words and no hits; very long texts are scanned
whole; items without words never
occur; items of one id count once, a null id as ''; repeated documents each keep their
row; empty tables give no row or no hits; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import ALNUM, shingles, words
from .shared import slices, text_buffer, written

SPAN, GRAM = 10, 5
MAP_BITS, SALTS = 1 << 27, 16
SPANS = "array<struct<start:int,stop:int>>"
WINDOWS = "array<struct<n:int,print:long,window:long,starts:array<int>>>"
SCANNED = f"row long, doc_id long, n_words long, hits {SPANS}, items array<string>"


def least_grams(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The start of every SPAN-word window of many word sequences, laid end to end in hashes,
    and the place of its leftmost least GRAM-word hash. No window crosses a sequence."""
    grams = shingles(hashes, GRAM)
    width = SPAN - GRAM + 1
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, width):
        less = grams[j : j + n] < best
        best[less] = grams[j : j + n][less]
        at[less] = np.flatnonzero(less) + j
    whole = np.zeros(n + 1, np.int64)  # windows that lie in one sequence
    for a, b in zip(starts[stops - starts >= SPAN], stops[stops - starts >= SPAN]):
        whole[a] += 1
        whole[b - SPAN + 1] -= 1
    inside = np.flatnonzero(np.cumsum(whole[:-1]) > 0)
    return inside, at[inside]


def winnow(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Places of the kept GRAM-word hashes."""
    return np.unique(least_grams(hashes, starts, stops)[1])


def windows_of(hashes: np.ndarray, pointers: np.ndarray, lengths: list[int], known: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: it, and text, start, fingerprint and hash of the windows of that many
    words whose fingerprint may be in the bit map. Windows of less than SPAN words are their
    own fingerprint."""
    owner = np.repeat(np.arange(len(pointers) - 1), np.diff(pointers))
    for n in lengths:
        if n == SPAN:
            at, least = least_grams(hashes, pointers[:-1], pointers[1:])
            prints = shingles(hashes, GRAM)[least]
        else:
            at = np.arange(max(0, len(hashes) - n + 1))
            at = at[owner[at] == owner[at + n - 1]]
            prints = shingles(hashes, n)[at]
        if known is not None:
            bit = prints & np.uint64(len(known) * 64 - 1)
            may = (known[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
            at, prints = at[may], prints[may]
        yield n, owner[at], at - pointers[owner[at]], prints, (shingles(hashes, n)[at] if len(at) else prints)


class Benchmark:
    """Fingerprints and windows of some items, as sorted arrays."""

    def __init__(self, ids: Sequence[str], texts: Sequence[str]):
        self.ids = ids
        _, _, hashes, pointers = words(*text_buffer(pa.array(texts, pa.large_string())), ALNUM)
        starts, stops = pointers[:-1], pointers[1:]
        at = winnow(hashes, starts, stops)
        self.prints = np.unique(shingles(hashes, GRAM)[at]) if len(at) else np.zeros(0, np.uint64)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({min(SPAN, int(b - a)) for a, b in zip(starts, stops)} - {0}):
            found = [(shingles(hashes[a:b], n), i) for i, (a, b) in enumerate(zip(starts, stops)) if b - a == n or b - a > n == SPAN]
            values = np.concatenate([h for h, _ in found])
            item = np.concatenate([np.full(len(h), i) for h, i in found])
            order = np.argsort(values, kind="stable")
            self.windows[n] = values[order], item[order]

    def scan(self, hashes: np.ndarray, pointers: np.ndarray) -> tuple[list[list[dict]], list[list[str]]]:
        """Hit spans and item ids of each document."""
        owner = np.repeat(np.arange(len(pointers) - 1), np.diff(pointers))
        seen: list[tuple[int, np.ndarray, np.ndarray]] = []  # length, window starts, window hashes
        if SPAN in self.windows:
            at = winnow(hashes, pointers[:-1], pointers[1:])
            at = at[np.isin(shingles(hashes, GRAM)[at], self.prints)] if len(at) else at
            around = np.unique((at[:, None] - np.arange(SPAN - GRAM + 1)).ravel())  # extend the hits
            around = around[(around >= 0) & (around + SPAN <= len(hashes))]
            around = around[owner[around] == owner[around + SPAN - 1]]
            if len(around):
                gathered = np.concatenate([hashes[a : a + SPAN] for a in around])
                seen.append((SPAN, around, shingles(gathered, SPAN)[::SPAN]))
        for n in self.windows:
            if n < SPAN and len(hashes) >= n:
                at = np.arange(len(hashes) - n + 1)
                at = at[owner[at] == owner[at + n - 1]]
                seen.append((n, at, shingles(hashes, n)[at]))
        marks = np.zeros(len(hashes) + 1, np.int64)
        items: list[set[str]] = [set() for _ in range(len(pointers) - 1)]
        for n, at, values in seen:
            known, item = self.windows[n]
            low, high = np.searchsorted(known, values), np.searchsorted(known, values, side="right")
            for i in np.flatnonzero(high > low):
                marks[at[i]] += 1
                marks[at[i] + n] -= 1
                items[owner[at[i]]].update(self.ids[x] for x in item[low[i] : high[i]])
        hit = np.cumsum(marks[:-1]) > 0
        first = np.zeros(len(hit), bool)  # documents' first words: a run of hits ends there
        first[pointers[:-1][np.diff(pointers) > 0]] = True
        before = np.concatenate([[False], hit[:-1]]) & ~first
        after = np.concatenate([hit[1:] & ~first[1:], [False]]) if len(hit) else hit
        starts, stops = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
        spans: list[list[dict]] = [[] for _ in items]
        for a, b in zip(starts.tolist(), stops.tolist()):
            d = int(owner[a])
            spans[d].append({"start": a - int(pointers[d]), "stop": b - int(pointers[d])})
        return spans, [sorted(x) for x in items]


def merged(starts: Column, stops: Column) -> Column:
    """Sorted, disjoint union of the spans of each row; spans that touch are one."""

    def one(a: np.ndarray, b: np.ndarray) -> list[dict]:
        order = np.argsort(a)
        a, high = a[order], np.maximum.accumulate(b[order])
        first = np.flatnonzero(np.concatenate([[True], a[1:] > high[:-1]]))
        last = np.append(first[1:], len(a)) - 1
        return [{"start": int(x), "stop": int(y)} for x, y in zip(a[first], high[last])]

    @F.pandas_udf(SPANS)
    def merge(starts: pd.Series, stops: pd.Series) -> pd.Series:
        return pd.Series([one(np.asarray(a), np.asarray(b)) for a, b in zip(starts, stops)], dtype=object)

    return merge(starts, stops)


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("item_text"))


def benchmark_bytes(items: DataFrame) -> int:
    return items.agg(F.coalesce(F.sum(F.octet_length("item_text") + F.octet_length("item")), F.lit(0))).first()[0]


def benchmark_windows(items: DataFrame) -> DataFrame:
    """n, print, window, item of every distinct window of every item, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "item_text"):
            _, _, hashes, pointers = words(*text_buffer(batch.column(1)), ALNUM)
            size = np.minimum(np.diff(pointers), SPAN)
            for n, owner, _, prints, window in windows_of(hashes, pointers, sorted(set(size.tolist()) - {0}), None):
                own = size[owner] == n
                yield pa.RecordBatch.from_arrays([pa.array(np.full(own.sum(), n, np.int32)), pa.array(prints[own].view(np.int64)), pa.array(window[own].view(np.int64)), batch.column(0).take(pa.array(owner[own]))], ["n", "print", "window", "item"])

    return written(items.mapInArrow(run, "n int, print long, window long, item string").distinct(), "benchmark-windows")


def print_map(known: DataFrame, total: int) -> np.ndarray:
    """A bit map of fingerprints with a bit for each byte of the benchmark, at most MAP_BITS;
    so what the driver gathers is bounded, and a fuller map excludes less."""
    bits = min(MAP_BITS, max(64, 1 << int(total).bit_length()))
    word = F.shiftrightunsigned(F.col("print").bitwiseAND(F.lit(bits - 1)), 6)
    rows = known.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(print & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def joined_contamination(text: DataFrame, items: DataFrame, total: int) -> DataFrame:
    """row, doc_id, n_words, hits and items of text (row, doc_id, text) by a join of windows."""
    known = benchmark_windows(items)
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())  # at most SPAN
    shared = text.sparkSession.sparkContext.broadcast(print_map(known, total))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("n", pa.int32()), ("print", pa.int64()), ("window", pa.int64()), ("starts", pa.list_(pa.int32()))]))
        for batch in slices(batches, "text"):
            _, _, hashes, pointers = words(*text_buffer(batch.column(2)), ALNUM)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for n, owner, start, prints, window in windows_of(hashes, pointers, lengths, shared.value):
                order = np.lexsort((start, window, owner))
                owner, start, prints, window = owner[order], start[order], prints[order].view(np.int64), window[order]
                first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (window[1:] != window[:-1])])) if len(order) else order
                for a, b in zip(first.tolist(), np.append(first[1:], len(order)).tolist()):
                    found[owner[a]].append({"n": n, "print": int(prints[a]), "window": int(window[a : a + 1].view(np.int64)[0]), "starts": start[a:b].astype(np.int32)})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(pointers)), pa.array(found, kind)], ["row", "doc_id", "n_words", "windows"])

    docs = written(text.mapInArrow(scan, f"row long, doc_id long, n_words long, windows {WINDOWS}"), "document-windows")
    key = ["n", "print", "window"]
    seen = docs.select("row", F.explode("windows").alias("w")).select("row", "w.*").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    # Distinct windows meet the benchmark first; the few that match go to every salt.
    matched = written(known.join(seen.select(*key).distinct(), key), "matched-windows").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    places = seen.join(matched.select(*key, "salt").distinct(), [*key, "salt"]).groupBy("row").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list(F.transform("starts", lambda x: x + F.col("n")))).alias("stops"))
    hits = places.select("row", merged(F.col("starts"), F.col("stops")).alias("hits"))
    items_of = seen.drop("starts").join(matched, [*key, "salt"]).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    whole = docs.drop("windows").join(hits, "row", "left").join(items_of, "row", "left")
    return whole.select("row", "doc_id", "n_words", F.coalesce("hits", F.array().cast(SPANS)).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _clean(shared):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string(), from_pandas=True)], ["text"])
        kept: list[bool] = []
        for part in slices(iter([batch]), "text", 2 << 20):
            _, _, hashes, pointers = words(*text_buffer(part.column(0)), ALNUM)
            kept += [not x for x in shared.value.scan(hashes, pointers)[0]]
        return pd.Series(kept, dtype=bool)

    return clean


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs, all columns, that no benchmark window occurs in."""
    items = _items(benchmark, item_col, item_text_col)
    total = benchmark_bytes(items)
    if total <= block_bytes:
        known = Benchmark(*zip(*items.collect())) if total else Benchmark([], [])
        return docs.where(_clean(docs.sparkSession.sparkContext.broadcast(known))(F.col(text_col).cast("string")))
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")), "contamination-rows")
    found = joined_contamination(rows.select("row", F.lit(None).cast("long").alias("doc_id"), F.col(f"doc.`{text_col}`").cast("string").alias("text")), items, total)
    return rows.join(found.where(F.size("hits") > 0).select("row"), "row", "left_anti").select("doc.*")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """row, doc_id, n_words, hits (disjoint word spans) and sorted item ids of every document."""
    text = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = _items(benchmark, item_col, item_text_col)
    total = benchmark_bytes(items)
    if total > block_bytes:
        return joined_contamination(text, items, total)
    shared = docs.sparkSession.sparkContext.broadcast(Benchmark(*zip(*items.collect())) if total else Benchmark([], []))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in slices(batches, "text"):
            _, _, hashes, pointers = words(*text_buffer(batch.column(2)), ALNUM)
            hits, found = shared.value.scan(hashes, pointers)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(pointers)), pa.array(hits, span), pa.array(found, pa.list_(pa.string()))], ["row", "doc_id", "n_words", "hits", "items"])

    return text.mapInArrow(scan, SCANNED)
