"""Operator 8: removal of long byte strings that an earlier document holds too.

Every window of LEAST bytes has an anchor: the least hash of its GRAM-byte substrings.
Equal windows have equal anchors, so windows are dealt out by anchor and equal ones meet.
Consecutive windows with one anchor form a segment. The job has five steps:

1. Each task of the scan stores its texts once, in an Arrow file of chunks of about CHUNK
   bytes. Texts are never shuffled: later steps deal out small records by chunk and read
   the chunk's texts from its file. A place is a chunk and a byte position in it.
2. Each chunk lists its segments: anchor, hash of the segment's bytes, place. Of equal
   segments in one chunk only those of the least id go on; the others are decided
   (removed), which thins out hot passages before the shuffle. An anchor that still has
   over CROWD segments in one chunk is hot: its segments skip step 3, which gets one note
   of it instead, so step 3 sees at most CROWD segments of an anchor from each chunk.
3. Dealt by anchor: segments equal to one of a smaller id are removed; where an anchor has
   different segments in several documents, those of the least ids need their bytes.
4. Dealt by chunk: the bytes of these few segments are cut from the texts. Segments of a
   hot anchor, noted or with over HOT different segments, are cut into their single
   windows, dealt by the windows' own bytes. Of equal windows in one portion only those of
   the least id go on, the others are removed.
5. Dealt by anchor again: a suffix array of the segments by two-stage sorting (suffixes
   smaller than their successors are sorted directly, the others are induced by scanning
   the buckets of first bytes), and common prefixes of neighbours. Neighbours that share
   LEAST bytes form runs; windows of other than a run's least id are removed. The single
   windows of hot anchors need no suffix array and are sorted by their bytes.

The removed spans are then dealt by chunk to the texts. Records travel as packed,
compressed columns, one row for each chunk and part, so no step makes more rows than
chunks times parts; there is a part for every PART bytes of text at least. Segment equality
in steps 2 and 3 is by 64 hash bits among the segments of an anchor (48 bits), windows are
compared byte by byte.

Defined cases: null and empty texts have no bytes; a text of any length is worked through
in blocks; rows of one id never remove from each other; rows with a null id neither lose
nor remove bytes; an empty table gives no row; other columns of the input are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import BASE, BASE_INVERSE, BYTE_VALUES, mix, powers
from .shared import file_system, partitions, slices, text_buffer, work_path, written

LEAST, GRAM, HOT, CROWD = 50, 16, 4096, 32
BLOCK = 1 << 20
CHUNK = 4 << 20
PORTION = 1 << 20
PART = 12 << 20
BLOB = "part int, chunk long, kind int, blob binary"
#: Kinds of rows: listed segments, removed spans, asked segments, cut segments, cut single
#: windows, and the file and batch of a chunk, which sort after all else of that chunk.
LISTED, REMOVED, ASKED, CUT, SINGLE, PLACE = 0, 1, 2, 3, 4, 9


# Packed columns.

def pack(steady: Sequence[np.ndarray], random: Sequence[np.ndarray] = ()) -> bytes:
    """Columns of 64-bit integers, split into byte planes and compressed; of the steady ones
    the differences."""
    planes = [np.array([len(steady[0]), len(steady)], "<i8").view(np.uint8)]
    for i, c in enumerate([*steady, *random]):
        z = c.astype("<i8")
        if i < len(steady):
            d = np.diff(z, prepend=np.int64(0))
            z = (d << 1) ^ (d >> 63)
        planes.append(np.ascontiguousarray(z.view(np.uint8).reshape(-1, 8).T).ravel())
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes).tobytes())


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, steady = raw[:16].view("<i8").tolist()
    out = []
    for i, at in enumerate(range(16, len(raw), 8 * n) if n else ()):
        z = np.ascontiguousarray(raw[at : at + 8 * n].reshape(8, n).T).view("<i8").ravel()
        out.append(np.cumsum((z.view("<u8") >> np.uint64(1)).view("<i8") ^ -(z & 1)) if i < steady else z)
    return out


def with_bytes(columns: bytes, raw: bytes) -> bytes:
    return len(columns).to_bytes(4, "little") + columns + zstandard.ZstdCompressor(level=1).compress(raw)


def apart(blob: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    return unpack(blob[4 : 4 + n]), np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4 + n :]), np.uint8)


def groups(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of key and where it is, in order."""
    order = np.argsort(key, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        if len(some):
            yield int(key[some[0]]), some


def rows_of(found: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    part, chunk, kind, blob = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(chunk, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["part", "chunk", "kind", "blob"])


def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns[:3]), (b.as_py() for b in batch.column(3)))


def removed(parts: int, chunk: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """Rows of removed spans, which go to their chunks."""
    return [(c % parts, c, REMOVED, pack(joined_runs(start[some], stop[some]))) for c, some in groups(chunk)]


def joined_runs(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans in order; spans that only touch, as those of two texts may, stay apart."""
    order = np.argsort(start, kind="stable")
    start, high = start[order], np.maximum.accumulate(stop[order])
    lead = np.ones(len(start), bool)
    lead[1:] = start[1:] >= high[:-1]
    return start[lead], high[np.append(np.flatnonzero(lead)[1:] - 1, len(start) - 1)] if len(start) else high


# Step 1.

TEXTS = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string())])


def store_texts(docs: DataFrame) -> DataFrame:
    """Store doc_id and text of docs in Arrow files, one a task, and return the chunks they
    hold as rows of kind PLACE. An attempt writes a file of its own, and only the rows of
    attempts that succeed are kept."""
    top = work_path(docs.sparkSession, "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = file_system(top)
        files.create_dir(folder, recursive=True)
        task = TaskContext.get().partitionId()
        name = f"{task:06d}-{uuid.uuid4().hex}.arrow"
        found = []
        with files.open_output_stream(f"{folder}/{name}") as sink, pa.ipc.new_file(sink, TEXTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for batch in gathered(slices(batches, "text", CHUNK), CHUNK):
                out.write_batch(batch)
                chunk = len(found) << 32 | task
                found.append((0, chunk, PLACE, f"{len(found)} {top}/{name}".encode()))
        if found:
            yield rows_of(found)

    return written(docs.mapInArrow(run, BLOB), "chunks")


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to at most that many bytes of text, if one does not hold more."""
    def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(held).cast(TEXTS).combine_chunks().to_batches()[0]

    held, size = [], 0
    for batch in batches:
        n = batch.column(1).nbytes
        if held and size + n > most:
            yield one(held)
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield one(held)


class Chunks:
    """Reads chunks; the file of the last one stays open."""

    def __init__(self):
        self.path = self.file = None

    def read(self, place: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Ids, bytes of all texts, and where each begins."""
        at, path = place.decode().split(" ", 1)
        if path != self.path:
            files, name = file_system(path)
            self.path, self.file = path, pa.ipc.open_file(files.open_input_file(name))
        batch = self.file.get_batch(int(at))
        return batch.column(0), *text_buffer(batch.column(1))


def by_chunk(records: DataFrame, chunks: DataFrame, parts: int) -> DataFrame:
    """Records and places of chunks, dealt by chunk; the place follows the chunk's records."""
    part = F.pmod("chunk", F.lit(parts)).cast("int")
    return records.unionAll(chunks).withColumn("part", part).repartitionById(parts, "part").sortWithinPartitions("chunk", "kind")


def columns_by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], bytes]]:
    """Each chunk, the columns of all its records (none: an empty list) and its place."""
    held: list[list[np.ndarray]] = []
    for _, chunk, kind, blob in rows_in(batches):
        if kind == PLACE:
            yield chunk, [np.concatenate(c) for c in zip(*held)], blob
            held = []
        else:
            held.append(unpack(blob))


# Step 2.

def segments(buf: np.ndarray, offsets: np.ndarray) -> Iterator[list[np.ndarray]]:
    """doc, start (in buf), windows, anchor (48 bits), content (64 bits) of every segment,
    by blocks of the buffer."""
    for at in range(0, max(0, len(buf) - LEAST + 1), BLOCK):
        part = buf[at : at + BLOCK + LEAST - 1]
        n = len(part)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[part] * powers(BASE, n), out=sums[1:])
        inverse = powers(BASE_INVERSE, n + 1)
        least = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
        width, span = LEAST - GRAM + 1, 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: span - width], least[width - span :])
        doc = np.searchsorted(offsets, at + np.arange(len(least), dtype=np.int64), side="right") - 1
        inside = at + np.arange(len(least)) + LEAST <= offsets[doc + 1]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        cut = np.flatnonzero(new | ~inside)
        windows = np.diff(np.append(cut, len(least)))
        windows, cut = windows[inside[cut]], cut[inside[cut]]
        content = mix((sums[cut + windows + LEAST - 1] - sums[cut]) * inverse[cut] + windows.astype(np.uint64))
        yield [doc[cut], cut + at, windows, (least[cut] >> np.uint64(16)).astype(np.int64), content.astype(np.int64)]


def list_segments(chunks: DataFrame, parts: int) -> DataFrame:
    """LISTED rows (start, windows, id, anchor, content), dealt by anchor, a hot anchor's note
    having no windows; REMOVED rows (start, stop); ASKED rows of anchors hot in a chunk, as in
    compare_segments. The last two go to any part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Chunks()
        for _, chunk, _, place in rows_in(batches):
            ids, buf, offsets = files.read(place)
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            held, size = [], 0
            for doc, *rest in segments(buf, offsets):
                some = known[doc]
                held.append([c[some] for c in (ids[doc], *rest)])
                size += BLOCK
                if size >= CHUNK:  # a chunk of one very long text
                    yield from listed(chunk, held)
                    held, size = [], 0
            if held:
                yield from listed(chunk, held)

    def listed(chunk: int, held: list) -> Iterator[pa.RecordBatch]:
        ids, start, windows, anchor, content = (np.concatenate(c) for c in zip(*held))
        if not len(ids):
            return
        order = np.argsort(mix(anchor.astype(np.uint64) ^ mix(content.astype(np.uint64))), kind="stable")
        other = np.ones(len(order), bool)
        other[1:] = (anchor[order[1:]] != anchor[order[:-1]]) | (content[order[1:]] != content[order[:-1]])
        least = np.minimum.reduceat(ids[order], np.flatnonzero(other))
        gone = np.zeros(len(order), bool)
        gone[order] = ids[order] > least[np.cumsum(other) - 1]
        left = np.flatnonzero(~gone)
        anchors, of, many = np.unique(anchor[left], return_inverse=True, return_counts=True)
        crowded = (many > CROWD)[of]
        cool, hot, noted = left[~crowded], left[crowded], anchors[many > CROWD]
        none = np.zeros(len(noted), np.int64)
        columns = [np.append(c[cool], x) for c, x in zip((start, windows, ids, anchor, content), (none, none, none, noted, none))]
        found = [(p, chunk, LISTED, pack([c[some] for c in columns[:3]], [c[some] for c in columns[3:]])) for p, some in groups(columns[3] % parts)]
        if len(hot):
            found.append((chunk % parts, chunk, ASKED, pack([start[hot], windows[hot], np.ones(len(hot), np.int64)], [anchor[hot]])))
        if gone.any():
            a, b = joined_runs(start[gone], (start + windows + LEAST - 1)[gone])
            found.append((chunk % parts, chunk, REMOVED, pack([a, b])))
        yield rows_of(found)

    return chunks.withColumn("part", F.pmod("chunk", F.lit(parts)).cast("int")).repartitionById(parts, "part").mapInArrow(run, BLOB)


# Step 3.

def compare_segments(listed: DataFrame, parts: int) -> DataFrame:
    """REMOVED rows (start, stop) and ASKED rows: segments whose bytes are needed (start,
    windows, hot, anchor). Rows of these kinds in listed are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in rows_in(batches):
            if row[2] == LISTED:
                columns = unpack(row[3])
                held.append([np.full(len(columns[0]), row[1]), *columns])
            else:
                yield rows_of([row])
        if not held:
            return
        chunk, start, windows, ids, anchor, content = (np.concatenate(c) for c in zip(*held))
        held.clear()
        noted = np.unique(anchor[windows == 0])
        order = np.flatnonzero(windows > 0)
        if not len(order):
            return
        order = order[np.lexsort((content[order], anchor[order]))]
        chunk, start, windows, ids, anchor, content = (c[order] for c in (chunk, start, windows, ids, anchor, content))
        first = np.ones(len(order), bool)
        first[1:] = anchor[1:] != anchor[:-1]
        other = first.copy()
        other[1:] |= content[1:] != content[:-1]
        gone = ids > np.minimum.reduceat(ids, np.flatnonzero(other))[np.cumsum(other) - 1]
        begin = np.flatnonzero(first)
        contents = np.add.reduceat(other.astype(np.int64), begin)
        several = np.minimum.reduceat(ids, begin) < np.maximum.reduceat(ids, begin)
        anchor_no = np.cumsum(first) - 1
        known = np.isin(anchor[begin], noted)
        asked = np.flatnonzero(~gone & ((contents > 1) & several | known)[anchor_no])
        hot = ((contents > HOT) | known)[anchor_no].astype(np.int64)
        found = removed(parts, chunk[gone], start[gone], (start + windows + LEAST - 1)[gone])
        for c, some in groups(chunk[asked]):
            some = asked[some]
            some = some[np.argsort(start[some])]
            found.append((c % parts, c, ASKED, pack([start[some], windows[some], hot[some]], [anchor[some]])))
        if found:
            yield rows_of(found)

    return listed.repartitionById(parts, "part").mapInArrow(run, BLOB)


# Step 4.

def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


def cut_segments(asked: DataFrame, chunks: DataFrame, parts: int) -> DataFrame:
    """CUT rows: start, windows, id, anchor of asked segments and their bytes, dealt by
    anchor; SINGLE rows: start, id of single windows and their bytes, dealt by these; REMOVED
    rows (start, stop)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Chunks()
        for chunk, columns, place in columns_by_chunk(batches):
            if not columns:
                continue
            ids, buf, offsets = files.read(place)
            order = np.argsort(columns[0], kind="stable")
            start, windows, hot, anchor = (c[order] for c in columns)
            owner = ids.fill_null(0).to_numpy()[np.searchsorted(offsets, start, side="right") - 1]
            cool = hot == 0
            found = []
            for p, some in groups(anchor[cool] % parts):
                some = np.flatnonzero(cool)[some]
                raw = buf[ragged(start[some], windows[some] + LEAST - 1)].tobytes()
                found.append((p, chunk, CUT, with_bytes(pack([start[some], windows[some], owner[some]], [anchor[some]]), raw)))
            if found:
                yield rows_of(found)
            each = np.flatnonzero(~cool)
            for some in np.split(each, np.flatnonzero(np.diff(np.cumsum(windows[each]) // (PORTION // 4))) + 1):
                if len(some):
                    yield rows_of(single(chunk, buf, ragged(start[some], windows[some]), np.repeat(owner[some], windows[some])))

    def single(chunk: int, buf: np.ndarray, start: np.ndarray, owner: np.ndarray) -> list:
        values = np.zeros(len(start), np.uint64)
        for j in range(LEAST):
            values = (values ^ BYTE_VALUES[buf[start + j]]) * np.uint64(0x9E3779B97F4A7C15)
        values = mix(values)
        order = np.argsort(values, kind="stable")
        same = shared_windows(buf, start[order], LEAST)
        gone = np.zeros(len(order), bool)
        gone[order] = owner[order] > np.minimum.reduceat(owner[order], np.flatnonzero(~same))[np.cumsum(~same) - 1]
        found = []
        if gone.any():
            found.append((chunk % parts, chunk, REMOVED, pack(joined_runs(start[gone], start[gone] + LEAST))))
        left = np.flatnonzero(~gone)
        for p, some in groups((values[left] % np.uint64(parts)).astype(np.int64)):
            some = left[some]
            found.append((p, chunk, SINGLE, with_bytes(pack([start[some], owner[some]]), buf[ragged(start[some], np.full(len(some), LEAST))].tobytes())))
        return found

    return by_chunk(asked, chunks, parts).mapInArrow(run, BLOB)


# Step 5.

def word_at(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a big-endian integer."""
    out = np.zeros(len(at), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[at + j]
    return out


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of text, ordered by the bytes from there on; bytes after `depth` need not count."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    # A suffix is smaller than its successor if, after its run of equal bytes, a greater one follows.
    change = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    after = np.append(text, 0)[change + 1] > text[change]
    small = np.repeat(after, np.diff(np.append(-1, change)))
    direct = np.flatnonzero(small)
    key = word_at(padded, direct)
    order = np.argsort(key, kind="stable")
    direct, key = direct[order], key[order]
    tied = np.zeros(len(direct), bool)
    rank = np.zeros(len(direct), np.int64)

    def mark(lead: np.ndarray) -> None:
        nonlocal tied, rank
        rank = np.cumsum(lead)
        tied = ~lead
        tied[:-1] |= ~lead[1:]

    lead = np.ones(len(direct), bool)
    lead[1:] = key[1:] != key[:-1]
    for more in range(8, depth, 8):
        mark(lead)
        some = np.flatnonzero(tied)
        if not len(some):
            break
        key = word_at(padded, direct[some] + more)
        order = np.lexsort((key, rank[some]))
        direct[some] = direct[some][order]
        key, group = key[order], rank[some][order]
        lead[some[1:]] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
    # Induce the others: scanning the buckets of first bytes in order, each suffix places
    # the one before it at the front of that one's bucket, if it is not placed yet.
    sizes = np.bincount(text, minlength=256)
    heads = np.cumsum(sizes) - sizes
    out = np.full(n, -1, np.int64)
    first = text[direct]
    tails = heads + sizes - np.bincount(first, minlength=256)
    begins = np.searchsorted(first, np.arange(256))
    out[tails[first] + np.arange(len(direct)) - begins[first]] = direct
    free = heads.copy()

    def place(wave: np.ndarray, bucket: int) -> np.ndarray:
        """Place the predecessors of wave; return those that fall into its own bucket."""
        wave = wave[wave > 0] - 1
        wave = wave[~small[wave]]
        byte = text[wave]
        order = np.argsort(byte, kind="stable")
        wave, byte = wave[order], byte[order]
        begins = np.searchsorted(byte, np.arange(257))
        out[free[byte] + np.arange(len(wave)) - begins[byte]] = wave
        free[:] += np.diff(begins)
        return wave[byte == bucket]

    last = np.array([n])  # the empty suffix comes before all
    place(last, -1)
    for bucket in np.flatnonzero(sizes).tolist():
        wave = out[heads[bucket] : free[bucket]]
        while len(wave):
            wave = place(wave, bucket)
        place(out[tails[bucket] : heads[bucket] + sizes[bucket]], -1)
    return out


def shared_windows(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Which neighbours in order have at least `least` leading bytes in common."""
    padded = np.concatenate([text, np.zeros(least + 16, np.uint8)])
    live = np.arange(1, len(order))
    for at in [*range(0, least - 8, 8), least - 8]:
        live = live[word_at(padded, order[live] + at) == word_at(padded, order[live - 1] + at)]
    out = np.zeros(len(order), bool)
    out[live] = True
    return out


def match_segments(cut: DataFrame, parts: int) -> DataFrame:
    """REMOVED rows (start, stop) of cut segments and windows; those in cut are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {CUT: [], SINGLE: []}
        for row in rows_in(batches):
            if row[2] in held:
                columns, raw = apart(row[3])
                held[row[2]].append(([np.full(len(columns[0]), row[1]), *columns], raw))
            else:
                yield rows_of([row])
        for kind, test in ((CUT, in_portions), (SINGLE, equal_windows)):
            if held[kind]:
                columns = [np.concatenate(c) for c in zip(*(h[0] for h in held[kind]))]
                raw = np.concatenate([h[1] for h in held.pop(kind)])
                for found in test(columns, raw):
                    if found:
                        yield rows_of(found)

    def equal_windows(columns: list[np.ndarray], raw: np.ndarray) -> Iterator[list]:
        chunk, start, ids = columns
        padded = np.concatenate([raw, np.zeros(16, np.uint8)])
        at = np.arange(len(ids)) * LEAST
        order = np.lexsort([word_at(padded, at + j) for j in [*range(0, LEAST - 8, 8), LEAST - 8]])
        same = shared_windows(raw, at[order], LEAST)
        gone = order[ids[order] > np.minimum.reduceat(ids[order], np.flatnonzero(~same))[np.cumsum(~same) - 1]]
        yield removed(parts, chunk[gone], start[gone], start[gone] + LEAST)

    def in_portions(columns: list[np.ndarray], raw: np.ndarray) -> Iterator[list]:
        """Anchors are independent, so a part is taken in portions of whole anchors."""
        chunk, start, windows, ids, anchor = columns
        length = windows + LEAST - 1
        begin = np.cumsum(length) - length
        portions = -(-len(raw) // PORTION)
        for _, some in groups((mix(anchor.astype(np.uint64)) % np.uint64(portions)).astype(np.int64)):
            yield match(chunk[some], start[some], windows[some], ids[some], raw[ragged(begin[some], length[some])])

    def match(chunk: np.ndarray, start: np.ndarray, windows: np.ndarray, ids: np.ndarray, raw: np.ndarray) -> list:
        length = windows + LEAST - 1
        # A separating byte ends each segment; other bytes move up by one, 255 does not
        # occur in UTF-8.
        text = np.zeros(len(raw) + len(ids), np.uint8)
        begin = np.cumsum(length + 1) - length - 1
        text[ragged(begin, length)] = raw + np.uint8(1)
        order = suffix_array(text, LEAST)
        segment = np.repeat(np.arange(len(ids)), length + 1)
        offset = np.arange(len(text)) - begin[segment]
        order = order[offset[order] < windows[segment[order]]]  # windows only
        same = shared_windows(text, order, LEAST)
        owner = ids[segment[order]]
        gone = order[owner > np.minimum.reduceat(owner, np.flatnonzero(~same))[np.cumsum(~same) - 1]]
        gone.sort()
        if not len(gone):
            return []
        lead = np.ones(len(gone), bool)
        lead[1:] = np.diff(gone) > 1
        a, b = gone[lead], gone[np.append(np.flatnonzero(lead)[1:] - 1, len(gone) - 1)]
        s = segment[a]
        return removed(parts, chunk[s], start[s] + offset[a], start[s] + offset[b] + LEAST)

    return cut.repartitionById(parts, "part").mapInArrow(run, BLOB)


KEPT = "doc_id long, n_bytes long, spans array<struct<start:int,stop:int>>, kept binary"


def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each chunk without its removed spans."""
    files = Chunks()
    for _, columns, place in columns_by_chunk(batches):
        ids, buf, offsets = files.read(place)
        start, stop = joined_runs(*(columns or [np.zeros(0, np.int64)] * 2))
        doc = np.searchsorted(offsets, start, side="right") - 1
        lead = np.ones(len(start), bool)
        lead[1:] = (start[1:] > stop[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(lead)
        start, stop, doc = start[first], stop[np.append(first[1:], len(start)) - 1] if len(first) else stop, doc[first]
        gone = np.zeros(len(buf) + 1, np.int8)
        gone[start] += 1
        gone[stop] -= 1
        left = np.cumsum(gone[:-1], dtype=np.int8) == 0
        ends = offsets - np.concatenate([[0], np.cumsum(np.bincount(doc, stop - start, len(ids)))]).astype(np.int64)
        spans = pa.StructArray.from_arrays([pa.array((x - offsets[doc]).astype(np.int32)) for x in (start, stop)], ["start", "stop"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(ids) + 1)).astype(np.int32)), spans)
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(buf[left].tobytes())])
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offsets)), lists, kept.cast(pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed byte runs) and kept bytes of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chunks = store_texts(rows)
    parts = max(partitions(spark), -(-chunks.count() * CHUNK // PART))
    compared = written(compare_segments(list_segments(chunks, parts), parts), "compared")
    matched = match_segments(cut_segments(compared.where(F.col("kind") == ASKED), chunks, parts), parts)
    return by_chunk(compared.where(F.col("kind") == REMOVED).unionAll(matched), chunks, parts).mapInArrow(cover, KEPT)
