"""Operator 12: SentencePiece encoding by a prefix table of merges, and decoding.

A merge-type model joins neighbouring symbols, the best-scored piece first, until no pair is a
piece. Two pieces may stand side by side in a result exactly if their joined text is encoded as
these two, so every prefix of a text has one last piece: of the pieces that end there (found by
an automaton over the vocabulary) the one that fits the last piece of the prefix before it. The
table holds that piece for every prefix, and the ids are read from its end backwards.

No piece holds a letter before a blank, so a text is cut into words, and the ids of each
distinct word are found once and then looked up. The tables of all new words of a slice of
texts are filled together, one position at a time; long words, which are cut wherever no piece
holds the pair of neighbours, are filled alone. Characters outside the vocabulary become their
bytes.

Defined cases: null and empty texts give the begin and the end id; very long texts are encoded
whole (a word's table takes four bytes a character); ids may be null or repeated, and every row
is encoded; an empty table gives no row; other columns of the input are not read. Decoding keeps
the other columns; null ids are decoded as none, control ids give no text, bytes that are no
UTF-8 give U+FFFD each.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import slices

SPACE = "▁"
TAIL = ".,;:!?|#$%&*)\""
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
WORDS_KEPT = 200_000
PAIRS_KEPT = 200_000
SLOTS = 20
LONG = 48
ENCODED = "doc_id long, n_tokens long, ids binary"

_tables: dict[str, "PrefixTable"] = {}


def prefix_table(path: str) -> "PrefixTable":
    """One table a Python worker, kept between tasks."""
    if path not in _tables:
        _tables[path] = PrefixTable(path)
    return _tables[path]


class PrefixTable:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i)}
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        normal = [i for i in range(n) if i not in special and not model.is_byte(i)]
        probe = " a  B\t　ﬁ\n "
        if any(map(model.is_unused, normal)) or model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("a model with the identity normaliser and without unused pieces is needed")
        self.dtype = np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.ids = {self.text[i]: i for i in normal}
        self.score = {self.text[i]: model.get_score(i) for i in normal}
        self.pairs = {x[j : j + 2] for x in self.ids for j in range(len(x) - 1)}
        # Characters that only longer pieces hold are symbols of their own, without an id.
        self.text += sorted({c for x in self.ids for c in x} - set(self.ids))
        self.automaton = None
        self.fits: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.splits = not any(re.search(f"[^{SPACE}]{SPACE}", x) for x in self.ids)
        self.lines = self.splits and not any("\n" in x for x in self.ids)
        self._bytes = [b"" if i in special else x.replace(SPACE, " ").encode() for i, x in enumerate(self.text[:n])]
        for b, i in self.byte_ids.items():
            self._bytes[i] = bytes([b])
        if self.unknown >= 0:
            self._bytes[self.unknown] = model.decode([self.unknown]).encode()
        self.spelt = pa.array(self._bytes, pa.large_binary())
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(self.byte_ids.values())] = True
        self.control = np.zeros(n, bool)
        self.control[[i for i in special if i != self.unknown]] = True

    def _prepare(self) -> None:
        """What only encoding needs."""
        n = len(self._bytes)
        self.sizes = np.fromiter(map(len, self.text), np.int64, len(self.text))
        self.automaton = ahocorasick.Automaton()
        for i, x in enumerate(self.text):
            if x in self.ids or i >= n:
                self.automaton.add_word(x, i)
        self.automaton.make_automaton()
        alphabet = {c for x in self.text[n:] for c in x} | {c for x in self.ids for c in x}
        self.gap = next(chr(c) for c in range(0x110000) if chr(c) not in alphabet)
        self.slot_keys, self.slot_fits = np.full(1 << SLOTS, -1), np.zeros(1 << SLOTS, bool)

    def _merged(self, text: str) -> list[str]:
        """The symbols of a short text by merging: the best pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fit(self, before: int, piece: int) -> bool:
        """May piece follow before, or stand first (before is -1)?"""
        code = (before + 1 << 32) + piece
        found = self.fits.get(code)
        if found is None:
            wanted = [self.text[piece]] if before < 0 else [self.text[before], self.text[piece]]
            if len(self.fits) >= PAIRS_KEPT:
                self.fits.clear()
            found = self.fits[code] = self._merged("".join(wanted)) == wanted
        return found

    def _fit_all(self, before: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """_fit of many pairs, by a table of slots that later pairs overwrite."""
        codes = (before + 1 << 32) + pieces
        slots = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.int64)
        new = np.unique(codes[self.slot_keys[slots] != codes])
        out = self.slot_fits[slots]
        if len(new):
            fits = np.fromiter((self._fit((c >> 32) - 1, c & 0xFFFFFFFF) for c in new.tolist()), bool, len(new))
            unknown = np.flatnonzero(self.slot_keys[slots] != codes)
            out[unknown] = fits[np.searchsorted(new, codes[unknown])]
            self.slot_keys[slots[unknown]], self.slot_fits[slots[unknown]] = codes[unknown], out[unknown]
        return out

    def _run(self, text: str) -> list[int]:
        """The pieces of a text between two cuts."""
        last = array("i", [-1]) * (len(text) + 1)
        known, fit, size_of = self.fits, self._fit, self.sizes.item
        for end, piece in self.automaton.iter(text):
            if last[end + 1] < 0:
                before = last[end + 1 - size_of(piece)]
                fits = known.get((before + 1 << 32) + piece)
                if fit(before, piece) if fits is None else fits:
                    last[end + 1] = piece
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= size_of(last[at])
        return out[::-1]

    def _tables(self, words: list[str]) -> list[bytes | None]:
        """The ids of many short words; None for those with symbols outside the vocabulary."""
        joined = self.gap + self.gap.join(words) + self.gap
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        firsts = np.cumsum(lengths + 1) - lengths
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        local = np.arange(len(joined))  # places in a word
        local[1:] -= np.repeat(firsts, lengths + 1)
        gaps = np.zeros(len(joined), bool)
        gaps[0] = gaps[firsts + lengths] = True
        ends, pieces = found[np.argsort(local[found[:, 0]], kind="stable")].T
        last = np.full(len(joined), -1)
        cuts = np.searchsorted(local[ends], np.arange(lengths.max(initial=0) + 1))
        for a, b in zip(cuts, [*cuts[1:], len(ends)]):
            end, piece = ends[a:b], pieces[a:b]
            fits = self._fit_all(last[end - self.sizes[piece]], piece)
            last[end[fits]] = piece[fits]
        path = np.zeros(len(joined), bool)
        at = (firsts + lengths - 1)[lengths > 0]
        while len(at):  # from the last piece of each word backwards
            path[at] = True
            at = at - np.where(last[at] < 0, 1, self.sizes[last[at]])
            at = at[~gaps[at]]
        counts = np.concatenate([[0], np.cumsum(path)])
        ids = last[path].astype(self.dtype).tobytes()
        whole = np.ones(len(words), bool)
        n, width = len(self._bytes), self.dtype.itemsize
        odd = np.flatnonzero(path & ((last < 0) | (last >= n)))
        whole[np.searchsorted(firsts, odd, side="right") - 1] = False
        return [ids[a * width : b * width] if w else None for a, b, w in zip(counts[firsts].tolist(), counts[firsts + lengths].tolist(), whole.tolist())]

    def _word(self, text: str) -> bytes:
        """The ids of one word of any length and characters."""
        out: list[int] = []
        start = 0
        for i in range(1, len(text) + 1):
            if i < len(text) and text[i - 1 : i + 1] in self.pairs:
                continue
            part = text[start:i]
            start = i
            for piece in [self.ids.get(part, -1)] if len(part) == 1 else self._run(part):
                if 0 <= piece < len(self._bytes):
                    out.append(piece)
                    continue
                symbol = part if piece < 0 else self.text[piece]
                out += [self.byte_ids[b] for b in symbol.encode()] if self.byte_ids else [self.unknown]
        return np.array(out, self.dtype).tobytes()

    def _keys(self, text: str) -> list[str]:
        """The words of a text: "x" stands for a blank and x, the others for themselves."""
        if SPACE in text or "  " in text or text[0] == " " or not self.lines:
            whole = SPACE + text.replace(" ", SPACE)
            found = WORDS.findall(whole) if self.splits else [whole]
            return [x[1:] if x[1:2] not in ("", SPACE, "\n") else x for x in found]
        if text[0] == "\n":
            return [SPACE, *text.replace("\n", " \n")[1:].split(" ")]
        return text.replace("\n", " \n").split(" ")

    def _learn(self, keys: set[str]) -> None:
        """Find the ids of the words that are not known yet. Punctuation at their end that no
        piece joins to a letter is encoded apart."""
        words, older, pairs = self.words, self.older, self.pairs
        short, joined, line = set(), [], self._word("\n")
        for key in keys:
            ids = older.get(key)
            if ids is not None:
                words[key] = ids
                continue
            core = key.rstrip(TAIL)
            if core and core != key and core[-1] + key[len(core)] not in pairs:
                joined.append((key, core, key[len(core) :]))
                if core in words:
                    continue
                key = core
            if len(key) >= LONG:
                words[key] = self._word(key if key[0] in (SPACE, "\n") else SPACE + key)
            else:
                short.add(key)
        if short:
            texts = [x[1:] if x[:1] == "\n" else x if x[:1] == SPACE else SPACE + x for x in short]
            for key, text, ids in zip(short, texts, self._tables(texts)):
                first = line if key[:1] == "\n" else b""
                words[key] = first + (self._word(text) if ids is None else ids)
        for key, core, tail in joined:
            ids = self.tails.get(tail)
            if ids is None:
                if len(self.tails) > 10_000:
                    self.tails.clear()
                ids = self.tails[tail] = self._word(tail)
            words[key] = words[core] + ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text without begin and end, as little-endian integers of self.dtype."""
        if self.automaton is None:
            self._prepare()
        if len(self.words) > WORDS_KEPT:
            self.words, self.older = {}, self.words
        keys = [self._keys(x) if x else [] for x in texts]
        flat = list(chain.from_iterable(keys))
        ids = list(map(self.words.get, flat))
        new = [i for i, x in enumerate(ids) if x is None]
        if new:
            self._learn({flat[i] for i in new})
            for i in new:
                ids[i] = self.words[flat[i]]
        out, at = [], 0
        for x in keys:
            out.append(b"".join(ids[at : at + len(x)]))
            at += len(x)
        return out

    def decode(self, lists: list[np.ndarray]) -> list[str]:
        """The text of each list of ids."""
        ids = np.concatenate([*lists, np.zeros(0, np.uint32)])
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
        joined = self.spelt.take(pa.array(ids)).buffers()
        at = np.frombuffer(joined[1], np.int64)[bounds].tolist() if len(ids) else [0] * len(bounds)
        data = memoryview(joined[2]) if len(ids) and joined[2] is not None else b""
        shown = np.flatnonzero(~self.control[ids])
        first, after = np.searchsorted(shown, bounds[:-1]).tolist(), np.searchsorted(shown, bounds[1:]).tolist()
        out = []
        for i, (low, high) in enumerate(zip(first, after)):
            if low == high:
                out.append("")
                continue
            # Encoding has added the blank of the first piece.
            start = at[i] + self.text[ids[shown[low]]].startswith(SPACE)
            try:
                if shown[high - 1] - shown[low] == high - low - 1:  # else control ids part runs of bytes
                    out.append(bytes(data[start : at[i + 1]]).decode())
                    continue
            except UnicodeDecodeError:
                pass
            parts = [self._bytes[x] for x in lists[i].tolist()]
            parts[shown[low] - bounds[i]] = parts[shown[low] - bounds[i]][start - at[i] :]
            out.append(self._mend(parts, self.is_byte[lists[i]].tolist()))
        return out

    @staticmethod
    def _mend(parts: list[bytes], is_byte: list[bool]) -> str:
        """Text where bytes of some run of byte ids are no UTF-8: each of them is U+FFFD."""
        out, run = [], b""
        for part, byte in [*zip(parts, is_byte), (b"", False)]:
            if byte:
                run += part
                continue
            while run:
                for n in range(1, 5):
                    try:
                        out.append(run[:n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�")
                run = run[n:]
            out.append(part.decode())
        return "".join(out)

    def rest(self) -> None:
        """At the end of a task: the worker lives on, and keeps the recent words only."""
        self.older = {}


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids (little-endian uint32) with the begin and the end id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(model)
        first, last = (np.array([x], "<u4").tobytes() for x in (table.begin, table.end))
        for batch in slices(batches, "text", 2 << 20):
            ids = [first + np.frombuffer(x, table.dtype).astype("<u4").tobytes() + last for x in table.encode(batch.column(1).to_pylist())]
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])
        table.rest()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, ENCODED)


def decode_pieces(rows: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """rows with the column of ids replaced by their text; an older column of that name goes."""
    kept = [f for f in rows.schema.fields if f.name not in (ids_col, text_col)]
    schema = T.StructType([*kept, T.StructField(text_col, T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(model)
        for batch in slices(batches, "ids", 4 << 20):
            texts = table.decode([np.frombuffer(x.as_py() or b"", "<u4") for x in batch.column(len(kept))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [f.name for f in schema.fields])

    own = [F.col(f"`{f.name}`") for f in kept]
    named = [f"c{i}" for i in range(len(kept))]
    return rows.select(*(c.alias(n) for c, n in zip(own, named)), F.col(f"`{ids_col}`").cast("binary").alias("ids")).mapInArrow(decode, schema)
