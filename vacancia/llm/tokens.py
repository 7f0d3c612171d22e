"""Token ids of whole texts by a public byte-level tokenizer, with a cache of word pieces.

Such a tokenizer splits a text before every run of white space, and between letters and
the punctuation after them, so the ids of a text are the ids of its pieces one after the
other. Words repeat, hence each distinct piece is encoded once by the tokenizers library
and then looked up. Texts for which that split is not certain (rare white space, added
tokens, or another kind of tokenizer) are encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

PIECES_KEPT = 350_000
RARE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　\r\t]")
PIECES = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
RUNS = ("  ", "\n\n", " \n", "\n ")
TAIL = ".,;:!?|#$%&*)\""

_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """One encoder a Python worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Pieces(dict):
    """Ids by piece: "x" stands for " x", and what begins with white space for itself. Pieces
    not met since the last time it was full are forgotten, so it holds 2 * PIECES_KEPT at most."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(self) >= PIECES_KEPT:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.splits = isinstance(self.library.pre_tokenizer, pre_tokenizers.ByteLevel) and self.library.normalizer is None
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.pieces = Pieces(self._piece)
        self.tails: dict[str, bytes] = {}
        self.feed = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _word(self, text: str) -> bytes:
        """One word, with or without the blank before it, straight from the model."""
        return np.array([t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.alphabet))], self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece[:1] == "\n" and piece[1:].isalpha():
            return self.feed + self._word(piece[1:])
        word = piece.rstrip(TAIL)
        if not word.isalpha():
            return self._whole(piece if piece[:1] in " \n" else f" {piece}")
        if word == piece:
            return self._word(f" {piece}")
        tail = piece[len(word) :]
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[tail] = self._whole(tail)
        return self.pieces[word] + self.tails[tail]

    def _split(self, text: str) -> list[str] | None:
        """Its pieces, the first with a line feed before it, or None if it must be encoded whole."""
        if not self.splits or RARE.search(text) or text[0] in " \n" or any(x in text for x in self.added):
            return None
        if text[-1] in " \n" or any(x in text for x in RUNS):
            found = PIECES.findall("\n" + text)
            return [x[1:] if x[0] == " " and x[1:2] not in ("", " ", "\n") else x for x in found]
        return ("\n" + text.replace("\n", " \n")).split(" ")

    def rest(self) -> None:
        """At the end of a task: the worker lives on, and keeps the recent pieces only."""
        self.pieces.older = {}

    def encode(self, text: str | None) -> bytes:
        """Its ids as little-endian integers of self.dtype; null and '' give b''."""
        if not text:
            return b""
        found = self._split(text)
        if found is None:
            return self._whole(text)
        return b"".join(map(self.pieces.__getitem__, found))[len(self.feed) :]
