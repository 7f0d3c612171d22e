"""Vectorised hashing of words and shingles over the UTF-8 bytes of many texts."""

from __future__ import annotations

import numpy as np

U = np.uint64
BLOCK = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> U(31))
    x = x * U(0x9E3779B97F4A7C15)
    x = x ^ (x >> U(29))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


BASE = U(0x9E3779B97F4A7C55)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U(0xA24BAED4963EE407))
FOLDED_VALUES = BYTE_VALUES[FOLD]

#: `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM = np.ones(256, bool)
ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 1), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 4 * BLOCK:
            _powers[int(base)] = have
    return have[:n]


def words(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of many texts, A-Z lower-cased: byte starts, byte ends, 64-bit hashes, and
    pointers (words of text d are those from pointers[d] to pointers[d + 1])."""
    n = len(buf)
    inside = kind[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before &= ~edge[:-1]
        after &= ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # blocks of whole words keep the working arrays small
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, side="right")))
        low, high = int(starts[at]), int(ends[end - 1])
        values = np.zeros(high - low + 1, np.uint64)
        np.cumsum(FOLDED_VALUES[buf[low:high]] * powers(BASE, high - low), out=values[1:])
        s, e = starts[at:end] - low, ends[at:end] - low
        hashes[at:end] = (values[e] - values[s]) * powers(BASE_INVERSE, high - low + 1)[s]
        at = end
    hashes = mix(hashes ^ (ends - starts).astype(np.uint64))
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ hashes[j : j + n]) * U(0xC2B2AE3D27D4EB4F)
        out ^= out >> U(29)
    return mix(out ^ U(k))


def document_shingles(hashes: np.ndarray, pointers: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, sorted, and pointers to them. A document with
    fewer than k words, but not none, has its whole word sequence as its one shingle."""
    every = shingles(hashes, k)
    sets = []
    for a, b in zip(pointers[:-1], pointers[1:]):
        if b - a >= k:
            x = np.sort(every[a : b - k + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            sets.append(x[keep])
        else:
            sets.append(shingles(hashes[a:b], int(b - a)) if b > a else every[:0])
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else every[:0]), np.concatenate([[0], np.cumsum(lengths)])
