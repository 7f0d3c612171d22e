"""Operators 11 and 12 against the libraries and a plain rendering of their rules."""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vacancia.llm import alignment, queries, sentencepieces
from vacancia.llm.queries import bpe_path, piece_path
from vacancia.llm.shared import written

from ..conftest import SF

PARTS = ["a", "Word", " ", "  ", "\n", "\t", ".", ",", "é", "漢", "12", "▁", "<s>", "<0x41>", "<|endoftext|>", "the", "   ", "ing", "\r\n", "\x00", "😀", "ﬁ", "x" * 60, "ation.&&&", "\x1c", " ", "'s"]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=12).map("".join)
ODD = [(200, " leading and trailing "), (201, "has ▁ in it"), (202, "<|endoftext|><s></s>"), (203, "naïve ﬁne 漢字 😀\n\n  x\ty"), (204, "y" * 5000), (205, "\n"), (206, " "), (207, "ab\n  cd")]


@cache
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(bpe_path()), SentencePieceProcessor(model_file=piece_path())
    a.encode_special_tokens = True
    return a, b


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_pieces_equal_the_library(texts):
    table, library = sentencepieces.prefix_table(piece_path()), libraries()[1]
    got = [np.frombuffer(x, table.dtype) for x in table.encode(texts)]
    assert [x.tolist() for x in got] == [library.encode(t) for t in texts]
    assert table.decode([x.astype(np.uint32) for x in got]) == [library.decode(x.tolist()) for x in got]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999)), max_size=8), max_size=4))
def test_decoding_of_any_ids(lists):
    table, library = sentencepieces.prefix_table(piece_path()), libraries()[1]
    assert table.decode([np.array(x, np.uint32) for x in lists]) == [library.decode(x) for x in lists]


def test_bounded_tables_stay_right(monkeypatch):
    """Words, pairs and slots that are forgotten all the time change nothing."""
    for name, value in (("WORDS_KEPT", 3), ("PAIRS_KEPT", 2), ("SLOTS", 2), ("LONG", 6)):
        monkeypatch.setattr(sentencepieces, name, value)
    table, library = sentencepieces.PrefixTable(piece_path()), libraries()[1]
    texts = ["several words that come again and again", "again several other words, longer words", "", "ünusual wörds\nand lines"]
    for _ in range(3):
        assert [np.frombuffer(x, table.dtype).tolist() for x in table.encode(texts)] == [library.encode(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_spaced_ids_equal_the_library(text):
    code = alignment.spaced_encoder(bpe_path())
    want = libraries()[0].encode(f" {text}", add_special_tokens=False).ids if text else []
    assert np.frombuffer(code.encode(text), code.dtype).tolist() == want


def with_odd(docs):
    more = docs.sparkSession.createDataFrame(ODD, "doc_id long, text string")
    return written(docs.unionByName(more, allowMissingColumns=True), "test-odd")


def test_sentencepiece_query(spark, docs, rows):
    got = Counter(tuple(r) for r in queries.sentencepiece_digest(with_odd(docs)).collect())
    library, want = libraries()[1], Counter()
    for i, t in [*rows, *ODD]:
        ids = [1, *library.encode(t or ""), 2]
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert got == want


def test_decoding_keeps_columns(spark):
    rows = spark.createDataFrame([(1, bytearray(np.array([1, 263, 2], "<u4").tobytes()), "old", 2.5), (None, None, "x", None)], "c0 long, ids binary, text string, `a b` double")
    got = sentencepieces.decode_pieces(rows, piece_path())
    assert got.columns == ["c0", "a b", "text"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 2.5, libraries()[1].decode([1, 263, 2])), (None, None, "")]


def brute_alignment(rows):
    """The rows that the alignment should give, token by token."""
    a_lib, b_lib = libraries()
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    found, pairs = [], Counter()
    for i, t in rows:
        sides = []
        if t:
            a = a_lib.encode(f" {t}", add_special_tokens=False).ids
            b = b_lib.encode(t)
            spelt = [[bytes(code[c] for c in a_lib.id_to_token(x)) for x in a], [bytes([int(b_lib.id_to_piece(x)[3:5], 16)]) if b_lib.is_byte(x) else b_lib.id_to_piece(x).replace("▁", " ").encode() for x in b]]
            if all(b"".join(x) == f" {t}".encode() for x in spelt):
                sides = [list(zip(ids, np.cumsum([len(x) for x in s]).tolist())) for ids, s in zip((a, b), spelt)]
        if not sides:
            found.append((i, 0, 0, 0, [], ""))
            continue
        # Token by token along the bytes: which two tokens cover a byte, and where both end.
        links, groups, at = [], [([], [])], [0, 0]
        owner = [[x for x, size in zip(range(len(s)), np.diff([0, *(e for _, e in s)])) for _ in range(size)] for s in sides]
        for pair in dict.fromkeys(zip(*owner)):
            links.append((sides[0][pair[0]][0], sides[1][pair[1]][0]))
        ends = [{e for _, e in s} for s in sides]
        for e in sorted(ends[0] | ends[1]):
            for k in (0, 1):
                if e in ends[k]:
                    groups[-1][k].append(str(sides[k][at[k]][0]))
                    at[k] += 1
            if e in ends[0] and e in ends[1]:
                groups.append(([], []))
        groups = ["|".join(map(",".join, g)) for g in groups[:-1]]
        pairs.update(links)
        found.append((i, len(sides[0]), len(sides[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, y), n in pairs.items():
        most[y] = max(most[y], n)
    return Counter((i, na, nb, ng, len(links), sum(pairs[x] == most[x[1]] for x in links), sum(pairs[x] for x in links), h) for i, na, nb, ng, links, h in found)


@pytest.mark.parametrize("heavy", [1 << 21, 500, 1])
def test_alignment(docs, rows, heavy):
    """Also where only a few or none of the pairs are often enough to be broadcast."""
    got = alignment.align_corpus(with_odd(docs), bpe_path(), piece_path(), heavy=heavy)
    assert Counter(tuple(r) for r in got.collect()) == brute_alignment([*rows, *ODD])


def test_alignment_of_documents(spark, monkeypatch):
    monkeypatch.setattr(alignment, "ROWS_HELD", 1000)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in queries.op11_alignment(spark, SF).collect()) == brute_alignment(rows)


def test_nothing(none):
    assert queries.sentencepiece_digest(none).count() == 0
    assert alignment.align_corpus(none, bpe_path(), piece_path()).count() == 0
    only = none.sparkSession.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert Counter(tuple(r) for r in alignment.align_corpus(only, bpe_path(), piece_path()).collect()) == brute_alignment([(1, None), (None, "")])
    assert alignment.count_pairs(alignment.align_documents(only, bpe_path(), piece_path())).agg(F.count("*")).first()[0] == 0
