from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vacancia.llm import packing, token_files
from vacancia.llm.queries import bpe_path
from vacancia.llm.tokens import encoder


def truth(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe_path())
    return [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Word", " ", "  ", "\n", "\t", ".", ",", "'s", "don't", "é", "漢", "12", " ", "\x1c", "!!", "<|endoftext|>", "x.y", "\r\n"]), max_size=12).map("".join))
def test_encoder_equals_library(text):
    code = encoder(bpe_path())
    assert np.frombuffer(code.encode(text), code.dtype).tolist() == truth([text])[0]


def test_files_round_trip(docs, rows, tmp_path):
    manifest = token_files.write_token_files(docs, bpe_path(), end_id=2, length=64, rows=4, shards=3, path=f"file://{tmp_path}/out")
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(manifest).collect())
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    at, want = 0, []
    for (i, _), ids in zip(order, truth([t for _, t in order])):
        ids = [*ids, 2]
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    for m in manifest.collect():
        seq = token_files.Sequences(m["path"])
        ids, mask = seq[len(seq) - 1]
        assert len(ids) == len(mask) == 64 and not ids.flags.owndata
        real = sum(sum(seq[i][1].to_pylist()) for i in range(len(seq)))
        assert real == m["n_tokens"]


def test_empty_table_of_files(none, tmp_path):
    manifest = token_files.write_token_files(none, bpe_path(), end_id=2, path=f"file://{tmp_path}/out")
    assert token_files.read_token_files(manifest).count() == 0


def test_packing(docs, rows):
    pieces = packing.token_pieces(docs, bpe_path(), 0, 1024).withColumn("ids_crc32", F.crc32("ids"))
    got = packing.pack(pieces.drop("ids"), docs.count()).collect()
    by_seq = {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(len(x) + 1 for x in truth([t for _, t in rows]))
    assert sum(r["length"] for r in got) == total
    assert len(by_seq) <= -(-total // 1024) + 1


def test_pieces_by_the_library(docs, rows):
    """start, length, ids_crc32 and doc_tokens of each piece, and its place, through the query."""
    from collections import Counter

    from vacancia.llm.queries import pack_documents

    got = pack_documents(docs).collect()
    want = Counter()
    for (i, _), ids in zip(rows, truth([t for _, t in rows])):
        ids = [*ids, 0]
        for at in range(0, len(ids), 1024):
            part = ids[at : at + 1024]
            want[i, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    taken = Counter()
    for r in got:
        for at in range(r["offset"], r["offset"] + r["length"]):
            taken[r["sequence_id"], at] += 1
    assert max(taken.values()) == 1 and max(at for _, at in taken) < 1024


def test_packing_keeps_columns_and_spreads_equal_rows(spark):
    same = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(300).cast("long").alias("length"), F.lit("x").alias("sequence_id"), F.lit("y").alias("_pack_group_0"), F.lit("z").alias("pack_group"))
    got = packing.pack(same, 4000, group_rows=500)
    assert set(got.columns) == {"doc_id", "length", "sequence_id", "offset", "_pack_group_0", "pack_group"} and dict(got.dtypes)["sequence_id"] == "bigint"
    groups = [r["count"] for r in got.groupBy(F.shiftright("sequence_id", 40)).count().collect()]
    assert len(groups) == 8 and max(groups) < 650
    assert got.where("pack_group = 'z' and _pack_group_0 = 'y'").count() == 4000


def test_packing_of_nothing(none):
    assert packing.pack(packing.token_pieces(none, bpe_path(), 0).drop("ids"), 0).count() == 0


def test_first_fit_decreasing_equals_plain_search():
    r = np.random.default_rng(3)
    for n in (1, 2, 50, 300):
        sizes = r.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        free: list[int] = []
        want = np.zeros(n, int)
        for i in np.argsort(-sizes, kind="stable"):
            b = next((j for j, f in enumerate(free) if f >= sizes[i]), None)
            if b is None:
                b = len(free)
                free.append(100)
            want[i] = b
            assert offsets[i] == 100 - free[b]
            free[b] -= sizes[i]
        assert bins.tolist() == want.tolist()


def test_chunks_bound_a_group_of_equal_rows(spark):
    same = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.lit(300).cast("long").alias("length"))
    got = packing.pack(same, 500, chunk_rows=100).groupBy("sequence_id").agg(F.sum("length").alias("s")).collect()
    assert max(r["s"] for r in got) <= 1024 and sum(r["s"] for r in got) == 150_000


@pytest.mark.parametrize("n", [0, 1])
def test_ffd_tiny(n):
    bins, _ = packing.first_fit_decreasing(np.full(n, 5), 10)
    assert len(bins) == n
