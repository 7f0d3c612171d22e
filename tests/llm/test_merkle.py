"""Operator 13 against a plain rendering of its rule."""

from __future__ import annotations

import zlib
from collections import Counter
from hashlib import sha256

import pytest

from vacancia.llm import merkle, queries

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, key string, at string, hash string, path string, root string"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row) -> str:
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([digest(*x[i : i + 3]) for i in range(0, len(x), 3)])
    return levels


def steps(levels, i):
    for x in levels[:-1]:
        low = i // 3 * 3
        yield "".join(x[low:i]), "".join(x[i + 1 : low + 3])
        i //= 3


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree(map(leaf, groups[s]))
    top = tree(trees[s][-1][0] for s in names)
    out = Counter()
    for j, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            path = [*steps(trees[s], i), *steps(top, j)]
            new = r
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                new = (*r[:4], r[4].replace("\n", ""))
            h = leaf(new)
            for a, b in path:
                h = digest(a, h, b)
            root = top[-1][0]
            out[r[0], leaf(r), trees[s][-1][0], root, digest(*(a + b for a, b in path)), h, h == root] += 1
    return out


def table(spark, rows, path):
    spark.createDataFrame([(*r, *"abcde") for r in rows], COLUMNS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def made(sizes):
    rows, at = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            at += 1
            rows.append((at * 7 % 1009, source, None if at % 5 == 0 else "en", None if at % 7 == 0 else at, f"text\n{at}" if at % 3 else f"line {at}"))
    return rows


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_trees_of_many_sizes(spark, tmp_path, levels):
    sizes = {"a": 1, "b": 2, "é": 3, "Z": 4, None: 9, "": 10, "c": 27, "d": 28, "e": 82, "f": 100, "s": 5}
    rows = made(sizes)
    rows += [rows[0], rows[0], (None, "f", None, None, None), (None, "f", None, None, "\n"), (rows[50][0], rows[50][1], "xx", 1, ""), (77, "q", "l", 2, "x\n" * 50000)]
    docs = table(spark, rows, f"{tmp_path}/documents")
    even = queries.F.crc32(docs.doc_id.cast("string").cast("binary")) % 2 == 0
    text = queries.F.when(even, queries.F.replace("text", queries.F.lit("\n"), queries.F.lit(""))).otherwise(docs.text)
    got = Counter(tuple(r) for r in merkle.manifest(docs, tampered={"text": text}, levels=levels).collect())
    want = brute(rows)
    assert got == want and {x[-1] for x in want} == {True, False}


def test_many_sources(spark, tmp_path):
    rows = [(i, f"s{i % 100}", "en", i, f"t{i}\n") for i in range(150)]
    docs = table(spark, rows, f"{tmp_path}/documents")
    assert Counter(tuple(r) for r in queries.merkle_manifest(docs).collect()) == brute(rows)


def test_one_row_and_none(spark, tmp_path):
    rows = [(2, None, None, None, "a\nb")]
    docs = table(spark, rows, f"{tmp_path}/documents")
    assert Counter(tuple(r) for r in queries.merkle_manifest(docs).collect()) == brute(rows)
    assert queries.merkle_manifest(docs.where("false")).count() == 0
