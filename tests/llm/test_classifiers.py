from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from vacancia.llm import quality, toxicity
from vacancia.llm.labelled import sample

GOOD = "the and of river mountain evening light slowly across a quiet harbour while boats return home".split()
BAD = ["$$$", "###", "CLICK!!", "BUY!!", "|", "FREE!!", "%%%"]


def texts(n: int, seed: int) -> tuple[list[str], list[int], list[int]]:
    r = random.Random(seed)
    out, good, toxic = [], [], []
    for i in range(n):
        y, t = i % 2, i % 3 == 0
        words = [r.choice(GOOD if y else [w.upper() for w in GOOD] + BAD * 3) for _ in range(r.randint(30, 200))]
        if t:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["vilestem" + r.choice(["a", "ux", "ing"]), "scumbag"]))
        out.append(" ".join(words))
        good.append(y)
        toxic.append(int(t))
    return out, good, toxic


@pytest.fixture(scope="module")
def tables(spark, docs):
    t, good, toxic = texts(300, 1)
    made = spark.createDataFrame([(i + 1000, x, "x") for i, x in enumerate(t)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i + 1000, g, x) for i, (g, x) in enumerate(zip(good, toxic))] + [(1000, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    return made.unionByName(docs.select("doc_id", "text", "score")), labels, good, toxic


def test_quality(tables):
    docs, labels, good, _ = tables
    got = [r for r in quality.with_decision(quality.score_quality(docs, labels), 0.3).collect()]
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] >= 1000]
    assert held and np.mean([r["predicted"] == good[r["doc_id"] - 1000] for r in held]) > 0.95
    kept = quality.keep_good(docs, labels, 0.3)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)


def test_toxicity(tables):
    docs, labels, _, toxic = tables
    got = [r for r in quality.with_decision(toxicity.score_toxicity(docs, labels), 0.5).collect()]
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] >= 1000]
    assert np.mean([r["predicted"] == toxic[r["doc_id"] - 1000] for r in held]) > 0.9


def test_held_out_rows_never_train(tables):
    docs, labels, *_ = tables
    import zlib

    found, _ = sample(docs, labels, "quality", {0: 1000, 1: 1000}, 1 << 20, 3)
    ids = {r["text"]: r["doc_id"] for r in docs.where("doc_id >= 1000").collect()}
    assert all(zlib.crc32(str(ids[t]).encode()) % 5 for t in found if t in ids)


def test_no_labels(spark, tables, none):
    docs, labels, *_ = tables
    empty = labels.where("false")
    assert {r["score"] for r in quality.score_quality(docs, empty).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score_toxicity(docs, empty).collect()} == {0.5}
    assert quality.score_quality(none, labels).count() == toxicity.score_toxicity(none, labels).count() == 0


def test_windows_overlap_and_cover():
    t = toxicity.Texts(pa.array([" ".join(f"w{i}" for i in range(61)), "", "one two"], pa.large_string()))
    begin, owner = t.starts()
    windows = t.windows(begin, owner)
    assert owner.tolist() == [0] * (61 - toxicity.WINDOW + 1) + [1, 2]
    assert windows[owner == 0].tolist() == [t.index[i : i + toxicity.WINDOW].tolist() for i in range(61 - toxicity.WINDOW + 1)]
    assert (windows[owner == 1] == -1).all()
    assert windows[owner == 2].tolist() == [t.index[61:].tolist() + [-1] * (toxicity.WINDOW - 2)]


def test_windows_side_by_side_score_as_each_alone():
    """slide() against the forward pass of one window after another."""
    r = np.random.default_rng(2)
    texts = [" ".join(f"w{i}" for i in r.integers(0, 50, n)) for n in (0, 1, 23, 24, 25, 300, 24, 3)] + [None]
    corpus, net = toxicity.Texts(pa.array(texts, pa.large_string())), toxicity.BiGru(4)
    net.p = {k: v + r.normal(0, 0.5, v.shape).astype(np.float32) for k, v in net.p.items()}
    begin, owner = corpus.starts()
    gates = net.project(net.embed(corpus.word, corpus.grams, corpus.gram_pointers))
    want = net.forward(gates, corpus.windows(begin, owner))
    assert np.abs(net.every(corpus, begin, owner) - want).max() < 1e-4
    assert np.abs(net.slide(gates, corpus.index, 7) - net.slide(gates, corpus.index)).max() < 1e-5
    assert len(toxicity.BiGru(4).every(toxicity.Texts(pa.array([], pa.large_string())), *(np.zeros(0, np.int64),) * 2)) == 0


def test_gradients():
    """Analytic gradients against differences."""
    net = toxicity.BiGru(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = toxicity.Texts(pa.array(["a bc def a gh ij", "kl mn"], pa.large_string()))
    windows = words.windows(*words.starts())
    x = net.embed(words.word, words.grams, words.gram_pointers).astype(np.float64)
    error = np.array([0.7, -0.4])
    loss = lambda: float(net.forward(net.project(x).astype(np.float64), windows) @ error)
    keep: list = []
    net.forward(net.project(x), windows, keep)
    g, d_x = net.backward(keep, error, windows, x)
    for name in ("w0", "u1", "b0", "attend", "out"):
        at = tuple(0 for _ in net.p[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        up = loss()
        net.p[name][at] = old - 1e-3
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-3 - g[name][at]) < 2e-3, name


def test_forward_pass_by_plain_loops():
    """Gates, attention and logit of every window, one number at a time."""
    from math import exp, tanh

    net = toxicity.BiGru(3)
    texts = pa.array(["one two three two, one!", "", "a" * 40 + " b c"], pa.large_string())
    corpus = toxicity.Texts(texts)
    windows = corpus.windows(*corpus.starts())
    gates = net.project(net.embed(corpus.word, corpus.grams, corpus.gram_pointers))
    got = net.forward(gates, windows)
    p = {k: v.tolist() for k, v in net.p.items()}
    h, dim = toxicity.HIDDEN, toxicity.DIM
    sig = lambda x: min(1, max(0, 0.2 * x + 0.5))
    for window, logit in zip(windows.tolist(), got):
        read = [w for w in window if w >= 0]
        inputs = []
        for w in read:
            grams = corpus.grams[corpus.gram_pointers[w] : corpus.gram_pointers[w + 1]].tolist()
            inputs.append(p["word"][corpus.word[w]] + [sum(p["gram"][g][i] for g in grams) / len(grams) for i in range(dim)])
        states = [[0.0] * (2 * h) for _ in read]
        for d in (0, 1):
            state = [0.0] * h
            for t in range(len(read)) if d == 0 else reversed(range(len(read))):
                x = [sum(inputs[t][i] * p[f"w{d}"][i][k] for i in range(2 * dim)) + p[f"b{d}"][k] for k in range(3 * h)]
                s = [sum(state[i] * p[f"u{d}"][i][k] for i in range(h)) for k in range(3 * h)]
                new = []
                for k in range(h):
                    z, r = sig(x[k] + s[k]), sig(x[h + k] + s[h + k])
                    n = tanh(x[2 * h + k] + r * s[2 * h + k])
                    new.append((1 - z) * n + z * state[k])
                state = new
                states[t][h * d : h * (d + 1)] = state
        weights = [exp(sum(a * b for a, b in zip(p["attend"], s))) for s in states]
        pooled = [sum(w * s[k] for w, s in zip(weights, states)) / sum(weights) if read else 0.0 for k in range(2 * h)]
        assert abs(sum(a * b for a, b in zip(pooled, p["out"])) + p["bias"][0] - logit) < 1e-4


def test_compressed_sizes_by_a_second_path():
    """Features and score from plain compressions of each chunk with each dictionary."""
    import random

    import zstandard

    r = random.Random(2)
    good = [" ".join(r.choice("river stone quiet garden winter letter".split()) for _ in range(200)) for _ in range(60)]
    bad = [" ".join(r.choice("buy now click free win cash".split()) for _ in range(200)) for _ in range(60)]
    model = quality.QualityModel.fit(good + bad, [1] * 60 + [0] * 60)
    coders = quality.Compressors(model.dictionaries, model.level, model.chunk)
    for text in ("", "short", good[0] * 5 + bad[0], bad[1] * 9):
        raw = text.encode()
        parts = [raw[i : i + model.chunk] for i in range(0, len(raw), model.chunk)]
        if len(parts) > 1 and len(parts[-1]) < model.chunk // 4:
            parts = [*parts[:-2], parts[-2] + parts[-1]]
        sizes = []
        for d in model.dictionaries:
            coder = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes.append([len(coder.compress(x)) for x in parts])
        got = coders.features(raw)
        if not parts:
            assert got == [0.0] * 6
            continue
        n = [len(x) for x in parts]
        differences = [(b - g) / m for g, b, m in zip(*sizes, n)]
        want = [sum(d * m for d, m in zip(differences, n)) / sum(n), min(differences), max(differences), sum(sizes[0]) / sum(n), sum(sizes[1]) / sum(n)]
        assert np.allclose(got[:5], want)
        z = sum((f - a) / b * w for f, a, b, w in zip(got, model.shift, model.scale, model.weights)) + model.weights[-1]
        assert abs(1 / (1 + np.exp(-np.clip(z, -30, 30))) - model.score(np.array([got]))[0]) < 1e-9


def test_sample_of_repeated_ids_is_repeatable(spark):
    """Rows of one id with unlike texts, in any order and partitioning, give one and the same text."""
    rows = [(i, f"text {i} {j}") for i in range(1, 40) for j in range(5)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    found = [sample(spark.createDataFrame(x, "doc_id long, text string").repartition(n), labels, "quality", {0: 50, 1: 50}, 100, 3) for x, n in ((rows, 1), (rows[::-1], 3), (rows[7:] + rows[:7], 5))]
    assert found[0] == found[1] == found[2] and len(found[0][0]) == len(set(found[0][0])) > 20
