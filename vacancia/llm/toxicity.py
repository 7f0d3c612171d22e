"""Operator 4: toxicity by a bidirectional gated recurrent network with attention pooling.

Each word enters as a word embedding (hashed) beside the mean embedding of its character
n-grams (hashed, with the word's start marked). A forward and a backward gated recurrent
unit read the window of `WINDOW` words that begins at each word; attention pools their
states into a logit. A text is scored from its greatest window logit by a logistic
calibration. Everything is trained in numpy by gradient descent; of a toxic text the windows
that score highest are the positive examples, since labels are by text.

The model is fitted on a bounded sample (`per_class` rows of label 0 and 1, texts of at most
`max_bytes`); every window of every whole text, however long, is scored. Defined cases: null and empty
texts, and texts without words, get the score of an empty window; without labelled rows of
both classes every score is 0.5; repeated rows each keep their row; an empty table gives
no row; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import ALNUM, BYTE_VALUES, FOLD, mix, words
from .labelled import sample
from .quality import logistic
from .shared import slices, text_buffer

WINDOW = 12
BUCKETS, DIM, HIDDEN = 1 << 15, 6, 8
GRAMS = (4, 5)
SCORED = "doc_id long, score double"


def char_grams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each character n-gram (bytes) of each given word, and pointers by word.
    The start of a word counts as a character; every word has at least one n-gram."""
    lengths = ends - starts + 1
    begin = np.concatenate([[0], np.cumsum(lengths)])
    word = np.repeat(np.arange(len(starts)), lengths)
    inner = np.arange(begin[-1]) - begin[word] - 1
    values = np.where(inner < 0, np.uint64(0x5BD1E9955BD1E995), BYTE_VALUES[FOLD[buf[np.where(inner < 0, 0, starts[word] + inner)]]] if len(buf) else np.uint64(0))
    left = begin[word + 1] - np.arange(begin[-1])
    grams, owner = [], []
    for k in GRAMS:
        ok = np.flatnonzero((left >= k) | ((inner < 0) & (left < k)) & (k == GRAMS[0]))
        h = np.zeros(len(ok), np.uint64)
        for j in range(k):
            at = np.minimum(ok + j, begin[-1] - 1)
            h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(j < left[ok], values[at], np.uint64(0))
        grams.append((mix(h) % np.uint64(BUCKETS)).astype(np.int64))
        owner.append(word[ok])
    grams, owner = np.concatenate(grams), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return grams[order], np.searchsorted(owner[order], np.arange(len(starts) + 1))


class Texts:
    """Distinct words of some texts and the word sequence of each text."""

    def __init__(self, column: pa.Array):
        buf, offsets = text_buffer(column)
        starts, ends, hashes, self.pointers = words(buf, offsets, ALNUM)
        distinct, first, self.index = np.unique(hashes, return_index=True, return_inverse=True)
        self.word = (distinct % np.uint64(BUCKETS)).astype(np.int64)
        self.grams, self.gram_pointers = char_grams(buf, starts[first], ends[first])

    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        """The word at which each window begins, for every whole window of every text, and the
        text it belongs to; a text of less than a window has one that is padded."""
        n = np.diff(self.pointers)
        many = np.maximum(1, n - WINDOW + 1)
        owner = np.repeat(np.arange(len(n)), many)
        return self.pointers[:-1][owner] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many), owner

    def windows(self, begin: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Index of the words (-1: none) of windows that begin at the given words."""
        at = begin[:, None] + np.arange(WINDOW)
        inside = at < self.pointers[1:][owner][:, None]
        index = np.append(self.index, -1)
        return np.where(inside, index[np.where(inside, at, -1)], -1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gate(x: np.ndarray) -> np.ndarray:
    """The piecewise linear sigmoid, which costs a quarter of the smooth one."""
    return np.clip(0.2 * x + 0.5, 0, 1)


class BiGru:
    """Parameters, forward pass and gradients. Direction d of a window reads it forwards
    (0) or backwards (1); gates are in the order update, reset, new state."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        h, f = HIDDEN, 2 * DIM
        self.p = {"word": r.normal(0, 0.05, (BUCKETS, DIM)), "gram": r.normal(0, 0.05, (BUCKETS, DIM)), "attend": r.normal(0, 0.1, 2 * h), "out": r.normal(0, 0.3, 2 * h), "bias": np.zeros(1)}
        for d in "01":
            self.p |= {f"w{d}": r.normal(0, f**-0.5, (f, 3 * h)), f"u{d}": r.normal(0, h**-0.5, (h, 3 * h)), f"b{d}": np.zeros(3 * h)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def embed(self, word: np.ndarray, grams: np.ndarray, pointers: np.ndarray) -> np.ndarray:
        mean = np.add.reduceat(self.p["gram"][grams], pointers[:-1]) / np.diff(pointers)[:, None] if len(word) else np.zeros((0, DIM), np.float32)
        return np.concatenate([self.p["word"][word], mean], 1).astype(np.float32)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of every distinct word in either direction; the last row is for no word."""
        both = np.concatenate([x @ self.p[f"w{d}"] + self.p[f"b{d}"] for d in "01"], 1)
        return np.concatenate([both, np.zeros((1, both.shape[1]), np.float32)])

    def forward(self, gates: np.ndarray, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logit of every window. With keep, the states are stored for backward()."""
        h, steps = HIDDEN, windows.shape[1]
        states = np.empty((len(windows), steps, 2 * h), np.float32)
        real = windows >= 0
        for d in (0, 1):
            state = np.zeros((len(windows), h), np.float32)
            u = self.p[f"u{d}"]
            trail = []
            for t in range(steps) if d == 0 else reversed(range(steps)):
                g = gates[windows[:, t], 3 * h * d : 3 * h * (d + 1)]
                s = state @ u
                zr = gate(g[:, : 2 * h] + s[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                n = np.tanh(g[:, 2 * h :] + r * s[:, 2 * h :])
                new = n + z * (state - n)
                new = np.where(real[:, t : t + 1], new, state)
                if keep is not None:
                    trail.append((t, state, z, r, n, s[:, 2 * h :]))
                states[:, t, h * d : h * (d + 1)] = state = new
            if keep is not None:
                keep.append(trail)
        scores = states @ self.p["attend"]
        scores = np.where(real, scores, np.float32(-1e4))
        a = np.exp(scores - scores.max(1, keepdims=True)) * real
        a /= a.sum(1, keepdims=True) + 1e-9
        pooled = (a[:, None, :] @ states)[:, 0]
        if keep is not None:
            keep += [states, a, pooled, real]
        return pooled @ self.p["out"] + self.p["bias"][0]

    def slide(self, gates: np.ndarray, index: np.ndarray, chunk: int = 2048) -> np.ndarray:
        """Logit of the whole window at every place of one word sequence, as forward() gives
        it. Windows side by side read the gates of a word from one array, and one product a
        step gives both the recurrent part and the state's share of attention and logit."""
        h, many = HIDDEN, max(0, len(index) - WINDOW + 1)
        logits = np.empty(many, np.float32)
        scale = np.repeat(np.float32([0.2, 2]), [2 * h, h])[:, None]  # of gates; tanh(x) is 1 - 2 / (1 + exp(2 x))
        known = np.ascontiguousarray(gates.T) * np.concatenate([scale, scale]) + np.tile(np.repeat(np.float32([0.5, 0]), [2 * h, h]), 2)[:, None]
        weights = [np.concatenate([self.p[f"u{d}"].T * scale, self.p["attend"][None, h * d : h * (d + 1)], self.p["out"][None, h * d : h * (d + 1)]]) for d in (0, 1)]
        for a in range(0, many, chunk):
            n = min(chunk, many - a)
            read = np.take(known, index[a : a + n + WINDOW - 1], axis=1)
            parts = np.zeros((WINDOW, 2, n), np.float32)
            made, new = np.empty((3 * h + 2, n), np.float32), np.empty((h, n), np.float32)
            for d in (0, 1):
                g, state, before = read[3 * h * d : 3 * h * (d + 1)], np.zeros((h, n), np.float32), None
                for t in range(WINDOW) if d == 0 else reversed(range(WINDOW)):
                    np.matmul(weights[d], state, out=made)
                    if before is not None:
                        parts[before] += made[3 * h :]
                    zr, s = made[: 2 * h], made[2 * h : 3 * h]
                    zr += g[: 2 * h, t : t + n]
                    np.maximum(zr, 0, out=zr)
                    np.minimum(zr, 1, out=zr)
                    np.multiply(zr[h:], s, out=new)
                    new += g[2 * h :, t : t + n]
                    np.minimum(new, 40, out=new)
                    np.exp(new, out=new)
                    new += 1
                    np.divide(np.float32(-2), new, out=new)
                    new += 1
                    state -= new
                    state *= zr[:h]
                    state += new
                    before = t
                parts[before] += weights[d][3 * h :] @ state
            scores, values = parts[:, 0], parts[:, 1]
            scores -= scores.max(0)
            np.exp(scores, out=scores)
            logits[a : a + n] = (scores * values).sum(0) / scores.sum(0)
        return logits + self.p["bias"][0]

    def every(self, texts: Texts, begin: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Logit of each window of texts."""
        gates = self.project(self.embed(texts.word, texts.grams, texts.gram_pointers))
        whole = begin + WINDOW <= texts.pointers[1:][owner]
        logits = np.empty(len(begin), np.float32)
        logits[whole] = self.slide(gates, texts.index)[begin[whole]]
        short = np.flatnonzero(~whole)
        for some in np.split(short, range(4096, len(short), 4096)):
            logits[some] = self.forward(gates, texts.windows(begin[some], owner[some]))
        return logits

    def backward(self, keep: list, error: np.ndarray, windows: np.ndarray, x: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of all but the embeddings, and that of the embedded words x."""
        h = HIDDEN
        (*trails, states, a, pooled, real), g = keep, {}
        g["bias"], g["out"] = error.sum(keepdims=True), pooled.T @ error
        d_pooled = error[:, None] * self.p["out"]
        d_a = (states @ d_pooled[:, :, None])[:, :, 0]
        d_scores = a * (d_a - (a * d_a).sum(1, keepdims=True))
        g["attend"] = np.einsum("bt,btk->k", d_scores, states)
        d_states = a[:, :, None] * d_pooled[:, None, :] + d_scores[:, :, None] * self.p["attend"]
        d_x = np.zeros((len(x) + 1, x.shape[1]), np.float32)
        padded = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        for d, trail in enumerate(trails):
            u, w = self.p[f"u{d}"], self.p[f"w{d}"]
            g_u, g_w, g_b = np.zeros_like(u), np.zeros_like(w), np.zeros(3 * h, np.float32)
            carry = np.zeros((len(windows), h), np.float32)
            for t, before, z, r, n, s in reversed(trail):
                d_new = carry + d_states[:, t, h * d : h * (d + 1)]
                live = real[:, t : t + 1]
                d_n = d_new * (1 - z) * (1 - n * n) * live
                d_z = d_new * (before - n) * 0.2 * ((z > 0) & (z < 1)) * live
                d_r = d_n * s * 0.2 * ((r > 0) & (r < 1))
                d_gate = np.concatenate([d_z, d_r, d_n], 1)
                d_s = np.concatenate([d_z, d_r, d_n * r], 1)
                carry = np.where(live, d_new * z, d_new) + d_s @ u.T
                g_u += before.T @ d_s
                g_w += padded[windows[:, t]].T @ d_gate
                g_b += d_gate.sum(0)
                np.add.at(d_x, windows[:, t], d_gate @ w.T)
            g |= {f"u{d}": g_u, f"w{d}": g_w, f"b{d}": g_b}
        return g, d_x[:-1]


class ToxicityModel:
    def __init__(self, network: BiGru, calibration: np.ndarray):
        self.network, self.calibration = network, calibration

    def logits(self, column: pa.Array) -> np.ndarray:
        """The greatest window logit of each text."""
        texts = Texts(column)
        begin, owner = texts.starts()
        return np.maximum.reduceat(self.network.every(texts, begin, owner), np.searchsorted(owner, np.arange(len(column))))

    def score(self, column: pa.Array) -> np.ndarray:
        return sigmoid(self.logits(column) * self.calibration[0] + self.calibration[1])

    @staticmethod
    def fit(texts: list[str], labels: list[int], epochs: int = 4, steps: int = 100, batch: int = 512, rate: float = 0.01, seed: int = 5) -> "ToxicityModel | None":
        if len(set(labels)) < 2:
            return None
        r = np.random.default_rng(seed)
        y = np.array(labels)
        corpus = Texts(pa.array(texts, pa.large_string()))
        begin, owner = corpus.starts()
        network = BiGru(seed)
        network_start(network, corpus, y)
        p, moment = network.p, {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
        first = np.searchsorted(owner, np.arange(len(y)))
        clean = np.flatnonzero((y[owner] == 0) & ((begin - corpus.pointers[owner]) % (WINDOW // 2) == 0))  # neighbours teach the same
        step = epoch = 0
        while epoch < epochs or step < steps:  # a small sample is read more often
            epoch += 1
            logits = network.every(corpus, begin, owner)
            top = np.lexsort((logits, owner))[np.append(first[1:], len(owner)) - 1]  # of each text
            hard = clean[np.argsort(-logits[clean])[: len(y)]]
            chosen = np.unique(np.concatenate([top, hard, r.choice(clean, min(len(clean), len(y)), False)]))
            r.shuffle(chosen)
            size = max(32, min(batch, len(chosen) // 8))
            for at in range(0, len(chosen), size):
                some = chosen[at : at + size]
                used, index = np.unique(corpus.windows(begin[some], owner[some]), return_inverse=True)
                index = index.reshape(len(some), -1)
                if len(used) and used[0] < 0:
                    used, index = used[1:], index - 1
                sizes = np.diff(corpus.gram_pointers)[used]
                pointers = np.concatenate([[0], np.cumsum(sizes)])
                grams = corpus.grams[np.repeat(corpus.gram_pointers[used] - pointers[:-1], sizes) + np.arange(pointers[-1])]
                x = network.embed(corpus.word[used], grams, pointers)
                keep: list = []
                truth = y[owner[some]].astype(np.float32)
                error = (sigmoid(network.forward(network.project(x), index, keep)) - truth) / len(some)
                g, d_x = network.backward(keep, error.astype(np.float32), index, x)
                g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
                np.add.at(g["word"], corpus.word[used], d_x[:, :DIM])
                np.add.at(g["gram"], grams, np.repeat(d_x[:, DIM:] / np.maximum(sizes, 1)[:, None], sizes, 0))
                step += 1
                for k, v in g.items():  # Adam; embeddings move slower, since rare words are soon learned by heart
                    m, s = moment[k]
                    m += 0.1 * (v - m)
                    s += 0.001 * (v * v - s)
                    p[k] -= rate * (0.1 if k in ("word", "gram") else 1) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        model = ToxicityModel(network, np.array([1.0, 0.0]))
        model.calibration = logistic(model.logits(pa.array(texts, pa.large_string()))[:, None], y.astype(float), ridge=1.0)
        return model


def network_start(network: BiGru, corpus: Texts, y: np.ndarray) -> None:
    """Begin the first dimension of either embedding at the smoothed log-odds of the share
    of toxic and of clean training texts that hold the word or n-gram."""
    text = np.repeat(np.arange(len(y)), np.diff(corpus.pointers))
    pairs = np.unique(text * np.int64(len(corpus.word)) + corpus.index)
    doc, word = pairs // len(corpus.word), pairs % len(corpus.word)
    sizes = np.diff(corpus.gram_pointers)[word]
    at = np.repeat(corpus.gram_pointers[word], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    gram_pairs = np.unique(np.repeat(doc, sizes) * np.int64(BUCKETS) + corpus.grams[at])
    total = np.bincount(y, minlength=2)
    for table, owner, bucket in (("word", doc, corpus.word[word]), ("gram", gram_pairs // BUCKETS, gram_pairs % BUCKETS)):
        toxic = np.bincount(bucket, y[owner], BUCKETS)
        clean = np.bincount(bucket, 1 - y[owner], BUCKETS)
        odds = np.log((toxic + 2) / (total[1] + 4)) - np.log((clean + 2) / (total[0] + 4))
        network.p[table][:, 0] = np.where(toxic + clean > 0, np.clip(odds, -4, 4), 0).astype(np.float32)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", per_class: tuple[int, int] = (1500, 800), max_bytes: int = 24 << 10, seed: int = 3) -> DataFrame:
    """doc_id, score of every row of docs; 1 is toxic."""
    model = ToxicityModel.fit(*sample(docs, labels, label, dict(enumerate(per_class)), max_bytes, seed, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            scores = model.score(batch.column(1)) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCORED)
