"""Operator 2: quality by compression with dictionaries of good and bad text.

Two zstandard dictionaries are trained on good and on bad labelled texts. A text is cut
into chunks of `chunk` bytes; each is compressed with either dictionary, and the
differences of the two sizes, normalised by the chunk's length, are summed up (mean, least
and greatest), with the mean ratios of either dictionary and the log of the text's length, in a
logistic calibration fitted on labelled texts the dictionaries have not seen.

The model is fitted on a bounded sample (`per_class` rows of each label, texts of at most
`max_bytes`); every whole text is scored. Defined cases: null and empty texts get the
score of a text without any difference; a very long text counts by all its chunks; without labelled rows of both classes every score
is 0.5; repeated rows each keep their row; an empty table gives no row; other columns of
the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, sample
from .shared import slices

SCORED = "doc_id long, score double"


class Compressors:
    def __init__(self, dictionaries: tuple[bytes, bytes], level: int, chunk: int):
        self.both = []
        for raw in dictionaries:
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=level)
            self.both.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_checksum=False, write_content_size=False, write_dict_id=False))
        self.chunk = chunk

    def features(self, text: bytes) -> list[float]:
        if not text:
            return [0.0] * 6
        cuts = range(0, len(text), self.chunk)
        parts = [text[a : a + self.chunk] for a in cuts]
        if len(parts) > 1 and len(parts[-1]) < self.chunk // 4:
            parts[-2:] = [parts[-2] + parts[-1]]
        n = np.array([len(p) for p in parts], float)
        good, bad = (np.array([len(c.compress(p)) for p in parts], float) for c in self.both)
        difference = (bad - good) / n
        return [float(difference @ n / n.sum()), difference.min(), difference.max(), good.sum() / n.sum(), bad.sum() / n.sum(), np.log1p(n.sum()) / 10]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class QualityModel:
    def __init__(self, dictionaries: tuple[bytes, bytes], weights: np.ndarray, shift: np.ndarray, scale: np.ndarray, level: int, chunk: int):
        self.dictionaries, self.weights, self.shift, self.scale, self.level, self.chunk = dictionaries, weights, shift, scale, level, chunk

    @staticmethod
    def fit(texts: list[str], labels: list[int], level: int = 3, chunk: int = 2048, dictionary_bytes: int = 64 << 10) -> "QualityModel | None":
        """Even rows of each class make the dictionaries, odd rows the calibration."""
        if len(set(labels)) < 2 or min(labels.count(0), labels.count(1)) < 8:
            return None
        rank = {0: 0, 1: 0}
        to_dictionary, rest = {0: [], 1: []}, []
        for text, y in zip(texts, labels):
            if rank[y] % 2:
                rest.append((text.encode(), y))
            else:
                to_dictionary[y].append(text.encode())
            rank[y] += 1

        def dictionary(parts: list[bytes]) -> bytes:
            cut = [p[a : a + chunk] for p in parts for a in range(0, len(p), chunk)]
            try:
                return zstandard.train_dictionary(dictionary_bytes, cut).as_bytes()
            except zstandard.ZstdError:  # too little text to train on: its end is the dictionary
                return b"".join(parts)[-dictionary_bytes:] or b"\n" * 8

        made = (dictionary(to_dictionary[1]), dictionary(to_dictionary[0]))
        compressors = Compressors(made, level, chunk)
        x = np.array([compressors.features(t) for t, _ in rest])
        y = np.array([y for _, y in rest], float)
        shift, scale = x.mean(0), x.std(0) + 1e-9
        return QualityModel(made, logistic((x - shift) / scale, y), shift, scale, level, chunk)

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.shift) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str = "quality", per_class: int = 2000, max_bytes: int = 32 << 10, seed: int = 3) -> QualityModel | None:
    return QualityModel.fit(*sample(docs, labels, label, {0: per_class, 1: per_class}, max_bytes, seed, id_col, text_col))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """The rows of docs, all columns, whose score is at least threshold."""
    model = fitted(docs, labels, id_col, text_col, **fit)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressors = model and Compressors(model.dictionaries, model.level, model.chunk)
        for texts in batches:
            yield pd.Series(model.score(np.array([compressors.features((t or "").encode()) for t in texts]).reshape(-1, 6)) if model else np.full(len(texts), 0.5))

    return docs.where(score(F.col(text_col).cast("string")) >= threshold)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """doc_id, score of every row of docs; 1 is good."""
    model = fitted(docs, labels, id_col, text_col, **fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model and Compressors(model.dictionaries, model.level, model.chunk)
        for batch in slices(batches, "text"):
            scores = model.score(np.array([compressors.features((t.as_py() or "").encode()) for t in batch.column(1)])) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCORED)


def with_decision(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
