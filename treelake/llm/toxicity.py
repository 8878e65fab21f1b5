"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashes of its words, their stems (first letters), word pairs, and pairs with one word between. Each coordinate has its own
rate, and L1 leaves most weights 0, so that those that remain are a small table for every worker. Training is one task over a bounded
sample of labelled rows (at most `per_class` of each class); rows of the larger class weigh more, so that scores are probabilities
at the labels' own proportions.

Defined cases: null and empty texts have the score of the bias alone; repeated rows have equal scores; without labels every score is
0.5; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelake.llm.common import held_out, labelled_sample, map_batches, rows_batch, texts

WORD = re.compile(r"\w+")
BITS = 20
U = np.uint64


STEMS = (4, 6)
KNOWN = 300_000


class Vocabulary:
    """crc32 of each word, and of its first letters, by a number that it has until there are too many."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.hash = np.zeros((1 + len(STEMS), KNOWN), U)

    def numbers(self, words: list[str]) -> np.ndarray:
        at = self.at
        new = {w for w in {*words} if w not in at}
        if len(at) + len(new) > KNOWN:
            at.clear()
            new = {*words}
            if len(new) > KNOWN:
                self.hash = np.zeros((len(self.hash), 2 * len(new)), U)
        for w in new:
            k = at[w] = len(at)
            self.hash[0, k] = zlib.crc32(w.encode())
            for i, n in enumerate(STEMS, 1):
                self.hash[i, k] = zlib.crc32(w[:n].encode(), n)
        return np.fromiter(map(at.__getitem__, words), np.int64, len(words))


VOCABULARY = Vocabulary()


def features(text: str) -> np.ndarray:
    """Places of words, words' stems (their first 4 and 6 letters), pairs, and pairs with one between; with repeats."""
    h, *stems = VOCABULARY.hash[:, VOCABULARY.numbers(WORD.findall(text.lower()))]
    shift = U(64 - BITS)
    grams = [h * U(0x9E3779B97F4A7C15), *[s * U(0x9E6C63D0876A9A47) + U(i) for i, s in enumerate(stems)]]
    grams.append((h[:-1] * U(0xBF58476D1CE4E5B9) ^ h[1:]) * U(0x94D049BB133111EB))
    grams.append((h[:-2] * U(0xD6E8FEB86659FD93) ^ h[2:]) * U(0xC2B2AE3D27D4EB4F))
    return (np.concatenate(grams) >> shift).astype(np.int64) + 1


class Ftrl:
    """Follow the regularised leader, per coordinate; place 0 is the bias, which has no L1."""

    def __init__(self, alpha: float = 0.2, beta: float = 1.0, l1: float = 3.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.full(z.shape, self.l1)
        if isinstance(at, slice):
            l1[0] = 0
        else:
            l1[at == 0] = 0
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, y: int, weight: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
        g = (p - y) * weight
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(rows: list[tuple[np.ndarray, int]], sizes: dict[int, int], epochs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights that aren't 0, from rows of features and labels."""
    model, random = Ftrl(), np.random.default_rng(0)
    have = [sum(y == k for _, y in rows) for k in (0, 1)]
    part = [sizes.get(k, 0) / max(have[k], 1) for k in (0, 1)]
    low = min([p for p, m in zip(part, have) if m] or [1])
    for _ in range(epochs):
        for k in random.permutation(len(rows)):
            at, y = rows[k]
            model.learn(at, y, part[y] / low)
    w = model.weights()
    at = np.flatnonzero(w)
    return at, w[at]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """The sample's features go to one task; its weights come back."""
    sample, sizes = labelled_sample(docs, labels, "toxic", per_class)
    feats, out = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("at", pa.binary())]), pa.schema([("at", pa.int64()), ("w", pa.float64())])

    def extract(b: pa.RecordBatch) -> pa.RecordBatch:
        at = [np.unique(np.append(features(t.as_py()), 0)).astype("<i4").tobytes() for t in b.column(1)]
        return rows_batch(feats, [b.column(0), b.column(2), at])

    def learn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted([r for b in it for r in zip(*[c.to_pylist() for c in b.columns])])
        if rows:
            at, w = train([(np.frombuffer(x, "<i4").astype(np.int64), y) for _, y, x in rows], sizes)
            yield rows_batch(out, [at, w])

    got = map_batches(sample, extract, "doc_id long, y int, at binary").repartition(1).mapInArrow(learn, "at long, w double").toPandas()
    return got["at"].to_numpy(np.int64), got["w"].to_numpy(np.float64)


class Scorer:
    def __init__(self, at: np.ndarray, w: np.ndarray):
        self.table = np.zeros(2**BITS + 1, np.float32)
        self.table[at] = w

    def score(self, text: str) -> float:
        at = features(text)
        at = np.unique(at[self.table[at] != 0])
        s = float(self.table[at].sum(dtype=np.float64) + self.table[0])
        return float(1 / (1 + np.exp(-np.clip(s, -30, 30))))


def scores(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], threshold: float = 0.3) -> DataFrame:
    shared, schema = docs.sparkSession.sparkContext.broadcast(weights), pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    made: list[Scorer] = []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Scorer(*shared.value))
        return rows_batch(schema, [b.column(0), [made[0].score(t.as_py()) for t in b.column(1)]])

    scored = map_batches(texts(docs), run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
