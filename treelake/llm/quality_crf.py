"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its potentials come from features of the line and its neighbours (symbols, capitals, bars, repeated words
and lines, ...), with weights for pairs of labels. Marginals come from forward-backward; a document's quality is their mean weighted by
length, made a probability by logistic regression. Only documents have labels: lines of good ones are good; those of bad ones start bad
and are labelled anew by the model's own marginals between rounds of training (at least the worst line stays bad).

Training is one task over a bounded sample (at most `per_class` documents of each class). Defined cases: a null or empty text is one
empty line; letters of other scripts count as letters; repeated rows have equal scores; without labels of both classes every score is 0.5; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelake.llm.common import held_out, labelled_sample, map_batches, rows_batch, texts

_ALL = bytes(range(256))
_UPPER = bytes(range(65, 91)) + bytes(c for c in range(0xC0, 0xDF) if c != 0xD7)
_LOWER = bytes(range(97, 123)) + bytes(c for c in range(0xDF, 0x100) if c != 0xF7)
NOT = {k: bytes(c for c in _ALL if c not in v) for k, v in {"upper": _UPPER, "lower": _LOWER, "symbol": b"#*$%&<>", "bar": b"|", "bang": b"!?", "digit": b"0123456789", "stop": b".,;:"}.items()}


class _Narrow(dict):
    """Characters beyond Latin-1 as others of their sort: capitals, other letters, digits, and the rest, which is no feature."""

    def __missing__(self, c: int) -> str:
        x = chr(c)
        self[c] = x if c < 256 else ("X" if x.isupper() else "x" if x.isalpha() else "0" if x.isdigit() else "_")
        return self[c]


NARROW = _Narrow()
OWN = 14
NEAR = (1, 2, 3, 4, 8, 9)  # features of a line that its neighbours see
WIDTH = OWN + 2 * len(NEAR)


def own_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """OWN features of each line, and the lines' lengths."""
    lines = text.split("\n")
    seen: dict[str, int] = {}
    rows, sizes = [], []
    for line in lines:
        try:
            raw = line.encode("latin-1")
            words = raw.split()
        except UnicodeEncodeError:  # words stay as they are, so that only equal ones are equal
            raw, words = line.translate(NARROW).encode("latin-1"), line.split()
        size = len(raw)
        n = len(words) or 1
        up, low, sym, bar, bang, dig, stop = (len(raw.translate(None, NOT[k])) for k in ("upper", "lower", "symbol", "bar", "bang", "digit", "stop"))
        letters = up + low or 1
        again = seen.get(line, 0) if words else 0
        seen[line] = again + 1
        rows.append((
            1.0, min(sym / n, 3), up / letters, min(bar / n, 1), min(bang / n, 3), min(dig / n, 3), min(stop / n, 2),
            min(size / n, 40) / 10, 1 - len(set(words)) / n, float(again > 0), float(not words), min(n, 200) / 50, float(n < 4), float(n > 1 and words[0] == words[1]),
        ))
        sizes.append(size + 1)
    return np.array(rows, np.float32), np.array(sizes, np.float32)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    near = own[:, NEAR]
    none = np.zeros((1, len(NEAR)), np.float32)
    return np.hstack([own, np.vstack([none, near[:-1]]), np.vstack([near[1:], none])])


class Crf:
    """Two labels, 1 is bad. w: WIDTH weights for bad against good; pair: scores of neighbouring labels."""

    def __init__(self, w: np.ndarray | None = None, pair: np.ndarray | None = None, platt: tuple[float, float] = (0.0, 0.0)):
        self.w = np.zeros(WIDTH) if w is None else w
        self.pair = np.zeros((2, 2)) if pair is None else pair
        self.platt = platt

    def marginals(self, e: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(bad) of each line, and expected counts of label pairs, of documents in rows of e (padded; mask tells lines)."""
        d, t = e.shape
        emit = np.stack([np.zeros_like(e), e], -1)
        fwd, bwd = np.empty((d, t, 2)), np.zeros((d, t, 2))
        fwd[:, 0] = emit[:, 0]
        for k in range(1, t):
            x = fwd[:, k - 1, :, None] + self.pair
            new = np.logaddexp(x[:, 0], x[:, 1]) + emit[:, k]
            fwd[:, k] = np.where(mask[:, k, None], new, fwd[:, k - 1])
        for k in range(t - 2, -1, -1):
            x = self.pair + (emit[:, k + 1] + bwd[:, k + 1])[:, None, :]
            new = np.logaddexp(x[:, :, 0], x[:, :, 1])
            bwd[:, k] = np.where(mask[:, k + 1, None], new, bwd[:, k + 1])
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        bad = np.exp(np.minimum(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None], 0))
        pairs = np.zeros((2, 2))
        if t > 1:
            x = fwd[:, :-1, :, None] + self.pair + (emit[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]
            pairs = (np.exp(np.minimum(x, 0)) * mask[:, 1:, None, None]).sum(axis=(0, 1))
        return bad * mask, pairs


def _blocks(docs: list[tuple[np.ndarray, np.ndarray]], cells: int = 60_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of like length together: their places, padded features, mask."""
    order = sorted(range(len(docs)), key=lambda k: len(docs[k][0]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(docs[order[end]][0]) <= cells:
            end += 1
        ks = order[at:end]
        t = len(docs[ks[-1]][0])
        x, mask = np.zeros((len(ks), t, WIDTH), np.float32), np.zeros((len(ks), t), bool)
        for i, k in enumerate(ks):
            n = len(docs[k][0])
            x[i, :n], mask[i, :n] = docs[k][0], True
        yield np.array(ks), x, mask
        at = end


def line_marginals(crf: Crf, docs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.zeros(0)] * len(docs)
    for ks, x, mask in _blocks(docs):
        bad, _ = crf.marginals(x @ crf.w, mask)
        for i, k in enumerate(ks):
            out[k] = bad[i, : len(docs[k][0])]
    return out


def _level(bad: np.ndarray, sizes: np.ndarray) -> float:
    """Log odds of the length-weighted share of good lines."""
    good = float(((1 - bad) * sizes).sum() / sizes.sum())
    good = min(max(good, 1e-4), 1 - 1e-4)
    return float(np.log(good / (1 - good)))


def train(docs: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, weight: np.ndarray, rounds: int = 3, steps: int = 60, l2: float = 1e-3) -> Crf:
    crf, blocks = Crf(), list(_blocks(docs))
    line = [np.full(len(x), 0.0 if g else 1.0) for (x, _), g in zip(docs, good)]
    for turn in range(rounds):
        m1, m2, v1, v2, step = np.zeros(WIDTH), np.zeros((2, 2)), np.zeros(WIDTH), np.zeros((2, 2)), 0
        want = []
        for ks, x, mask in blocks:
            y = np.zeros(mask.shape)
            for i, k in enumerate(ks):
                y[i, : len(line[k])] = line[k]
            two = np.stack([1 - y, y], -1)
            want.append((y, (two[:, :-1, :, None] * two[:, 1:, None, :] * mask[:, 1:, None, None]).sum(axis=(0, 1))))
        total = sum(len(x) for x, _ in docs)
        for _ in range(steps):
            gw, gp = l2 * crf.w, l2 * crf.pair
            for (ks, x, mask), (y, pairs) in zip(blocks, want):
                bad, seen = crf.marginals(x @ crf.w, mask)
                gw = gw + np.tensordot(bad - y, x, axes=((0, 1), (0, 1))) / total
                gp = gp + (seen - pairs) / total
            step += 1
            m1, m2, v1, v2 = 0.9 * m1 + 0.1 * gw, 0.9 * m2 + 0.1 * gp, 0.99 * v1 + 0.01 * gw**2, 0.99 * v2 + 0.01 * gp**2
            c1, c2 = 1 - 0.9**step, 1 - 0.99**step
            crf.w = crf.w - 0.15 * (m1 / c1) / (np.sqrt(v1 / c2) + 1e-8)
            if turn:  # the first labels of bad documents' lines say nothing about neighbours
                crf.pair = crf.pair - 0.15 * (m2 / c1) / (np.sqrt(v2 / c2) + 1e-8)
        for k, bad in enumerate(line_marginals(crf, docs)):
            if not good[k]:
                line[k] = (bad > 0.1).astype(float)
                line[k][int(np.argmax(bad))] = 1.0
    x = np.array([_level(b, s) for b, (_, s) in zip(line_marginals(crf, docs), docs)])
    a, b = 0.0, 0.0
    for _ in range(50):  # Newton steps of the logistic regression
        p = 1 / (1 + np.exp(-(a * x + b)))
        h, g = weight * p * (1 - p) + 1e-9, weight * (p - good)
        m = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-2]])
        da, db = np.linalg.solve(m, [(g * x).sum() + 1e-2 * a, g.sum() + 1e-2 * b])
        a, b = a - da, b - db
    crf.platt = (float(a), float(b))
    return crf


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2500) -> Crf:
    sample, sizes = labelled_sample(docs, labels, "quality", per_class)
    feats = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("own", pa.binary()), ("sizes", pa.binary())])

    def extract(b: pa.RecordBatch) -> pa.RecordBatch:
        f = [own_features(t.as_py()) for t in b.column(1)]
        return rows_batch(feats, [b.column(0), b.column(2), [x.tobytes() for x, _ in f], [s.tobytes() for _, s in f]])

    def learn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted([r for b in it for r in zip(*[c.to_pylist() for c in b.columns])])
        good = np.array([r[1] for r in rows])
        if len(set(good.tolist())) == 2:
            data = [(with_neighbours(np.frombuffer(o, np.float32).reshape(-1, OWN)), np.frombuffer(s, np.float32)) for _, _, o, s in rows]
            weight = np.where(good == 1, sizes.get(1, 0) / good.sum(), sizes.get(0, 0) / (1 - good).sum())
            yield rows_batch(pa.schema([("model", pa.binary())]), [[pickle.dumps(train(data, good, weight / weight.mean()))]])

    got = map_batches(sample, extract, "doc_id long, y int, own binary, sizes binary").repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(bytes(got[0].model)) if got else Crf()


def score_texts(crf: Crf, batch: list[str]) -> tuple[list[float], list[np.ndarray]]:
    """Quality and lines' P(bad) of each text."""
    own = [own_features(t) for t in batch]
    docs = [(with_neighbours(o), s) for o, s in own]
    bad = line_marginals(crf, docs)
    a, b = crf.platt
    return [float(1 / (1 + np.exp(-np.clip(a * _level(x, s) + b, -30, 30)))) for x, (_, s) in zip(bad, docs)], bad


def scores(docs: DataFrame, crf: Crf, threshold: float = 0.7) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[float] = []
        for k in range(0, b.num_rows, 500):
            out += score_texts(crf, b.column(1).slice(k, 500).to_pylist())[0]
        return rows_batch(schema, [b.column(0), out])

    scored = map_batches(texts(docs), run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
