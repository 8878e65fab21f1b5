import random

import numpy as np
import pytest

from treelake.llm import quality_crf, toxicity
from treelake.llm.common import held_out, labelled_sample

RUDE = ["idiot", "moron", "scum"]


def _words(rng, n):
    return " ".join(rng.choice(["the", "and", "house", "river", "of", "walk", "green", "seven"]) + rng.choice(["", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng, docs, labels = random.Random(0), [], []
    for k in range(500):
        lines = [_words(rng, rng.randrange(5, 30)) for _ in range(rng.randrange(1, 6))]
        toxic, bad = k % 5 == 0, k % 7 == 0
        if toxic:
            lines[-1] += f" you {rng.choice(RUDE)} there {rng.choice(RUDE)}"
        if bad:
            lines += ["### ".join(_words(rng, 12).split()) + "###", _words(rng, 9).upper().replace(" ", "!! ")] * 2
        docs.append((k, "\n".join(lines), k))
        labels.append((k, 0 if bad else 1, int(toxic)))
    docs += [(1000, None, 1), (1001, "", 1), (1, docs[1][1], 1), (None, "no id", 0)]
    labels += [(None, 1, 0), (2000, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, y long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def _auc(rows, truth):
    pos = [r.score for r in rows if r.held_out and truth.get(r.doc_id) == 1]
    neg = [r.score for r in rows if r.held_out and truth.get(r.doc_id) == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def test_held_out_rows_are_never_learned_from(spark, corpus):
    docs, labels = corpus
    sample, sizes = labelled_sample(docs, labels, "toxic", 20)
    rows = sample.withColumn("h", held_out(sample.doc_id)).collect()
    assert rows and not any(r.h for r in rows) and sum(r.y for r in rows) <= 20 and sizes[0] > 200
    many = docs.unionByName(spark.createDataFrame([(rows[0].doc_id, f"another text {k}", 0) for k in range(500)], docs.schema))
    again = labels.unionByName(spark.createDataFrame([(k, 1, 1) for k in range(5000, 9000)], labels.schema))
    sample, more = labelled_sample(many, again, "toxic", 20)  # ids without a document, and one with very many rows
    assert {r.doc_id for r in sample.collect()} == {r.doc_id for r in rows} and sample.count() == len(rows) and more == sizes
    assert {r.h for r in docs.where("doc_id is null").select(held_out(docs.doc_id).alias("h")).collect()} == {False}


def test_toxicity(spark, corpus):
    docs, labels = corpus
    rows = toxicity.scores(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == 504 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert _auc(rows, {r.doc_id: r.toxic for r in labels.collect()}) > 0.97
    at, w = toxicity.fit(docs, labels)
    assert 0 < len(at) < 5000  # L1 keeps few weights
    empty = toxicity.scores(docs, toxicity.fit(docs, labels.where("false"))).collect()
    assert {r.score for r in empty} == {0.5}
    assert toxicity.scores(docs.where("false"), (at, w)).count() == 0


def test_ftrl_follows_a_plain_rule():
    a, b = toxicity.Ftrl(l1=0.0), toxicity.Ftrl(l1=1e9)
    for k in range(50):
        for m in (a, b):
            m.learn(np.array([0, 1 + k % 2]), k % 2, 1.0)
    wa, wb = a.weights(), b.weights()
    assert wa[2] > 0.5 > -0.5 > wa[1] and not np.flatnonzero(wb[1:]).size


def test_quality(spark, corpus):
    docs, labels = corpus
    crf = quality_crf.fit(docs, labels)
    rows = quality_crf.scores(docs, crf).collect()
    assert len(rows) == 504 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert _auc(rows, {r.doc_id: r.quality for r in labels.collect()}) > 0.97
    _, bad = quality_crf.score_texts(crf, [_words(random.Random(1), 20) + "\n" + "AB!! CD!! EF!! GH!! IJ!! KL!!"])
    assert bad[0][1] > bad[0][0]
    assert {r.score for r in quality_crf.scores(docs, quality_crf.fit(docs, labels.where("quality = 1"))).collect()} == {0.5}
    assert quality_crf.scores(docs.where("false"), crf).count() == 0


def test_other_scripts_are_letters():
    good = "Сегодня хорошая погода, и мы идём гулять к реке.\nДети играют в саду."
    x, _ = quality_crf.own_features(good)
    y, _ = quality_crf.own_features("Today good weather, and we go walking to river.\nKids play in garden.")
    assert x[:, 4].max() == 0 and np.abs(x[:, 2] - y[:, 2]).max() < 0.05 and x[:, 8].max() == 0
    z, _ = quality_crf.own_features("ДА!! НЕТ!! ДА!!\n今天天气很好\n" + "😀 😀")
    assert z[0, 4] == 2 and z[0, 2] == 1 and z[0, 8] > 0 and z[1, 4] == z[2, 4] == 0 and z[2, 13] == 1


def test_marginals_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    crf = quality_crf.Crf(pair=rng.normal(size=(2, 2)))
    e = rng.normal(size=(1, 5))
    for n in (1, 3, 5):
        mask = np.arange(5)[None] < n
        bad, pairs = crf.marginals(e * mask, mask)
        z, p, c = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in product((0, 1), repeat=n):
            s = np.exp(sum(e[0, k] * y[k] for k in range(n)) + sum(crf.pair[y[k], y[k + 1]] for k in range(n - 1)))
            z += s
            p += s * np.array(y)
            for k in range(n - 1):
                c[y[k], y[k + 1]] += s
        assert np.allclose(bad[0, :n], p / z) and np.allclose(pairs, c / z)


def _plain_places(text):
    import re
    import zlib

    m, words = (1 << 64) - 1, re.findall(r"\w+", text.lower())
    h = [zlib.crc32(w.encode()) for w in words]
    out = [x * 0x9E3779B97F4A7C15 for x in h]
    for i, n in enumerate((4, 6)):
        out += [zlib.crc32(w[:n].encode(), n) * 0x9E6C63D0876A9A47 + i for w in words]
    out += [((a * 0xBF58476D1CE4E5B9 & m) ^ b) * 0x94D049BB133111EB for a, b in zip(h, h[1:])]
    out += [((a * 0xD6E8FEB86659FD93 & m) ^ b) * 0xC2B2AE3D27D4EB4F for a, b in zip(h, h[2:])]
    return {((x & m) >> 44) + 1 for x in out}


def _plain_ftrl(rows, sizes, alpha=0.2, beta=1.0, l1=3.0, l2=1.0):
    from math import exp, sqrt

    z, n = {}, {}

    def weight(k):
        zk, bound = z.get(k, 0.0), l1 if k else 0.0
        return 0.0 if abs(zk) <= bound else -(zk - (bound if zk > 0 else -bound)) / ((beta + sqrt(n.get(k, 0.0))) / alpha + l2)

    have = [sum(y == k for _, y in rows) for k in (0, 1)]
    part = [sizes[k] / have[k] for k in (0, 1)]
    random_ = np.random.default_rng(0)
    for _ in range(3):
        for i in random_.permutation(len(rows)):
            places, y = rows[i]
            w = {k: weight(k) for k in places}
            g = (1 / (1 + exp(-max(-30, min(30, sum(w.values()))))) - y) * part[y] / min(part)
            for k in places:
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (sqrt(old + g * g) - sqrt(old)) / alpha * w[k]
                n[k] = old + g * g
    return {k: w for k in z if (w := weight(k))}


def test_toxicity_query_against_plain_python(spark):
    """The whole query on a small table: the same features, weights and scores by dictionaries."""
    import math
    import zlib

    from treelake.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    known = sorted(k for k in labels if k in docs and zlib.crc32(str(k).encode()) % 4 != 2)
    rows = [({0} | _plain_places(docs[k]), labels[k]) for k in known]
    sizes = {y: sum(labels[k] == y for k in known) for y in (0, 1)}
    w = _plain_ftrl(rows, sizes)
    for r in queries.op2_toxicity(spark, sf).collect():
        s = sum(w.get(k, 0.0) for k in {0} | _plain_places(docs[r.doc_id]))
        assert abs(r.score - 1 / (1 + math.exp(-s))) < 1e-5 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
