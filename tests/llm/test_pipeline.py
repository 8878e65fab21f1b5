import numpy as np
import public_tokenizers

import corpus_pipeline
from treelake.llm import packing, pii, quality_rules, simhash

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    from treelake.llm.common import read

    docs = read(spark, SF, "documents")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    first = corpus_pipeline.quality(spark, docs, SF).cache()
    limits = quality_rules.fit(quality_rules.statistics(docs), read(spark, SF, "labels"))
    want = {k for k, r in rows.items() if quality_rules.kept(quality_rules.counts(r.text), limits.of(r.lang))}
    assert {r.doc_id for r in first.collect()} == want and first.columns == columns

    second = corpus_pipeline.near_duplicates(spark, first, SF).cache()
    ids = sorted(want)
    fps = {k: simhash.fingerprint(rows[k].text) for k in ids}
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in ids:
        for b in ids:
            if b < a and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r.doc_id for r in second.collect()} == {find(k) for k in ids} and second.columns == columns

    third = corpus_pipeline.long_repeats(spark, second, SF).cache()
    texts = {r.doc_id: r.text.encode() for r in second.collect()}
    seen: dict[bytes, int] = {}
    n = corpus_pipeline.REPEAT_BYTES
    for t in texts.values():
        for k in range(len(t) - n + 1):
            seen[t[k : k + n]] = seen.get(t[k : k + n], 0) + 1
    got = {r.doc_id: r for r in third.collect()}
    assert got.keys() == texts.keys() and third.columns == columns
    for k, t in texts.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        assert got[k].text == np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", "ignore") and got[k].n_chars == len(got[k].text)

    fourth = corpus_pipeline.personal_data(spark, third, SF).cache()
    assert fourth.columns == columns and fourth.count() == len(texts)
    for r in fourth.collect():
        assert not [s for s in pii.base_spans(r.text) if s[0] == 0] and r.n_chars == len(r.text)
    last = corpus_pipeline.packed(spark, fourth, SF)
    assert {r.doc_id for r in last.collect()} == texts.keys() and last.columns == list(packing.OUT)


def test_run(spark):
    import os

    from treelake.llm import common

    out = corpus_pipeline.run(spark, SF).collect()
    mine = [common.local_path(p) for p in common.SCRATCH]
    assert any(os.path.isdir(p) for p in mine)
    common.clear_scratch(spark)
    assert not any(os.path.isdir(p) for p in mine)
    assert out and len(corpus_pipeline.STAGES) == 5 and public_tokenizers.path("byte_bpe_50k.json")


def _tables(spark, folder, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, _uid string, spans long, _stay long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_tables(spark, tmp_path):
    import random

    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdeort") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    same, passage = prose(250), prose(60)
    texts = {1: same, 2: same, 3: None, 4: "", 5: "short", 6: prose(80) + " mail a.b@c.org now", 7: prose(3000), 8: prose(60) + " " + passage + " " + prose(40), 9: prose(50) + " " + passage + " " + prose(70)}
    rows = [(k, t, None if k % 2 else "en", "s", len(t or ""), f"u{k}", k, k) for k, t in texts.items()]
    rows += [rows[0], rows[6], (None, prose(40), "en", None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    sf = _tables(spark, tmp_path / "odd", rows, [(1, 1, 0), (1, 0, 0), (None, 1, 0), (777, 1, 1)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = corpus_pipeline.quality(spark, docs, sf)
    assert sorted(str(r.doc_id) for r in first.collect()) == sorted(map(str, [1, 1, 2, 6, 7, 7, 8, 9, None]))
    second = corpus_pipeline.near_duplicates(spark, first, sf)
    assert sorted(str(r.doc_id) for r in second.collect()) == sorted(map(str, [1, 6, 7, 8, 9, None]))
    third = {r.doc_id: r for r in corpus_pipeline.long_repeats(spark, second, sf).collect()}
    assert third[1].text == same and third[7].text == texts[7] and passage not in third[8].text and passage not in third[9].text
    assert third[8].n_chars == len(third[8].text) and (third[8]._uid, third[8].spans, third[8]._stay) == ("u8", 8, 8)
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == {1, 6, 7, 8, 9, None}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in out if r.doc_id == 7) == len(t.encode(texts[7], add_special_tokens=False).ids) + 1


def test_empty_tables(spark, tmp_path):
    sf = _tables(spark, tmp_path / "none", [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == 0
