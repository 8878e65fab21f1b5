import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from treelake.llm import mpeg_audio, packing, pii, quality_rules, sentencepiece_codec, simhash, suffix_dedup, token_store
from treelake.llm.bpe_words import WordTokenizer

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "     ", "\n", "a", "  Hello   world \n\n x", "a　b ﬁ①é é \0 \t\r\n😀 ▁x ▁", "<s> </s> <unk> <|endoftext|> x", "x\n\ny ", "don't 've\n's", "①②", "word " * 500, "a" * 5000, "中文没有空格" * 50]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a null, a repeated row, and a column whose name clashes with what the operators use."""
    rows = [(k, t, "en", "s", len(t), k) for k, t in enumerate(ODD)] + [(100, None, None, None, None, 1), (4, "a", "en", "s", 1, 4), (None, "no id", "en", "s", 5, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _uid long")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def test_sentencepiece_equals_the_library(spark, odd, none):
    import sentencepiece

    sp, c = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_codec.PrefixTableCodec(PIECES)
    rng = random.Random(0)
    for t in ODD + ["".join(rng.choice("ab the▁①é\n.") for _ in range(rng.randrange(40))) for _ in range(3000)]:
        e = sp.encode(t)
        assert c.encode(t) == e and c.decode(e) == sp.decode(e)
        assert c.digests([t])[0] == (len(e) + 1, " ".join(map(str, [*e, 2])), sp.decode([*e, 2]))
    pairs = [rng.sample(list(c.split), 2) for _ in range(3000)]
    for a, b in pairs:
        if not sp.id_to_piece(b).startswith("▁"):
            assert c.compatible(a, b) == (c._agenda(sp.id_to_piece(a) + sp.id_to_piece(b))[0] == [a, b])
    got = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in sentencepiece_codec.digests(odd, PIECES).collect()}
    assert (100, 1, hashlib.sha256(b"").hexdigest()) in got and len(got) == len(ODD) + 2
    r = sentencepiece_codec.encode_column(odd.where("doc_id = 5"), PIECES).first()
    assert r.ids == [*sp.encode(ODD[5]), 2] and r.decoded == ODD[5]
    assert sentencepiece_codec.digests(none, PIECES).count() == 0


def test_words_equal_the_library():
    from tokenizers import Tokenizer

    w, t, rng = WordTokenizer(BYTES), Tokenizer.from_file(BYTES), random.Random(1)
    texts = ODD + ["".join(rng.choice("ab'st 1.\n é<|_ñ×") for _ in range(rng.randrange(30))) for _ in range(5000)]
    for a, ids in zip(texts, w.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(a, add_special_tokens=False).ids, a


def test_packing(odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    rows = packing.pack(odd, BYTES, size=64, open_windows=4, merge_partitions=2).collect()
    windows, docs = {}, Counter()
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs[r.doc_id] += r.length
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= 64
    for k, text in enumerate(ODD):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert docs[k] == len(ids) * (2 if k == 4 else 1)
        for r in rows:
            if r.doc_id == k:
                assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert packing.pack(none, BYTES).count() == 0
    p = packing.Packer(10, 2)
    assert [p.place(n) for n in (6, 7, 3, 4, 5)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]
    assert sum(packing.Packer(8, 3).place(8)[1] for _ in range(3)) == 0


def test_token_store(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    manifest = token_store.write(odd, BYTES, f"file://{tmp_path}/store")
    rows = token_store.read_back(spark, manifest).collect()
    ids = {k: np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4") for k, x in enumerate(ODD)}
    order = [(None, "no id")] + sorted([*enumerate(ODD), (4, "a"), (100, "")])
    hot = spark.createDataFrame([(7, "same")] * 900 + [(None, "none")] * 900, "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = token_store.write(hot, BYTES, f"file://{tmp_path}/hot").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r.docs for r in files) == 1800 and max(r.docs for r in files) < 900
    at = 0
    for (k, text), r in zip(order, sorted(rows, key=lambda r: r.start)):
        want = ids.get(k, np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4"))
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    for path in [r.file for r in manifest.collect()]:
        r = token_store.Reader(path)
        for k in ids:
            if (got := r.find(k)) is not None:
                assert got.tolist() == ids[k].tolist()
        assert r.find(12345) is None
    assert token_store.store_and_read(none, BYTES).count() == 0
    samples = [np.array([k, 5, 6, 7] * 50, "<u2").tobytes() for k in range(400)]
    d = token_store.train(samples, 2048)
    (tmp_path / (hashlib.sha256(d).hexdigest() + ".dict")).write_bytes(d)
    w = token_store.Writer(str(tmp_path / "x.tok"), 2, d)
    for k in range(5):
        w.add(k, np.array([k, 5, 6, 7], "<u4").tobytes())
    assert w.close() == 20 and token_store.Reader(str(tmp_path / "x.tok")).find(3).tolist() == [3, 5, 6, 7]
    (tmp_path / (hashlib.sha256(d).hexdigest() + ".dict")).write_bytes(d + b"x")
    with pytest.raises(ValueError):
        token_store.Reader(str(tmp_path / "x.tok"))


def test_quality_counts_against_brute_force(spark, odd, none):
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice("ab#") for _ in range(rng.randrange(60))).replace("a b", "a\nb") for _ in range(300)] + ["x\x1cy z\x85w\xa0v\n\n\nx\x1cy z\x85w\xa0v"]
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c, marked = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)), set()
        for k in range(len(w) - 4):
            if c[tuple(w[k : k + 5])] > 1:
                marked |= set(range(k, k + 5))
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        assert quality_rules.counts(t)[:5] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked))
    labels = spark.createDataFrame([(k, 1) for k in range(14)], "doc_id long, quality int")
    v = quality_rules.verdicts(odd, labels).collect()
    assert len(v) == len(ODD) + 3 and all(r.base_failed or r.kept for r in v)  # too few labels for any cutoff
    kept = quality_rules.filter_documents(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in v)
    assert quality_rules.verdicts(none, labels).count() == 0 and quality_rules.filter_documents(none, labels).count() == 0
    assert quality_rules.verdicts(odd, labels.where("false")).count() == len(ODD) + 3


def test_risk_control():
    assert quality_rules.too_risky(0, 50, 0.02, 0.05) and not quality_rules.too_risky(0, 200, 0.02, 0.05) and quality_rules.too_risky(3, 200, 0.02, 0.05)
    exact = lambda e, n, p: sum(__import__("math").comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(e + 1))
    for e, n in ((0, 30), (2, 300), (5, 400)):
        assert quality_rules.too_risky(e, n, 0.02, 0.05) == (exact(e, n, 0.02) > 0.05)


def test_risk_controlled_cutoffs(spark):
    rows = [(k, "en", k, 100, 500, 0 if k % 100 else 60, 0, 0, 5) for k in range(3000)] + [(9000 + k, "en", 9000 + k, 100, 500, 400, 0, 0, 5) for k in range(50)]
    stats = spark.createDataFrame(rows, "doc_id long, lang string, key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    limits = quality_rules.fit(stats, spark.createDataFrame([(k, 1) for k in range(3000)], "doc_id long, quality int"), risk=0.02).of("en")
    assert limits[0] == 0.75  # one good document in a hundred has 0.6 symbols a word, which is over the risk
    assert quality_rules.fit(stats, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).of("en") is None


def test_small_strata_have_joint_cutoffs(spark):
    langs = {"de": 437, "es": 436, "fr": 1000, "en": 1642}
    rows = [(10_000 * i + k, lang, 10_000 * i + k, 100, 500, 60 if lang == "fr" and k < 9 else 0, 0, 0, 5) for i, (lang, n) in enumerate(langs.items()) for k in range(n)]
    stats = spark.createDataFrame(rows, "doc_id long, lang string, key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    found = quality_rules.fit(stats, stats.selectExpr("doc_id", "1 AS quality"))
    assert found.of("de") == found.of("en") == (0.2, 0.3, 0.08) and found.of("es") == (float("inf"),) * 3
    assert found.of("fr")[0] == 0.75  # nine of a thousand have 0.6 symbols a word, too many for an upper bound of a hundredth
    assert all(x >= y for a, b in zip(quality_rules.JOINT, quality_rules.JOINT[1:]) for x, y in zip(a, b))


def test_copies_and_null_strata_of_quality_rules(spark):
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    text = lambda k: " ".join(w + ("" if k % 50 or i > 13 else "#") for i, w in enumerate(words(20)))
    texts = [text(k) for k in range(1000)]
    rows = [(k, t, None) for k, t in enumerate(texts)] + [(1000 + k, texts[1], None) for k in range(3000)] + [(9000 + k, texts[k], "") for k in range(300)] + [(20_000 + k, "x " * k, f"rare{k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    limits = quality_rules.fit(quality_rules.statistics(docs), labels)
    # two in a hundred of the distinct texts have 0.7 symbols a word; with each copy counted it would be one in two hundred
    assert limits.of(None)[0] == 0.75 and limits.of("rare3") is None and limits.of(None) != limits.of("")
    v = {r.doc_id: r.kept for r in quality_rules.verdicts(docs, labels).collect()}
    kept = {r.doc_id for r in quality_rules.filter_documents(docs, labels).collect()}
    assert len(v) == len(rows) and {k for k, x in v.items() if x} == kept and all(k in kept for k in range(1000))
    odd = docs.limit(50).selectExpr("*", "1 AS _counts", "2 AS _limits", "3 AS _lang", "4 AS key")
    assert quality_rules.filter_documents(odd, labels).columns == odd.columns and {tuple(r)[3:] for r in quality_rules.filter_documents(odd, labels).collect()} == {(1, 2, 3, 4)}


def _linked(fps):
    near, root = Counter(), list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                near[a] += 1
                near[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return near, [find(k) for k in range(len(fps))]


def test_simhash_against_brute_force(spark, odd, none):
    rng = random.Random(3)
    words = ["w%d" % k for k in range(50)]
    base = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(12)]
    texts = [b.replace(" w1 ", " w2 ", k) for b in base for k in range(6)] + ["", "A b", "a B", "", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = [simhash.fingerprint(t) for t in texts]
    near, roots = _linked(fps)
    got = {r.doc_id: (r.fingerprint, r.n_near, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {k: ("%016x" % f, near[k], roots[k]) for k, f in enumerate(fps)} and sum(near.values()) > 50
    kept = simhash.keep_one(docs)
    assert {r.doc_id for r in kept.collect()} == set(roots) and kept.columns == docs.columns
    assert simhash.near_duplicates(odd).count() == len(ODD) + 3 and simhash.near_duplicates(none).count() == 0
    assert "no id" in {r.text for r in simhash.keep_one(odd).collect()}
    assert simhash.keep_one(none).count() == 0
    rows = [(1, "x y z w", 7, "s"), (1, "x y z w", 7, "s"), (2, "x y z w", 8, "t"), (3, "other words are here", 9, "u"), (None, "null id", 1, "v"), (None, "null id", 1, "v")]
    same = spark.createDataFrame(rows, "doc_id long, text string, _stay long, fp string")
    assert sorted(map(tuple, simhash.keep_one(same).collect()), key=str) == sorted({rows[0], rows[3], rows[4]}, key=str)
    assert simhash.fingerprint("") == 0 and simhash.fingerprint("A b") == simhash.fingerprint("a b")


def test_simhash_links_for_every_allocation(spark, monkeypatch):
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(60)}
    fps |= {f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for f in list(fps) for _ in range(3)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    d = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    bits = np.zeros((0, 64))
    for parts in ([(list(range(64)), 3)][:0] or simhash.allocate(bits, 1000), [(list(range(32)), 1), (list(range(32, 64)), 1)], [(list(range(20)), 1), (list(range(20, 42)), 0), (list(range(42, 64)), 0)]):
        monkeypatch.setattr(simhash, "allocate", lambda *a, p=parts: p)
        for hot in (2000, 0, 3):
            found = [(r.a, r.b) for r in simhash.links(d, hot=hot).collect()]
            assert len(found) == len(set(found)) and set(found) == want
    monkeypatch.undo()
    for n in (10, 10**6, 10**9):
        parts = simhash.allocate(bits, n)
        assert sum(t + 1 for _, t in parts) >= 4  # generalised pigeonhole: thresholds of m parts sum to 3 - m + 1


def test_common_keys_are_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MANY", 3)
    e = spark.createDataFrame([(0, k) for k in range(1, 40)] + [(50, 51)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(e).collect()} == {(k, 0) for k in range(40)} | {(50, 50), (51, 50)}
    docs = spark.createDataFrame([(k, "" if k % 3 else f"word {k}") for k in range(30)], "doc_id long, text string")
    got = {r.doc_id: (r.n_near, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {k: (19, 1) if k % 3 else (0, k) for k in range(30)}


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(e).collect()} == {(k, 0) for k in range(61)} | {(100, 100), (101, 100)}


def _removed(texts, length):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        out.append(gone)
    return out


def _repeat_rows():
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        t = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 300)))
        for _ in range(rng.randrange(3)):
            if texts and (s := rng.choice(texts)):
                k = rng.randrange(len(s))
                at = rng.randrange(len(t) + 1)
                t = t[:at] + s[k : k + rng.randrange(20, 120)] + t[at:]
        texts.append(t)
    texts += ["a" * 500, "ab" * 300, texts[3], ""]
    return [*enumerate(texts), (3, texts[3]), (1, "same id, another text " * 5), (None, texts[7]), (5000, None)]


def _digest_rows(rows, length, short):
    every = [(t or "").encode() for _, t in rows]
    long_, less = _removed(every, length), _removed(every, short)
    out = [(k, len(t), int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~g].tobytes()).hexdigest(), int(h.sum()), bool(h.any())) for (k, _), t, g, h in zip(rows, every, long_, less)]
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [5000, 1])
@pytest.mark.parametrize("short", [20, 40])
def test_suffix_dedup_against_brute_force(spark, hot, short):
    rows = _repeat_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = _digest_rows(rows, 40, short)
    assert sorted(map(tuple, suffix_dedup.digests(docs, 40, short, hot).collect()), key=str) == want and sum(w[2] for w in want) > 1000


def _passages():
    """Texts of invented words with passages of 300 to 900 bytes in common, near copies, copies, and one of 100,000 characters."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeéorst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [prose(n) for n in (50, 70, 90, 150)]
    texts = [" ".join([prose(rng.randrange(5, 200)), rng.choice(shared), prose(rng.randrange(5, 100))]) if k % 3 else prose(150) for k in range(60)]
    texts += [texts[0]] * 5 + [texts[k][:300] + "X" + texts[k][301:] for k in range(6)] + [prose(20_000)] + [prose(30) + " line\n"] * 3
    return [(k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("hot", [5000, 2])
def test_suffix_dedup_at_its_own_lengths(spark, hot):
    rows = _passages()
    got = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot=hot).collect()
    assert sorted(map(tuple, got), key=str) == _digest_rows(rows, 400, 200)


def test_suffix_index_takes_batches(spark, tmp_path):
    rows = _passages()
    for k in range(3):
        index = suffix_dedup.SuffixIndex(spark, f"file://{tmp_path}/index", buckets=3)
        index.add(spark.createDataFrame(rows[k::3], "doc_id long, text string"))
        assert sorted(map(tuple, index.digests().collect()), key=str) == _digest_rows([r for i in range(k + 1) for r in rows[i::3]], 400, 200)
    index.add(spark.createDataFrame([], "doc_id long, text string"))
    again = suffix_dedup.SuffixIndex(spark, f"file://{tmp_path}/index")
    assert again.batches == 4 and again.digests().count() == len(rows)
    sizes = [n.bit_length() for _, n in again.levels]
    assert sizes == sorted(set(sizes), reverse=True)


def test_removed_repeats_keep_clashing_columns(spark):
    rows = [(k, t, f"{k}u", k, [k], k) for k, t in _passages()[:70]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _uid string, _tag long, spans array<long>, _spans long")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, 200).collect()}
    gone = _removed([t.encode() for _, t in _passages()[:70]], 200)
    for (k, t, u, g, s, z), x in zip(rows, gone):
        assert tuple(got[k]) == (k, np.frombuffer(t.encode(), np.uint8)[~x].tobytes().decode("utf-8", "ignore"), u, g, s, z)
    assert suffix_dedup.remove_repeats(docs.where("false")).count() == 0


def test_suffix_arrays_against_pairs():
    rng = random.Random(2)
    contexts = [("".join(rng.choice("ab") for _ in range(8)).encode(), b"K" + "".join(rng.choice("ab") for _ in range(rng.randrange(3, 9))).encode()) for _ in range(120)]
    arrays = suffix_dedup.SuffixArrays()
    for k in range(0, 120, 7):
        arrays.add([(r, le[::-1], k + i) for i, (le, r) in enumerate(contexts[k : k + 7])])
        sizes = [len(x).bit_length() for x in arrays.levels]
        assert sizes == sorted(set(sizes), reverse=True) and all(x == sorted(x) for x in arrays.levels)
    got = suffix_dedup.repeated_starts(arrays, np.zeros(120, int), np.full(120, 4), (6, 8))
    for length, (number, before) in zip((6, 8), got):
        strings = {(k, o): (le + r)[8 - o : 8 - o + length] for k, (le, r) in enumerate(contexts) for o in range(5) if len(r) >= length - o}
        counts = Counter((o, s) for (_, o), s in strings.items())
        assert {*zip(number.tolist(), before.tolist())} == {(k, o) for (k, o), s in strings.items() if counts[o, s] > 1}


def test_suffix_dedup_edges(odd, none):
    assert suffix_dedup.digests(odd).count() == len(ODD) + 3 and suffix_dedup.digests(none).count() == 0
    out = suffix_dedup.remove_repeats(odd)
    assert out.columns == odd.columns and {r.text for r in out.where("doc_id = 100").collect()} == {None}
    assert sorted(map(str, out.select("doc_id", "_uid").collect())) == sorted(map(str, odd.select("doc_id", "_uid").collect()))
    levels = suffix_dedup.Levels()
    rng = np.random.default_rng(0)
    keys = [rng.integers(0, 50, 7).astype(np.uint64) for _ in range(20)]
    for k in keys:
        levels.add(k, k)
    every = np.concatenate(keys)
    twice, first = levels.result()
    counts = Counter(every.tolist())
    assert twice.tolist() == [counts[k] > 1 for k in every.tolist()] and first.sum() == len(counts)
    sizes = [len(x[0]).bit_length() for x in levels.levels]
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _base(t):
    ok = {"email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": lambda s: 16 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(d), "phone": lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15}
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, e in BASE.items() for m in re.finditer(e, t) if ok[k](m.group()))


def test_personal_data(odd, none):
    rng = random.Random(6)
    texts = ["a@b.c@d.e f", "x@y@z.w", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (743) 555-3824 +12", "1.2.3.4.5 256.1.1.1 001.2.3.4", "é a.b@c-d.ef."] + ["".join(rng.choice("a1.@+- (é4") for _ in range(40)) for _ in range(5000)]
    for t in texts:
        assert pii.written(pii.base_spans(t)) == _base(t), t
    assert pii.luhn("4111111111111111")
    assert pii.redacted("mail a@b.co now", [(0, 5, 11)]) == "mail <email> now"
    model = pii.fit(odd)
    assert pii.digests(odd, model).count() == len(ODD) + 3 and pii.digests(none, None).count() == 0 and pii.fit(none) is None
    out = pii.redact(odd, model)
    assert out.columns == odd.columns and out.count() == len(ODD) + 3
    assert pii.redact(none, model).count() == 0


def test_personal_data_of_long_texts():
    began = time.perf_counter()
    for t in ("1.1.1." + "0" * 5000, "8" * 10_000_000, "a" * 10_000_000 + "1", "1." * 500_000, "a@" * 300_000, "+1(" * 300_000, "12 " * 50_000):
        base, every = pii.all_spans(t, pii.SkipChainCrf())
        assert every == sorted(base)
    assert pii.written(pii.base_spans("1.1.1." + "0" * 5000)) == "ip:0:5006"
    assert time.perf_counter() - began < 60


def test_personal_data_query_against_plain_rules(spark):
    from treelake.llm import queries

    rows = queries.op6_pii(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = _base(texts[r.doc_id])
        kinds = Counter(x.split(":")[0] for x in base.split(",") if x)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in BASE) and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        spans = [x for x in r.spans.split(",") if x]
        assert {x for x in base.split(",") if x} <= {*spans} and r.n_spans == len(spans) and r.n_added == len(spans) - sum(kinds.values())
        assert spans == sorted(spans, key=lambda x: (pii.KINDS.index(x.split(":")[0]), int(x.split(":")[1])))


def test_the_field_finds_secrets_without_their_assignment(spark):
    rng = random.Random(3)
    secret = lambda: f"{rng.getrandbits(160):040x}"
    texts = [f"{rng.choice(['la', 'ble'])} token = \"{secret()}\" and {rng.randrange(10**9)} items" for _ in range(400)] + [f"plain {rng.randrange(10**6)} words, {k} of them" for k in range(400)]
    crf = pii.fit(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"))
    s, other = secret(), secret()
    t = f"here token = \"{s}\" and later {s} again, 12 times"
    assert pii.written(pii.all_spans(t, crf)[1]).count("secret:") == 2 and pii.base_spans(t) == []
    assert pii.redacted(t, pii.all_spans(t, crf)[1]).count("<secret>") == 2
    assert pii.all_spans("plain 12345 words, 7 of them", crf)[1] == [] and other


def test_loopy_marginals_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    crf = pii.SkipChainCrf()
    crf.near, crf.skip = rng.normal(size=(2, pii.LABELS, pii.LABELS)) * 0.5
    for text, exact in (("a1 b2 c3", True), ("x1 and y2 or x1", True), ("q7 w8 and q7 w8", False), ("a1 b2 a1 b2", False)):
        g = pii.Graph(text)
        scores = rng.normal(size=(len(g.x), pii.LABELS)) * 0.5
        crf.w[:] = 0
        for k in range(len(g.x)):
            g.x[k] = [k + 1]
            crf.w[k + 1] = scores[k]
        want, z = np.zeros_like(scores), 0.0
        for y in product(range(pii.LABELS), repeat=len(g.x)):
            e = np.exp(sum(scores[k, y[k]] for k in range(len(y))) + sum(crf.near[y[a], y[b]] for a, b in g.near) + sum(crf.skip[y[a], y[b]] for a, b in g.skip))
            z += e
            for k in range(len(y)):
                want[k, y[k]] += e
        assert (len(g.near) + len(g.skip) < len(g.x)) == exact, text
        assert np.abs(crf.marginals(g, [0] * len(g.x)) - want / z).max() < (1e-3 if exact else 0.05), text
    crf.near[:], crf.skip[:] = 0, 9 * np.eye(pii.LABELS)
    g = pii.Graph("z9 or " * 300)  # evidence at one end reaches the other
    crf.w[:] = 0
    assert crf.marginals(g, [2] + [0] * 299)[-1].argmax() == 2


def test_skip_chain_agrees_across_a_document(spark):
    rng = random.Random(7)
    number = lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    data = []
    for k in range(300):
        words = [rng.choice(["alpha", "beta", f"v{rng.randrange(9)}.{rng.randrange(9)}", f"id{rng.randrange(10**9):x}"]) for _ in range(12)]
        t = " ".join([*words[:6], number(), *words[6:]])
        g = pii.Graph(t)
        data.append((g, g.labels(pii.base_spans(t))))
    crf = pii.SkipChainCrf()
    crf.train(data)
    clean = "alpha beta v1.2 id3fa9c and v2.3"
    assert crf.added(clean, pii.base_spans(clean), 0.98) == []
    t = "call +1 (743) 555-3824 now"
    base = pii.base_spans(t)
    assert base and crf.added(t, base, 0.98) == []  # what a pattern found isn't added again
    p = crf.marginals(pii.Graph("x 555-3824 y v1.2 z 555-3824"), [0, 0, 0])
    assert np.allclose(p[0], p[2], atol=0.2) and np.allclose(p.sum(axis=1), 1)


def test_repeats_are_linked_over_plain_words():
    assert pii.Graph("call 555-3824 or later dial 555-3824").skip == [(0, 1)]
    g = pii.Graph("a1 a1 then a1 and b2 and a1")
    assert g.near == [(0, 1)] and g.skip == [(1, 2), (2, 4)]  # white space alone makes a near link; a group of 4 has 3 links


def test_sample_of_personal_data_is_drawn_from_all_rows(spark):
    rows = [(k, f"item {k} of 400") for k in range(400)] + [(k, f"call +1 (743) 555-{k} now") for k in range(1000, 1100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(8, "doc_id")
    model = pii.fit(docs, 60)
    for same in (docs.orderBy("doc_id", ascending=False), docs.unionByName(docs).repartition(3)):
        assert np.array_equal(pii.fit(same, 60).w, model.w)
    t = "call +1 (743) 555-3824 now"
    assert (model.marginals(pii.Graph(t), [0, 0, 0]).argmax(axis=1) == 4).all()
    assert pii.shares({0: 50, 1: 9}, 60) == {0: 50, 1: 9} and pii.shares({0: 9000, 1: 2, 8: 1000}, 100) == {0: 70, 1: 2, 8: 28}


def test_mpeg_audio(odd, none):
    rng = random.Random(8)
    for n in (0, 1, 63, 64, 65, 1416, 1417, 1418, 5000, 200_000):
        size, payload = mpeg_audio.payload_of("x" * n)
        assert size == n and len(payload) % 64 == 0 and len(payload) >= 64
        media = mpeg_audio.store(payload)
        m = mpeg_audio.parse(media)
        assert mpeg_audio.load(media) == payload and m.vbr["frames"] == len(m.frames) and m.vbr["bytes"] == len(media) - m.frames[0][0] + mpeg_audio.FRAMES[7][1]
        assert m.samples == 1152 * len(m.frames) and m.rate == 32000 and not m.crc_failed and not m.skipped
    body = rng.randbytes(9000)
    media = mpeg_audio.store(body)
    joined = b"junk\xff\xfb\x00" * 9 + media + b"TAG" + b"title".ljust(125, b"\0")
    m = mpeg_audio.parse(joined)
    assert len(m.frames) >= 7 and m.tags["ID3v1"] == "title" and m.skipped >= 60
    broken = bytearray(media)
    broken[mpeg_audio.parse(media).frames[2][0] + 7] ^= 1  # in side information, which the checksum covers
    assert mpeg_audio.parse(bytes(broken)).crc_failed == 1
    with pytest.raises(ValueError):
        mpeg_audio.load(bytes(broken))
    h = mpeg_audio.header(b"\xff\xfb\x90\x00")
    assert (h.bitrate, h.rate, h.size, h.samples, h.side) == (128000, 44100, 417, 1152, 32)
    assert mpeg_audio.header(b"\xff\xf3\x90\x00").samples == 576 and mpeg_audio.header(b"\xff\xff\xff\x00") is None
    assert mpeg_audio.parse(b"").samples == 0 and mpeg_audio.parse(rng.randbytes(2000)).samples < 5000
    assert mpeg_audio.digests(odd).count() == len(ODD) + 3 and mpeg_audio.digests(none).count() == 0
    r = mpeg_audio.probe(mpeg_audio.media_column(odd.where("doc_id = 12"))).first()
    assert r.samples == 1152 * len(r.offsets) and r.crc_failed == 0


def test_mpeg_query_against_another_writer(spark):
    """Media made anew from the public frame layout, bit by bit, for every text of a table."""
    from treelake.llm import queries

    sizes = {k: 144 * b // 32 for k, b in enumerate((0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)) if k}

    def crc(bits):
        c = 0xFFFF
        for bit in bits:
            c = (c << 1 ^ (0x8005 if (c >> 15) ^ bit else 0)) & 0xFFFF
        return c

    def frame(kbit, body):
        bits = "1" * 11 + "11" + "01" + "0" + f"{kbit:04b}" + "10" + "0" + "0" + "11" + "00" + "0" + "0" + "00"
        head = int(bits, 2).to_bytes(4, "big")
        covered = [int(x) for byte in head[2:] + bytes(17) for x in f"{byte:08b}"]
        return (head + crc(covered).to_bytes(2, "big") + bytes(17) + body).ljust(sizes[kbit], b"\0")

    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.op10_mpeg_audio(spark, "/root/testdata/sf0.001").collect():
        raw = docs[r.doc_id]
        payload = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        parts = [payload[k : k + 1417] for k in range(0, len(payload), 1417)]
        frames = [frame(min(k for k in sizes if sizes[k] - 23 >= len(p)), p) for p in parts]
        total, begins = sizes[8] + sum(map(len, frames)), [sizes[8] + sum(map(len, frames[:k])) for k in range(len(frames))]
        toc = bytes(min(255, begins[i * len(frames) // 100] * 256 // total) for i in range(100))
        text = b"\x03payload-bytes\0" + str(len(payload)).encode()
        sync = lambda n: bytes((n >> s) & 127 for s in (21, 14, 7, 0))
        tag = b"TXXX" + sync(len(text)) + b"\0\0" + text
        tag = b"ID3\x04\0\0" + sync(len(tag)) + tag
        media = tag + frame(8, b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + toc) + b"".join(frames)
        seek = ",".join(str(len(tag) + x) for x in begins)
        assert tuple(r) == (r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"duration={1152 * len(frames)}/32000;frames={len(frames)};crc={len(frames) + 1}/{len(frames) + 1};seek={seek}")


def test_mpeg_tags_tables_and_free_format():
    rng = random.Random(9)
    sync, media = mpeg_audio.synchsafe, mpeg_audio.store(bytes(3000))
    audio = media[mpeg_audio.parse(media).frames[0][0] - mpeg_audio.FRAMES[7][1] :]
    latin = lambda s: b"\0" + s
    frame3 = b"TIT2" + (6).to_bytes(4, "big") + b"\0\0" + latin(b"title")
    frame4 = b"TIT2" + sync(10) + b"\0\1" + sync(6) + latin(b"title")
    odd = b"TIT2" + (5).to_bytes(4, "big") + b"\0\0" + latin(b"a\xff\xe0b")
    for head, body, want in (
        (b"ID3\3\0\0", frame3, "title"), (b"ID3\2\0\0", b"TT2" + (6).to_bytes(3, "big") + latin(b"title"), "title"), (b"ID3\3\0\x40", (6).to_bytes(4, "big") + bytes(6) + frame3, "title"),
        (b"ID3\4\0\x40", sync(6) + b"\1\0" + frame4, "title"), (b"ID3\3\0\x80", odd.replace(b"\xff", b"\xff\0"), "a\xff\xe0b"), (b"ID3\4\0\x10", frame4 + bytes(5), "title"),
    ):
        tag = head + sync(len(body)) + body + (b"3DI\4\0\x10" + sync(len(body)) if head[5] & 0x10 else b"")
        m = mpeg_audio.parse(tag + audio)
        assert want in m.tags.values() and not m.skipped and len(m.frames) == 3, (head, m.tags)
    # free format: Layer III, no bitrate, frames of 300 bytes and every third padded by one
    free = b"".join((bytes((0xFF, 0xFB, 2 << 2 | (k % 3 == 0) << 1, 0xC0)) + bytes(296 + (k % 3 == 0))) for k in range(9))
    m = mpeg_audio.parse(b"\0" * 7 + free)
    assert [at for at, _ in m.frames][:3] == [7, 308, 608] and len(m.frames) in (8, 9) and m.samples == 1152 * len(m.frames)
    # Layer I, stereo, with a checksum over 32 bytes of allocation
    alloc = rng.randbytes(32)
    head = b"\xff\xfe\x50\x00"
    size = mpeg_audio.header(head).size
    one = head + mpeg_audio.crc16(head[2:] + alloc).to_bytes(2, "big") + alloc + bytes(size - 38)
    bad = bytearray(one)
    bad[10] ^= 4
    m = mpeg_audio.parse(one * 3 + bytes(bad) + one)
    assert (m.crc_checked, m.crc_failed, m.samples) == (5, 1, 5 * 384)
    two = b"\xff\xfc\x50\x00"
    m = mpeg_audio.parse((two + bytes(mpeg_audio.header(two).size - 4)) * 3)
    assert (m.crc_checked, m.crc_unchecked, len(m.frames)) == (0, 3, 3)
    # VBRI with its own seek points
    h = b"\xff\xfb\x90\x00"
    table = b"VBRI" + bytes(6) + (5000).to_bytes(4, "big") + (12).to_bytes(4, "big") + (3).to_bytes(2, "big") + (2).to_bytes(2, "big") + (2).to_bytes(2, "big") + (4).to_bytes(2, "big") + b"".join(n.to_bytes(2, "big") for n in (100, 110, 120))
    first = (h + bytes(32) + table).ljust(417, b"\0")
    m = mpeg_audio.parse(first + (h + bytes(413)) * 4)
    assert m.vbr["points"] == [200, 420, 660] and m.vbr["frames_per_point"] == 4 and len(m.frames) == 4


def test_words_of_the_vocabulary_equal_the_library():
    """Texts of the vocabulary's own tokens, in any order, and of their halves."""
    import json

    from tokenizers import Tokenizer

    with open(BYTES, encoding="utf-8") as f:
        vocab = [t.replace("Ġ", " ").replace("Ċ", "\n") for t in json.load(f)["model"]["vocab"]]
    plain = [t for t in vocab if t.isprintable() or t.strip() == ""]
    w, t, rng = WordTokenizer(BYTES), Tokenizer.from_file(BYTES), random.Random(12)
    texts = ["".join(rng.choice(plain) for _ in range(8)) for _ in range(4000)] + ["".join(x[: rng.randrange(1, len(x) + 1)] for x in rng.sample(plain, 6)) for _ in range(4000)] + plain[::5]
    got = w.encode(texts)
    want = t.encode_batch_fast(texts, add_special_tokens=False)
    assert [np.frombuffer(a, "<u4").tolist() for a in got] == [b.ids for b in want]


def test_a_very_long_text(spark):
    """A text of two million characters in 20,000 lines, and one of a single line, through every operator."""
    import sentencepiece
    from tokenizers import Tokenizer

    from treelake.llm import quality_crf, toxicity

    rng = random.Random(13)
    words = ["".join(rng.choice("abcdeghilmnorstué") for _ in range(rng.randrange(2, 10))) for _ in range(3000)]
    long = "\n".join(" ".join(rng.choice(words) for _ in range(16)) for _ in range(20_000))
    line = " ".join(rng.choice(words) for _ in range(100_000))
    docs = spark.createDataFrame([(1, long), (2, line), (3, long[:5000])], "doc_id long, text string").repartition(3)
    texts = {1: long, 2: line, 3: long[:5000]}
    labels = spark.createDataFrame([(k, 1, 0) for k in texts], "doc_id long, quality int, toxic int")
    sp, t = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(BYTES)
    size = {k: len(t.encode(x, add_special_tokens=False).ids) + 1 for k, x in texts.items()}
    assert {r.doc_id: r.n_tokens for r in sentencepiece_codec.digests(docs, PIECES).collect()} == {k: len(sp.encode(x)) + 1 for k, x in texts.items()}
    assert {r.doc_id: r.n_words for r in quality_rules.verdicts(docs, labels).collect()} == {k: len(x.split()) for k, x in texts.items()}
    assert {r.doc_id: r.n_tokens for r in token_store.store_and_read(docs, BYTES).collect()} == size
    packed = Counter()
    for r in packing.pack(docs, BYTES).collect():
        packed[r.doc_id] += r.length
    assert packed == size
    got = {r.doc_id: r for r in suffix_dedup.digests(docs).collect()}
    assert got[3].n_removed == got[3].n_bytes == len(texts[3].encode()) and got[1].n_removed == got[3].n_bytes and got[2].n_removed == 0
    assert {r.doc_id: r.fingerprint for r in simhash.near_duplicates(docs).collect()} == {k: f"{simhash.fingerprint(x):016x}" for k, x in texts.items()}
    assert {r.doc_id: r.n_bytes for r in mpeg_audio.digests(docs).collect()} == {k: len(x.encode()) for k, x in texts.items()}
    assert all(0 <= r.score <= 1 for r in toxicity.scores(docs, toxicity.fit(docs, labels)).collect())
    crf = quality_crf.Crf(w=np.linspace(-0.1, 0.1, quality_crf.WIDTH), pair=np.eye(2), platt=(1.0, 0.0))
    assert all(0 <= r.score <= 1 for r in quality_crf.scores(docs, crf).collect())
    assert {r.doc_id: r.n_spans for r in pii.digests(docs, pii.fit(docs)).collect()} == dict.fromkeys(texts, 0)


def test_quality_rules_query_against_sql(spark, tmp_path):
    """Strata by rates, by joint cutoffs, and with too few labels; bad documents of all kinds."""
    import duckdb

    from treelake.llm import queries

    rng = random.Random(14)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]

    def text(k, bad):
        w = words(rng.randrange(12, 40))
        if bad == 1:
            w = [x + rng.choice(("", "#", "$$")) for x in w]
        lines = [" ".join(w[i : i + 6]) for i in range(0, len(w), 6)]
        if bad == 2:
            lines += [lines[0][:9]] * rng.randrange(3)
        if bad == 3:
            lines.append(" ".join(w[:5]))
        return "\n".join(lines) + rng.choice(("", "\n", "\n\n"))

    rows = []
    for lang, n in (("en", 1900), ("de", 480), (None, 460), ("fr", 100)):
        for _ in range(n):
            k = len(rows)
            rows.append((k, text(k, 0 if rng.random() < 0.9995 else rng.randrange(4)), lang, 1))
        for _ in range(60):
            rows.append((len(rows), text(0, 1 + rng.randrange(3)), lang, 0))
    rows += [(len(rows) + k, rows[k][1], rows[k][2], 1) for k in range(200)] + [(9000, None, "en", 1), (9001, "", None, 1)]
    spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], r[3], 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = queries.op4_quality_rules(spark, str(tmp_path))
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    r = con.execute(queries.ORACLE_SQL["op4_quality_rules"])
    at = [[c[0] for c in r.description].index(c) for c in columns]
    want = sorted(tuple(x[i] for i in at) for x in r.fetchall())
    assert got == want
    kept, failed = columns.index("kept"), columns.index("base_failed")
    assert 20 < sum(not x[kept] and not x[failed] for x in got) < 400
