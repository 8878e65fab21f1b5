import random
import struct
import hashlib

import pytest

from treelake.functions import objects as o
from treelake.functions import pktline
from treelake.functions.config import Config
from treelake.functions.lines import additions, lines, matched_pairs
from treelake.sources import pack as p
from treelake.sources.repository import parse_index


def test_known_ids():
    assert o.object_id("blob", b"hello\n") == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert o.object_id("tree", b"") == o.EMPTY_TREE


def test_tree_order_modes_and_names():
    sha = "ab" * 20
    t = o.new_tree([o.Entry("100664", b"a.txt", sha), o.Entry("40000", b"a", sha), o.Entry("100777", b"a-b", sha)])
    assert [(e.name, e.mode) for e in t] == [(b"a-b", "100755"), (b"a.txt", "100644"), (b"a", "40000")]
    assert o.decode_tree(o.encode_tree(t)) == t
    for bad in (b".git", b".GIT", b"..", b".", b"a/b", b""):
        with pytest.raises(o.TreelakeError):
            o.decode_tree(o.encode_tree([o.Entry("100644", bad, sha)]))
    assert o.canonical_mode("xyz") == "xyz"
    with pytest.raises(o.TreelakeError):
        o.canonical_mode("100664", strict=True)


def test_commit_keeps_headers():
    sha = "1" * 40
    c = o.Commit([("tree", sha), ("parent", sha), ("parent", "2" * 40), ("author", "A <a@a> 7 +0000"), ("committer", "B <b@b> 8 +0100"), ("gpgsig", "one\ntwo"), ("extra", "x")], "hi\n\nbody\n")
    back = o.decode_commit(o.encode_commit(c))
    assert back == c and back.parents == [sha, "2" * 40] and back.gpgsig == "one\ntwo"
    assert o.parse_identity(c.committer) == o.Identity("B", "b@b", 8) and o.parse_identity("nobody") == o.Identity()
    with pytest.raises(o.TreelakeError):
        o.decode_commit(b"tree " + sha.encode() + b"\n\nx")
    t = o.Tag(sha, "commit", "v1", "msg\n", "T <t@t> 1 +0000")
    assert o.decode_tag(o.encode_tag(t)) == t


def test_varints_round_trip():
    rng = random.Random(0)
    for _ in range(500):
        n = rng.getrandbits(rng.randrange(1, 50))
        assert o.decode_varint(o.encode_varint(n), 0)[0] == n
        assert o.decode_offset(o.encode_offset(n), 0)[0] == n
        assert o.decode_size(o.encode_size(3, n), 0)[:2] == (3, n)
    with pytest.raises(o.TreelakeError):
        o.decode_varint(b"\x80", 0)


def test_lfs_pointer():
    oid = "sha256:" + "a" * 64
    good = o.LFS_VERSION + f"oid {oid}\nsize 12345\n".encode()
    assert o.lfs_pointer(good).size == 12345
    assert o.lfs_pointer(o.LFS_VERSION + f"ext-0-foo x\noid {oid}\nsize +5\n".encode()).size == 5
    for bad in (good[:-1], good.replace(b"oid", b"abc"), good.replace(b"a" * 64, b"A" * 64), o.LFS_VERSION + f"size 1\noid {oid}\n".encode(), good + b"\n", b"x" * 2000):
        assert o.lfs_pointer(bad) is None


def test_config():
    c = Config.parse('[core]\n\tbare = false ; no\n\tflag\n[Remote "Or\\"igin"]\n\turl = "a # b" c\n\turl = second\n# end\n')
    assert c.get("CORE", "Bare") == "false" and c.get("core", "flag") == "true"
    assert c.get_all("remote", "url", 'Or"igin') == ["a # b c", "second"] and c.get("remote", "url") is None
    c.set("core", "bare", " x\ty")
    assert Config.parse(c.encode()).get("core", "bare") == " x\ty"
    with pytest.raises(o.TreelakeError):
        Config.parse("key = value")


def test_packet_lines_in_any_portions():
    data = pktline.encode(b"one") + pktline.mark("delim") + pktline.encode(b"") + pktline.encode(b"\x01x") + pktline.mark("flush")
    want = [("data", b"one"), ("delim", b""), ("data", b""), ("data", b"\x01x"), ("flush", b"")]
    assert pktline.decode_all(data) == want
    for step in range(1, 9):
        d, got = pktline.Decoder(), []
        for k in range(0, len(data), step):
            got += d.feed(data[k : k + step])
        d.finish()
        assert got == want
    with pytest.raises(o.TreelakeError):
        pktline.decode_all(data[:-1])
    with pytest.raises(o.TreelakeError):
        pktline.decode_all(b"zzzz")
    assert pktline.demultiplex([("data", b"\x01a"), ("data", b"\x02b")]) == {"data": [b"a"], "progress": [b"b"], "error": []}


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
        row = new
    return row[-1]


def test_line_matching_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = matched_pairs(a, b)
        assert len(pairs) == _lcs(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
        assert len(additions(pairs, len(b))) == len(b) - len(pairs)
    assert lines("a\nb\n") == ["a", "b"] and lines("") == [] and lines("a\n\n") == ["a", ""] and lines("x\r\n") == ["x\r"]


def _delta(base, parts, size):
    out = o.encode_varint(len(base)) + o.encode_varint(size)
    for part in parts:
        if isinstance(part, bytes):
            out += bytes([len(part)]) + part
        else:
            start, n = part
            out += bytes([0x80 | 0x0F | 0x30]) + start.to_bytes(4, "little") + n.to_bytes(2, "little")
    return out


def test_pack_round_trip_with_deltas_and_index():
    import zlib

    objs = [("blob", b"hello world" * 20), ("tree", b""), ("commit", b"x"), ("blob", b"")]
    data, index = p.write_pack(objs)
    assert [(x.type, x.content) for x in p.read_pack(data)] == objs
    idx = p.Index(p.write_index(index, data[-20:]))
    for sha, _, at in index:
        assert idx.lookup(sha) == at and p.Reader(data).at(at)[1] == next(c for k, c in objs if o.object_id(k, c) == sha)
    assert idx.lookup("0" * 40) is None

    base, want = b"hello world" * 20, b"hello world" * 3 + b"!!"
    d = _delta(base, [(0, 33), b"!!"], len(want))
    assert p.apply_delta(base, d) == want
    body = bytearray(b"PACK" + struct.pack(">II", 2, 3))
    # a reference delta before its base, then the base, then an offset delta
    body += o.encode_size(7, len(d)) + bytes.fromhex(o.object_id("blob", base)) + zlib.compress(d)
    at = len(body)
    body += o.encode_size(3, len(base)) + zlib.compress(base)
    here = len(body)
    body += o.encode_size(6, len(d)) + o.encode_offset(here - at) + zlib.compress(d)
    whole = bytes(body) + hashlib.sha1(body).digest()
    assert [x.content for x in p.read_pack(whole)] == [want, base, want]
    s = p.StreamReader()
    for k in range(0, len(whole), 7):
        s.feed(whole[k : k + 7])
    assert [x.content for x in s.finish()] == [want, base, want]
    for step in (1, 25, 1000):
        s = p.StreamReader()
        for k in range(0, len(whole), step):
            s.feed(whole[k : k + step])
            assert len(s.buffer) <= 64 + step  # entries are inflated as they come
        assert [x.content for x in s.finish()] == [want, base, want]
    for bad in (whole[:-1], whole[:40], b"PACX" + whole[4:], whole + b"x", whole[:-1] + bytes([whole[-1] ^ 1])):
        with pytest.raises(o.TreelakeError):
            s = p.StreamReader()
            s.feed(bad)
            s.finish()
    with pytest.raises(o.TreelakeError, match="deadline"):
        p.StreamReader(seconds=-1).feed(whole)
    for bad in (whole[:-1], whole[:40], b"PACX" + whole[4:]):
        with pytest.raises(o.TreelakeError):
            p.read_pack(bad)
    for bad in (d[:-1], d[:3] + b"\0", _delta(base, [(500, 10)], 10), _delta(b"x", [b"y"], 1)):
        with pytest.raises(o.TreelakeError):
            p.apply_delta(base, bad)
    with pytest.raises(o.TreelakeError):
        p.read_pack(data, limits=p.Limits(object_bytes=10))


def test_far_offsets_in_index():
    entries = [("%040x" % k, k, (1 << 31) + k * 1000 if k % 2 else k) for k in range(50)]
    assert p.Index(p.write_index(entries, b"\0" * 20)).entries() == sorted(entries)


def test_fuzzed_packs_never_crash():
    rng = random.Random(2)
    data, _ = p.write_pack([("blob", bytes(range(200))), ("tree", b"")])
    for _ in range(300):
        b = bytearray(data[:-20])
        for _ in range(rng.randrange(1, 4)):
            b[rng.randrange(len(b))] = rng.randrange(256)
        try:
            p.read_pack(bytes(b) + hashlib.sha1(b).digest())
        except o.TreelakeError:
            pass


def test_staging_index():
    def entry(name, flags=0):
        raw = struct.pack(">10I", 1, 2, 3, 4, 5, 6, 0o100644, 7, 8, 9) + b"\x11" * 20 + struct.pack(">H", flags | len(name)) + name
        return raw + b"\0" * (8 - len(raw) % 8)

    body = b"DIRC" + struct.pack(">II", 2, 2) + entry(b"a") + entry(b"dir/bb", 0x8000 | 2 << 12) + b"TREE\0\0\0\0"
    got = parse_index(body + hashlib.sha1(body).digest())
    assert [(e.name, e.stage, e.assume_valid, e.ctime) for e in got] == [(b"a", 0, False, (1, 2)), (b"dir/bb", 2, True, (1, 2))]
    with pytest.raises(o.TreelakeError):
        parse_index(body + b"\0" * 20)
