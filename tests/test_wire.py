import hashlib
import struct
import zlib

import pytest

from treelake.functions import objects as o
from treelake.functions.pktline import decode_all, encode, mark
from treelake.sources import datasource, pack, repository, wire

BLOBS = [("blob", b"hello\n"), ("blob", b"x" * 5000), ("tree", b"")]
IDS = [o.object_id(*b) for b in BLOBS]


class Server:
    """Answers as the public protocol says, from a dictionary of references."""

    def __init__(self, bands=True, reject=()):
        self.refs, self.seen, self.bands, self.reject = {"refs/heads/main": IDS[0], "refs/tags/v": IDS[1]}, [], bands, reject

    def __call__(self, method, url, headers, body):
        self.seen.append((method, url, headers))
        if method == "GET":
            return encode(b"# service=git-upload-pack\n") + mark("flush") + b"".join(map(encode, (b"version 2\n", b"agent=x\n", b"ls-refs=unborn\n", b"fetch=shallow filter\n"))) + mark("flush")
        if url.endswith("git-receive-pack"):
            at, lines = 0, []
            while n := int(body[at : at + 4], 16):
                lines.append(body[at + 4 : at + n].split(b"\0")[0].decode().strip().split(" "))
                at += n
            self.objects = pack.read_pack(body[at + 4 :]) if any(new != wire.NOTHING for _, new, _ in lines) else []
            out = encode(b"unpack ok\n")
            for old, new, name in lines:
                if name in self.reject or self.refs.get(name, wire.NOTHING) != old:
                    out += encode(f"ng {name} stale info\n".encode())
                else:
                    self.refs[name] = new
                    out += encode(f"ok {name}\n".encode())
            out += mark("flush")
            return encode(b"\1" + out) + mark("flush") if self.bands else out
        lines = [p.rstrip(b"\n") for kind, p in decode_all(body) if kind == "data"]
        self.lines = lines
        if lines[0] == b"command=ls-refs":
            prefixes = [x[11:].decode() for x in lines if x.startswith(b"ref-prefix ")]
            rows = [f"{IDS[0]} HEAD symref-target:refs/heads/main\n"] + [f"{s} {n}" + (f" peeled:{IDS[2]}" if "tags" in n else "") + "\n" for n, s in self.refs.items()]
            return b"".join(encode(r.encode()) for r in rows if not prefixes or any(r.split(" ")[1].startswith(p) for p in prefixes)) + mark("flush")
        data, _ = pack.write_pack([b for b, s in zip(BLOBS, IDS) if f"want {s}".encode() in lines])
        if b"want " + b"0" * 40 in lines:
            return encode(b"ERR not our ref\n")
        head = encode(b"packfile\n")
        if not self.bands:
            return head + b"".join(encode(data[k : k + 100]) for k in range(0, len(data), 100)) + mark("flush")
        return encode(b"acknowledgments\n") + encode(b"NAK\n") + mark("delim") + head + encode(b"\2counting\n") + b"".join(encode(b"\1" + data[k : k + 100]) for k in range(0, len(data), 100)) + mark("flush")


def test_references_and_capabilities(spark):
    s = Server()
    r = wire.Remote("https://host/x.git", wire.Credentials.bearer("secret", "host"), s)
    assert r.capabilities()["fetch"] == "shallow filter" and "secret" not in repr(r)
    assert r.refs()[0] == ("HEAD", "symbolic", IDS[0], "refs/heads/main", None) and len(r.refs(["refs/tags/"])) == 1
    assert {x.name: x.peeled for x in r.ref_table(spark).collect()}["refs/tags/v"] == IDS[2]
    assert sum(m == "GET" for m, *_ in s.seen) == 1 and all(h["Authorization"] == "Bearer secret" and h["Git-Protocol"] == "version=2" for *_, h in s.seen)
    assert wire.Credentials.basic("u", "p", "host").headers("https://other/") == {} == wire.Credentials.basic("u", "p", "host").headers("http://host/")
    assert wire.Credentials.token("t", "host").headers("https://host/a")["Authorization"].startswith("Basic ")
    with pytest.raises(o.TreelakeError, match="protocol_version"):
        wire.parse_capabilities(encode(b"version 1\n"))
    with pytest.raises(o.TreelakeError):
        wire.parse_refs(encode(b"nonsense refs/x\n"))


@pytest.mark.parametrize("bands", [True, False])
def test_fetch_and_push(spark, tmp_path, bands):
    s = Server(bands, reject=("refs/heads/locked",))
    r = wire.Remote("https://host/x.git", send=s)
    got = pack.read_pack(r.fetch(IDS[:2], haves=[IDS[2]], spec="blob:none", depth=1))
    assert [(x.type, x.content) for x in got] == BLOBS[:2] and b"filter blob:none" in s.lines and b"deepen 1" in s.lines and b"have " + IDS[2].encode() in s.lines
    name = r.fetch_into(str(tmp_path / "packs"), IDS)
    assert {x.sha for x in pack.pack_objects(spark, str(tmp_path / "packs")).collect()} == {*IDS} and pack.find_in_pack(name + ".idx", [IDS[1]])[0][2] == BLOBS[1][1]
    with pytest.raises(o.TreelakeError, match="not our ref"):
        r.fetch(["0" * 40])
    done = r.push([("refs/heads/main", IDS[0], IDS[1]), ("refs/heads/new", None, IDS[2]), ("refs/tags/v", IDS[2], None), ("refs/heads/locked", None, IDS[0])], BLOBS)
    assert done == {"refs/heads/main": "ok", "refs/heads/new": "ok", "refs/tags/v": "stale info", "refs/heads/locked": "stale info"} and len(s.objects) == 3
    assert r.push([("refs/heads/new", IDS[2], None)], []) == {"refs/heads/new": "ok"} and r.push([], []) == {}
    for bad in (encode(b"unpack failed\n"), encode(b"\3no space\n")):
        with pytest.raises(o.TreelakeError):
            wire.parse_report(bad)


def test_objects_in_pieces_and_in_bulk(spark, tmp_path):
    at = str(tmp_path / "r")
    repository.init(at)
    w = repository.ObjectWriter(at, "blob", 5000)
    for k in range(0, 5000, 777):
        w.write(b"x" * min(777, 5000 - k))
    assert w.close() == IDS[1] and repository.read_object(at, IDS[1]) == BLOBS[1]
    w = repository.ObjectWriter(at, "blob", 3)
    w.write(b"ab")
    for end in (w.close, lambda: repository.ObjectWriter(at, "blob", 1).write(b"ab")):
        with pytest.raises(o.TreelakeError):
            end()
    import os

    assert not [f for f in os.listdir(f"{at}/objects") if f.startswith("tmp")]
    rows = [(k, s, c) for (k, c), s in zip(BLOBS, IDS)] + [("blob", "f" * 40, b"other")]
    got = {r.sha: r.error for r in repository.import_objects(spark.createDataFrame(rows, "type string, sha string, content binary"), at).collect()}
    assert got == dict.fromkeys(IDS) | {"f" * 40: "id_mismatch"}


def _thin(base, extra):
    """A pack of one delta whose base is elsewhere."""
    want = base + extra
    delta = bytearray(o.encode_varint(len(base)) + o.encode_varint(len(want)))
    delta += bytes((0x80 | 0x10 | 0x20, len(base) & 255, len(base) >> 8)) + bytes((len(extra),)) + extra
    body = b"PACK" + struct.pack(">II", 2, 1) + o.encode_size(7, len(delta)) + bytes.fromhex(o.object_id("blob", base)) + zlib.compress(bytes(delta))
    return body + hashlib.sha1(body).digest(), want


def test_deltas_across_packs(spark, tmp_path):
    first = b"hello world " * 30
    thin, second = _thin(first, b"two")
    thinner, third = _thin(second, b"three")
    for name, data in (("c", thinner), ("a", pack.write_pack([("blob", first)])[0]), ("b", thin)):
        (tmp_path / f"{name}.pack").write_bytes(data)
    got = {bytes(r.content) for r in pack.pack_objects_across(spark, str(tmp_path)).collect()}
    assert got == {first, second, third}
    (tmp_path / "a.pack").unlink()
    with pytest.raises(o.TreelakeError, match="missing_base"):
        pack.pack_objects_across(spark, str(tmp_path))
    known = spark.createDataFrame([("blob", o.object_id("blob", first), len(first), first)], pack.OBJECTS)
    assert {bytes(r.content) for r in pack.pack_objects_across(spark, str(tmp_path), known).collect()} == {second, third}


def test_data_source(spark, tmp_path):
    at = str(tmp_path / "r")
    repository.init(at)
    for b in BLOBS:
        repository.put_object(at, *b)
    data, index = pack.write_pack([("blob", b"packed")])
    (tmp_path / "r/objects/pack/p.pack").write_bytes(data)
    repository.write_ref(at, "refs/heads/main", IDS[0])
    spark.dataSource.register(datasource.RepositorySource)
    read = lambda table, path=at: spark.read.format("treelake").option("table", table).load(path)
    assert {r.sha for r in read("objects").collect()} == {*IDS, o.object_id("blob", b"packed")}
    assert {r.name for r in read("refs", f"file://{at}").collect()} == {"HEAD", "refs/heads/main"}
    datasource.STORES["here"] = lambda url: str(tmp_path / url.removeprefix("here:"))
    assert datasource.load(spark, "refs", "here:r").count() == 2
    with pytest.raises(Exception, match="unknown_table"):
        read("odd").collect()
    with pytest.raises(o.TreelakeError):
        datasource.open_store("ftp:x")
