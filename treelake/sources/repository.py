"""Repositories in directories: loose objects, packs, references, the staging index; as tables."""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.functions.config import Config
from treelake.functions.expressions import valid_ref
from treelake.functions.objects import HEX40, TreelakeError, decode_commit, decode_tag, decode_tree, object_id, parse_identity
from treelake.sources.pack import OBJECTS, find_in_pack, pack_objects

REFS = "name string, kind string, sha string, target string"


def decode_loose(raw: bytes) -> tuple[str, bytes]:
    """Type and content of a loose object; its declared size is checked."""
    try:
        data = zlib.decompress(raw)
    except zlib.error as e:
        raise TreelakeError("zlib") from e
    head, nul, content = data.partition(b"\0")
    kind, _, size = head.decode("latin-1").partition(" ")
    if not nul or size != str(len(content)):
        raise TreelakeError("loose_header")
    return kind, content


def encode_loose(kind: str, content: bytes) -> bytes:
    return zlib.compress(b"%s %d\0" % (kind.encode(), len(content)) + content)


def loose_objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects in objects/xx/yyy; each must have the id that its name says."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                sha = "".join(name.split("/")[-2:])
                if not HEX40.fullmatch(sha):
                    continue
                kind, content = decode_loose(data.as_py())
                if object_id(kind, content) != sha:
                    raise TreelakeError("id_mismatch", name=name)
                rows.append((kind, sha, len(content), content))
            if rows:
                t = (pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), t)], ["type", "sha", "size", "content"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(os.path.join(path, "objects"))
    files = files.where(F.col("path").rlike("/[0-9a-f]{2}/[0-9a-f]{38}$"))
    return files.select("path", "content").mapInArrow(run, OBJECTS)


def objects(spark: SparkSession, path: str) -> DataFrame:
    """Loose and packed objects, each once; tables of this directory that are cached are read anew."""
    spark.catalog.refreshByPath(os.path.join(path, "objects"))
    out = loose_objects(spark, path)
    packs = os.path.join(path, "objects", "pack")
    if os.path.isdir(packs) and any(f.endswith(".pack") for f in os.listdir(packs)):
        out = out.unionByName(pack_objects(spark, packs))
    return out.dropDuplicates(["sha"])


def parse_ref(text: str) -> tuple[str, str | None, str | None]:
    """kind, id, target."""
    text = text.strip()
    if text.startswith("ref:"):
        return "symbolic", None, text[4:].strip()
    if not HEX40.fullmatch(text):
        raise TreelakeError("invalid_ref", text=text[:60])
    return "direct", text, None


def parse_packed_refs(text: str) -> list[tuple[str, str]]:
    out = []
    for line in text.split("\n"):
        sha, _, name = line.strip().partition(" ")
        if HEX40.fullmatch(sha) and name:
            out.append((name, sha))
    return out


def read_refs(path: str) -> list[tuple[str, str, str | None, str | None]]:
    """All references of a directory: loose ones win over packed ones, links aren't followed, unsafe names are left out by the table."""
    found: dict[str, tuple[str, str, str | None, str | None]] = {}
    packed = os.path.join(path, "packed-refs")
    if os.path.isfile(packed):
        with open(packed) as f:
            found = {n: (n, "direct", s, None) for n, s in parse_packed_refs(f.read())}
    names = ["HEAD"] if os.path.isfile(os.path.join(path, "HEAD")) else []
    for at, dirs, files in os.walk(os.path.join(path, "refs"), followlinks=False):
        if os.path.relpath(at, path).count(os.sep) >= 16:
            dirs[:] = []
        names += [os.path.relpath(os.path.join(at, f), path) for f in files if not f.endswith(".lock") and not os.path.islink(os.path.join(at, f))]
    for n in names:
        with open(os.path.join(path, n)) as f:
            kind, sha, target = parse_ref(f.read())
        found[n] = (n, kind, sha, target)
    return sorted(found.values())


def refs(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(read_refs(path), REFS).where(valid_ref(F.col("name")))


def write_ref(path: str, name: str, value: str, expected: str | None = "any") -> None:
    """Compare and swap behind a lock file. expected: an id, None for a reference that must not be there, "any" for no check.
    A value starting with "ref: " makes a symbolic reference."""
    target = os.path.join(path, name)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    lock = os.open(target + ".lock", os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    try:
        now = next((s or f"ref: {t}" for n, _, s, t in read_refs(path) if n == name), None)
        if expected != "any" and now != expected:
            raise TreelakeError("ref_conflict", name=name, now=now)
        os.write(lock, value.encode() + b"\n")
        os.fsync(lock)
        os.replace(target + ".lock", target)
    finally:
        os.close(lock)
        if os.path.exists(target + ".lock"):
            os.unlink(target + ".lock")


def delete_ref(path: str, name: str) -> None:
    packed = os.path.join(path, "packed-refs")
    if os.path.isfile(packed):
        with open(packed) as f:
            keep = [x for x in f.read().split("\n") if not x.endswith(" " + name)]
        with open(packed + ".new", "w") as f:
            f.write("\n".join(keep))
        os.replace(packed + ".new", packed)
    if os.path.isfile(os.path.join(path, name)):
        os.unlink(os.path.join(path, name))


def put_object(path: str, kind: str, content: bytes) -> str:
    """Writes a loose object once; its id."""
    sha = object_id(kind, content)
    at = os.path.join(path, "objects", sha[:2], sha[2:])
    if not os.path.exists(at):
        os.makedirs(os.path.dirname(at), exist_ok=True)
        tmp = f"{at}.{uuid.uuid4().hex}"  # several tasks may write one object
        with open(tmp, "wb") as f:
            f.write(encode_loose(kind, content))
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, at)
    return sha


class ObjectWriter:
    """A loose object written in pieces; nothing is there under its id until it is closed whole."""

    def __init__(self, path: str, kind: str, size: int):
        self.path, self.size, self.left = path, size, size
        os.makedirs(os.path.join(path, "objects"), exist_ok=True)
        self.tmp = os.path.join(path, "objects", f"tmp-{uuid.uuid4().hex}")
        self.file, self.zip, self.sum = open(self.tmp, "wb"), zlib.compressobj(), hashlib.sha1()
        self._put(b"%s %d\0" % (kind.encode(), size))

    def _put(self, data: bytes) -> None:
        self.sum.update(data)
        self.file.write(self.zip.compress(data))

    def write(self, data: bytes) -> None:
        if len(data) > self.left:
            self.cancel()
            raise TreelakeError("object_size", want=self.size)
        self.left -= len(data)
        self._put(data)

    def close(self) -> str:
        """The id."""
        if self.left:
            self.cancel()
            raise TreelakeError("object_size", want=self.size, got=self.size - self.left)
        self.file.write(self.zip.flush())
        self.file.flush()
        os.fsync(self.file.fileno())
        self.file.close()
        sha = self.sum.hexdigest()
        at = os.path.join(self.path, "objects", sha[:2], sha[2:])
        os.makedirs(os.path.dirname(at), exist_ok=True)
        os.replace(self.tmp, at)
        return sha

    def cancel(self) -> None:
        self.file.close()
        if os.path.exists(self.tmp):
            os.unlink(self.tmp)


def import_objects(objs: DataFrame, path: str) -> DataFrame:
    """Writes objects (type, sha, content) as loose ones, in tasks: sha and error, which is null where it went well. An object whose
    content has another id isn't written; the others are."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            errors = []
            for kind, sha, content in zip(*[c.to_pylist() for c in b.columns]):
                try:
                    errors.append(None if object_id(kind, content) == sha and put_object(path, kind, content) else "id_mismatch")
                except OSError as e:
                    errors.append(f"os_error {e.errno}")
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(errors, pa.string())], ["sha", "error"])

    return objs.select("type", "sha", "content").mapInArrow(run, "sha string, error string")


def read_object(path: str, sha: str) -> tuple[str, bytes]:
    """Type and content of one loose object, or of one in a pack by the packs' indexes."""
    at = os.path.join(path, "objects", sha[:2], sha[2:])
    if os.path.isfile(at):
        with open(at, "rb") as f:
            kind, content = decode_loose(f.read())
        if object_id(kind, content) != sha:
            raise TreelakeError("id_mismatch", name=sha)
        return kind, content
    packs = os.path.join(path, "objects", "pack")
    for name in sorted(os.listdir(packs)) if os.path.isdir(packs) else []:
        if name.endswith(".idx") and (got := find_in_pack(os.path.join(packs, name), [sha])):
            return got[0][0], got[0][2]
    raise TreelakeError("not_found", sha=sha)


def delete_object(path: str, sha: str) -> bool:
    """Removes a loose object; whether it was there. Packs stay as they are."""
    if not HEX40.fullmatch(sha):
        raise TreelakeError("invalid_id", sha=sha)
    try:
        os.unlink(os.path.join(path, "objects", sha[:2], sha[2:]))
    except FileNotFoundError:
        return False
    return True


def loose_ids(spark: SparkSession, path: str) -> DataFrame:
    """sha of loose objects by their names; none is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(os.path.join(path, "objects")).select("path")
    found = F.regexp_extract("path", "/([0-9a-f]{2}/[0-9a-f]{38})$", 1)
    return files.select(F.replace(found, F.lit("/"), F.lit("")).alias("sha")).where("sha <> ''")


def index_entries(spark: SparkSession, path: str) -> DataFrame:
    """The staging index of a directory as a table, in its order."""
    with open(os.path.join(path, "index"), "rb") as f:
        rows = [(k, e.name.decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode(), e.sha, e.mode, e.stage, e.size, e.ctime[0], e.mtime[0], e.assume_valid, e.intent_to_add, e.skip_worktree) for k, e in enumerate(parse_index(f.read()))]
    return spark.createDataFrame(rows, "pos int, name string, sha string, mode int, stage int, size long, ctime long, mtime long, assume_valid boolean, intent_to_add boolean, skip_worktree boolean")


def init(path: str, branch: str = "main") -> None:
    os.makedirs(os.path.join(path, "objects", "pack"), exist_ok=True)
    os.makedirs(os.path.join(path, "refs", "heads"), exist_ok=True)
    with open(os.path.join(path, "HEAD"), "w") as f:
        f.write(f"ref: refs/heads/{branch}\n")


@dataclass(frozen=True)
class IndexEntry:
    name: bytes
    sha: str
    mode: int
    stage: int
    size: int
    ctime: tuple[int, int]
    mtime: tuple[int, int]
    dev: int
    ino: int
    uid: int
    gid: int
    assume_valid: bool
    intent_to_add: bool
    skip_worktree: bool


def parse_index(data: bytes, most: int = 1_000_000) -> list[IndexEntry]:
    """Versions 2 and 3 of the staging index; extensions are skipped."""
    if len(data) < 32 or data[:4] != b"DIRC" or hashlib.sha1(data[:-20]).digest() != data[-20:]:
        raise TreelakeError("invalid_index")
    version, count = struct.unpack(">II", data[4:12])
    if version not in (2, 3) or count > most:
        raise TreelakeError("index_version" if version not in (2, 3) else "too_many_entries")
    out, at, end = [], 12, len(data) - 20
    for _ in range(count):
        if at + 62 > end:
            raise TreelakeError("truncated_entry")
        cs, cn, ms, mn, dev, ino, mode, uid, gid, size = struct.unpack_from(">10I", data, at)
        sha, flags = data[at + 40 : at + 60].hex(), struct.unpack_from(">H", data, at + 60)[0]
        more, start = 0, at + 62
        if flags & 0x4000:
            more, start = struct.unpack_from(">H", data, start)[0], start + 2
        stop = data.find(b"\0", start, end)
        if stop < 0 or (flags & 0xFFF < 0xFFF and stop - start != flags & 0xFFF):
            raise TreelakeError("truncated_name")
        out.append(IndexEntry(data[start:stop], sha, mode, flags >> 12 & 3, size, (cs, cn), (ms, mn), dev, ino, uid, gid, bool(flags & 0x8000), bool(more & 0x2000), bool(more & 0x4000)))
        at += (stop - at) // 8 * 8 + 8
    return out


def commits(objs: DataFrame) -> DataFrame:
    """sha, tree, parents, author and committer, message of commit objects."""
    who = "struct<name:string,email:string,time:bigint>"
    ddl = f"sha string, tree string, parents array<string>, author {who}, committer {who}, gpgsig string, message string, headers array<struct<name:string,value:string>>"

    def run(it):
        import pandas as pd

        for pdf in it:
            rows = []
            for sha, raw in zip(pdf["sha"], pdf["content"]):
                c = decode_commit(bytes(raw))
                a, b = (parse_identity(x).__dict__ for x in (c.author, c.committer))
                rows.append((sha, c.tree, c.parents, a, b, c.gpgsig, c.message, [{"name": k, "value": v} for k, v in c.headers]))
            yield pd.DataFrame(rows, columns=["sha", "tree", "parents", "author", "committer", "gpgsig", "message", "headers"])

    return objs.where("type = 'commit'").select("sha", "content").mapInPandas(run, ddl)


def tree_entries(objs: DataFrame) -> DataFrame:
    """tree, pos, mode, name, sha of tree objects' entries."""

    def run(it):
        import pandas as pd

        for pdf in it:
            yield pd.DataFrame([(t, k, e.mode, e.name.decode("utf-8", "replace"), e.sha) for t, raw in zip(pdf["sha"], pdf["content"]) for k, e in enumerate(decode_tree(bytes(raw)))], columns=["tree", "pos", "mode", "name", "sha"])

    return objs.where("type = 'tree'").select("sha", "content").mapInPandas(run, "tree string, pos int, mode string, name string, sha string")


def tags(objs: DataFrame) -> DataFrame:
    def run(it):
        import pandas as pd

        for pdf in it:
            t = [decode_tag(bytes(raw)) for raw in pdf["content"]]
            yield pd.DataFrame({"sha": pdf["sha"], "object": [x.object for x in t], "type": [x.type for x in t], "tag": [x.tag for x in t], "tagger": [x.tagger for x in t], "message": [x.message for x in t]})

    return objs.where("type = 'tag'").select("sha", "content").mapInPandas(run, "sha string, object string, type string, tag string, tagger string, message string")


def config_entries(path: str) -> Config:
    with open(os.path.join(path, "config"), encoding="utf-8") as f:
        return Config.parse(f.read())
