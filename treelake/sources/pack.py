"""Packs of objects: reading with offset and reference deltas, indexes, writing; and Spark tables of pack files, one pack a task."""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from time import monotonic

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.functions.objects import TreelakeError, decode_offset, decode_size, decode_varint, encode_size, object_id

KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
CODES = {k: n for n, k in KINDS.items()}
OFFSET_DELTA, REF_DELTA = 6, 7
SIGNATURE, VERSION = b"PACK", 2
OBJECTS = "type string, sha string, size long, content binary"


@dataclass(frozen=True)
class Limits:
    """What a hostile pack may not exceed."""

    pack_bytes: int = 2 << 30
    objects: int = 10_000_000
    object_bytes: int = 100 << 20
    resolved_bytes: int = 2 << 30
    delta_depth: int = 50
    inflate_ratio: int = 1000


@dataclass(frozen=True)
class Obj:
    type: str
    sha: str
    content: bytes


def apply_delta(base: bytes, delta: bytes, most: int = 100 << 20) -> bytes:
    """Copies from the base and insertions; sizes and bounds are checked."""
    size, at = decode_varint(delta, 0)
    if size != len(base):
        raise TreelakeError("base_size", want=size, got=len(base))
    want, at = decode_varint(delta, at)
    if want > most:
        raise TreelakeError("object_too_large", size=want)
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 0x80:
            fields = []
            for k in range(7):
                byte = 0
                if op >> k & 1:
                    if at >= len(delta):
                        raise TreelakeError("truncated_delta")
                    byte, at = delta[at], at + 1
                fields.append(byte)
            start = int.from_bytes(bytes(fields[:4]), "little")
            n = int.from_bytes(bytes(fields[4:]), "little") or 0x10000
            if start + n > len(base):
                raise TreelakeError("copy_out_of_bounds")
            out += base[start : start + n]
        elif op:
            if at + op > len(delta):
                raise TreelakeError("truncated_delta")
            out += delta[at : at + op]
            at += op
        else:
            raise TreelakeError("reserved_delta_op")
        if len(out) > want:
            raise TreelakeError("result_size")
    if len(out) != want:
        raise TreelakeError("result_size", want=want, got=len(out))
    return bytes(out)


class Inflating:
    """A zlib stream of a known result size that is fed in pieces; no more than the size and one byte comes out."""

    def __init__(self, size: int, limits: Limits):
        if size > limits.object_bytes:
            raise TreelakeError("object_too_large", size=size)
        self.size, self.limits, self.z, self.out, self.fed = size, limits, zlib.decompressobj(), bytearray(), 0

    def feed(self, piece: bytes) -> int | None:
        """How many bytes of the piece belong to the stream if it ends here, None if it goes on."""
        self.fed += len(piece)
        try:
            while True:
                self.out += self.z.decompress(piece, self.size + 1 - len(self.out))
                if len(self.out) > self.size:
                    raise TreelakeError("inflated_size", want=self.size)
                piece = self.z.unconsumed_tail
                if not piece:
                    break
        except zlib.error as e:
            raise TreelakeError("zlib") from e
        if not self.z.eof:
            return None
        if len(self.out) != self.size:
            raise TreelakeError("inflated_size", want=self.size, got=len(self.out))
        self.fed -= len(self.z.unused_data)
        if self.size > self.limits.inflate_ratio * max(1, self.fed):
            raise TreelakeError("inflate_ratio")
        return len(self.z.unused_data)


def inflate(data: bytes, at: int, size: int, limits: Limits = Limits()) -> tuple[bytes, int]:
    """A zlib stream of a known result size, and the place after it. Only what it needs of the data is copied."""
    one, step = Inflating(size, limits), min(max(size, 64) + 64, 1 << 16)
    while at < len(data):
        piece = data[at : at + step]
        at += len(piece)
        if (left := one.feed(piece)) is not None:
            return bytes(one.out), at - left
    raise TreelakeError("inflated_size", want=size, got=len(one.out))


class Reader:
    """Objects of one pack. external gives objects that aren't in it by id (thin packs)."""

    def __init__(self, data: bytes, external: Callable[[str], tuple[str, bytes] | None] | None = None, limits: Limits = Limits()):
        if len(data) > limits.pack_bytes:
            raise TreelakeError("pack_too_large", size=len(data))
        if len(data) < 32 or data[:4] != SIGNATURE:
            raise TreelakeError("no_pack")
        version, self.count = struct.unpack(">II", data[4:12])
        if version not in (2, 3):
            raise TreelakeError("pack_version", version=version)
        if self.count > limits.objects:
            raise TreelakeError("too_many_objects", count=self.count)
        if hashlib.sha1(data[:-20]).digest() != data[-20:]:
            raise TreelakeError("pack_checksum")
        self.data, self.body, self.external, self.limits = data, data[:-20], external, limits
        self.raw: dict[int, tuple[int, object, bytes, int]] = {}
        self.done: dict[int, tuple[str, bytes]] = {}
        self.by_sha: dict[str, int] = {}

    def entry(self, at: int) -> tuple[int, object, bytes, int]:
        """code, base (an offset or id), inflated bytes, place after."""
        if at not in self.raw:
            code, size, k = decode_size(self.body, at)
            base: object = None
            if code == OFFSET_DELTA:
                back, k = decode_offset(self.body, k)
                if not 0 < back <= at - 12:
                    raise TreelakeError("base_out_of_bounds", at=at)
                base = at - back
            elif code == REF_DELTA:
                base, k = self.body[k : k + 20].hex(), k + 20
            elif code not in KINDS:
                raise TreelakeError("object_type", code=code)
            content, end = inflate(self.body, k, size, self.limits)
            self.raw[at] = (code, base, content, end)
        return self.raw[at]

    def at(self, place: int) -> tuple[str, bytes]:
        """Type and content of the object at a place, its chain of deltas resolved."""
        chain, here = [], place
        while here not in self.done:
            code, base, content, _ = self.entry(here)
            if code in KINDS:
                self.done[here] = (KINDS[code], content)
                break
            chain.append((here, content))
            if len(chain) > self.limits.delta_depth:
                raise TreelakeError("delta_depth")
            if code == REF_DELTA and base not in self.by_sha:
                found = self.external(base) if self.external else None
                if found is None:
                    raise TreelakeError("missing_base", sha=base)
                kind, whole = found
                break
            here = self.by_sha[base] if code == REF_DELTA else base
        else:
            kind, whole = self.done[here]
        if here in self.done:
            kind, whole = self.done[here]
        for k, delta in reversed(chain):
            whole = apply_delta(whole, delta, self.limits.object_bytes)
            self.done[k] = (kind, whole)
        return kind, whole

    def objects(self) -> list[Obj]:
        """All in the pack's order; reference deltas may point ahead."""
        places, at = [], 12
        for _ in range(self.count):
            places.append(at)
            at = self.entry(at)[3]
        if at != len(self.body):
            raise TreelakeError("trailing_bytes")
        out: dict[int, Obj] = {}
        waiting, total = places, 0
        while waiting:
            later = []
            for p in waiting:
                try:
                    kind, content = self.at(p)
                except TreelakeError as e:
                    if e.code != "missing_base":
                        raise
                    later.append(p)
                    continue
                out[p] = Obj(kind, object_id(kind, content), content)
                self.by_sha[out[p].sha] = p
                total += len(content)
                if total > self.limits.resolved_bytes:
                    raise TreelakeError("resolved_too_large")
            if len(later) == len(waiting):
                raise TreelakeError("missing_base", places=later[:5])
            waiting = later
        return [out[p] for p in places]

    def settle(self) -> tuple[list[Obj], list[tuple[int, str, bytes]]]:
        """What can be made of this pack alone, and the deltas that can't: place, id of the base, delta. Offset deltas on such ones need
        objects of this pack, and so are an error."""
        places, at, done, waiting = [], 12, {}, []
        for _ in range(self.count):
            places.append(at)
            at = self.entry(at)[3]
        todo = places
        while todo:
            later = []
            for p in todo:
                try:
                    kind, content = self.at(p)
                except TreelakeError as e:
                    if e.code != "missing_base":
                        raise
                    later.append(p)
                    continue
                done[p] = Obj(kind, object_id(kind, content), content)
                self.by_sha[done[p].sha] = p
            if len(later) == len(todo):
                break
            todo = later
        else:
            later = []
        for p in later:
            code, base, delta, _ = self.entry(p)
            if code != REF_DELTA:
                raise TreelakeError("missing_base", at=p)
            waiting.append((p, base, delta))
        return [done[p] for p in places if p in done], waiting


def read_pack(data: bytes, external: Callable | None = None, limits: Limits = Limits()) -> list[Obj]:
    return Reader(data, external, limits).objects()


class StreamReader:
    """Takes a pack in portions of any size and inflates entries as they come; no more than one entry's head is kept of the pack itself.
    finish() resolves the deltas and gives the objects. Bytes beyond the limits are refused as they come, and so is what comes after
    `seconds`."""

    def __init__(self, external: Callable | None = None, limits: Limits = Limits(), seconds: float | None = None):
        self.external, self.limits, self.until = external, limits, None if seconds is None else monotonic() + seconds
        self.buffer, self.at, self.size = bytearray(), 0, 0  # what isn't parsed, the place of its beginning, and all bytes
        self.count: int | None = None
        self.open: tuple[int, int, object, Inflating] | None = None
        self.raw: dict[int, tuple[int, object, bytes, int]] = {}
        self.sum = hashlib.sha1()

    def _take(self, n: int) -> bytes:
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        self.sum.update(out)
        self.at += n
        return out

    def feed(self, data: bytes) -> None:
        if self.until is not None and monotonic() > self.until:
            raise TreelakeError("deadline")
        self.size += len(data)
        if self.size > self.limits.pack_bytes:
            raise TreelakeError("pack_too_large", size=self.size)
        self.buffer += data
        while self._step():
            pass

    def _step(self) -> bool:
        """Whether something was parsed."""
        if self.count is None:
            if len(self.buffer) < 12:
                return False
            head = self._take(12)
            version, self.count = struct.unpack(">II", head[4:])
            if head[:4] != SIGNATURE:
                raise TreelakeError("no_pack")
            if version not in (2, 3):
                raise TreelakeError("pack_version", version=version)
            if self.count > self.limits.objects:
                raise TreelakeError("too_many_objects", count=self.count)
            return True
        if self.open is not None:
            if not self.buffer:
                return False
            at, code, base, one = self.open
            piece = bytes(self.buffer)
            left = one.feed(piece)
            self._take(len(piece) - (left or 0))
            if left is not None:
                self.raw[at] = (code, base, bytes(one.out), self.at)
                self.open = None
            return left is not None
        if len(self.raw) == self.count:
            if len(self.buffer) > 20:
                raise TreelakeError("trailing_bytes")
            return False
        if len(self.buffer) < 64 and self.buffered_head() is None:
            return False
        at, head = self.at, bytes(self.buffer[:64])
        code, size, k = decode_size(head, 0)
        base: object = None
        if code == OFFSET_DELTA:
            back, k = decode_offset(head, k)
            if not 0 < back <= at - 12:
                raise TreelakeError("base_out_of_bounds", at=at)
            base = at - back
        elif code == REF_DELTA:
            base, k = head[k : k + 20].hex(), k + 20
        elif code not in KINDS:
            raise TreelakeError("object_type", code=code)
        if k > len(self.buffer):
            return False
        self._take(k)
        self.open = (at, code, base, Inflating(size, self.limits))
        return True

    def buffered_head(self) -> int | None:
        """Length of the next entry's head if all of it is there."""
        k, b = 0, self.buffer
        while k < len(b) and b[k] & 0x80:
            k += 1
        if k >= len(b):
            return None
        code, k = b[0] >> 4 & 7, k + 1
        if code == OFFSET_DELTA:
            while k < len(b) and b[k] & 0x80:
                k += 1
            k += 1
        elif code == REF_DELTA:
            k += 20
        return k if k <= len(b) else None

    def finish(self) -> list[Obj]:
        if self.count is None:
            raise TreelakeError("no_pack")
        if self.open is not None or len(self.raw) < self.count or len(self.buffer) < 20:
            raise TreelakeError("truncated_pack")
        if bytes(self.buffer) != self.sum.digest():
            raise TreelakeError("pack_checksum")
        reader = Reader.__new__(Reader)
        reader.count, reader.body, reader.external, reader.limits = self.count, range(self.at), self.external, self.limits
        reader.raw, reader.done, reader.by_sha = self.raw, {}, {}
        return reader.objects()


def write_pack(objects: list[tuple[str, bytes]]) -> tuple[bytes, list[tuple[str, int, int]]]:
    """A pack of whole objects, and (id, crc32, offset) of each for its index."""
    out, index = bytearray(SIGNATURE + struct.pack(">II", VERSION, len(objects))), []
    for kind, content in objects:
        entry = encode_size(CODES[kind], len(content)) + zlib.compress(content)
        index.append((object_id(kind, content), zlib.crc32(entry), len(out)))
        out += entry
    return bytes(out) + hashlib.sha1(out).digest(), index


def write_index(entries: list[tuple[str, int, int]], pack_checksum: bytes) -> bytes:
    """Version 2: running counts by first byte, ids, checksums, offsets; those beyond 2 GiB in a table of their own."""
    entries = sorted(entries)
    first = [int(sha[:2], 16) for sha, _, _ in entries]
    fanout, far, places = [bisect_left(first, k + 1) for k in range(256)], [], []
    for _, _, at in entries:
        if at < 1 << 31:
            places.append(at)
        else:
            places.append(1 << 31 | len(far))
            far.append(at)
    n = len(entries)
    body = b"\xfftOc" + struct.pack(">I256I", 2, *fanout) + b"".join([bytes.fromhex(s) for s, _, _ in entries])
    body += struct.pack(f">{n}I{n}I{len(far)}Q", *[c for _, c, _ in entries], *places, *far) + pack_checksum
    return body + hashlib.sha1(body).digest()


class Index:
    """A version 2 index, checked; lookup searches only ids of the same first byte."""

    def __init__(self, data: bytes):
        if data[:8] != b"\xfftOc\0\0\0\2" or len(data) < 1072:
            raise TreelakeError("no_index")
        if hashlib.sha1(data[:-20]).digest() != data[-20:]:
            raise TreelakeError("index_checksum")
        self.fanout = struct.unpack(">256I", data[8:1032])
        n = self.fanout[-1]
        if len(data) < 1072 + 28 * n or any(a > b for a, b in zip(self.fanout, self.fanout[1:])):
            raise TreelakeError("malformed_index")
        self.shas = [data[1032 + 20 * k : 1052 + 20 * k].hex() for k in range(n)]
        at = 1032 + 20 * n
        self.crcs = struct.unpack(f">{n}I", data[at : at + 4 * n])
        near = struct.unpack(f">{n}I", data[at + 4 * n : at + 8 * n])
        far = data[at + 8 * n : -40]
        try:
            self.offsets = [p if p < 1 << 31 else struct.unpack_from(">Q", far, 8 * (p & 0x7FFFFFFF))[0] for p in near]
        except struct.error:
            raise TreelakeError("malformed_index") from None

    def entries(self) -> list[tuple[str, int, int]]:
        return list(zip(self.shas, self.crcs, self.offsets))

    def lookup(self, sha: str) -> int | None:
        b = int(sha[:2], 16)
        lo, hi = self.fanout[b - 1] if b else 0, self.fanout[b]
        k = bisect_left(self.shas, sha, lo, hi)
        return self.offsets[k] if k < hi and self.shas[k] == sha else None


PENDING = "type string, sha string, size long, content binary, base string, at string"


def pack_objects_across(spark: SparkSession, path: str, known: DataFrame | None = None, most: int = 50) -> DataFrame:
    """Objects of all packs under a path, where deltas may have their bases in other packs, or among known objects: those wait as rows and
    are joined to their bases until none is left. A base that is nowhere is an error."""
    from treelake.operators.graph import shared_table

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                done, waiting = Reader(data.as_py()).settle()
                rows = [(o.type, o.sha, len(o.content), o.content, None, None) for o in done] + [(None, None, None, d, base, f"{name}:{k}") for k, base, d in waiting]
                for s in range(0, len(rows), 1000):
                    yield _rows(rows[s : s + 1000], (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string()), PENDING)

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for kind, base, delta in zip(*[c.to_pylist() for c in b.columns]):
                content = apply_delta(base, delta)
                rows.append((kind, object_id(kind, content), len(content), content))
            if rows:
                yield _rows(rows, (pa.string(), pa.string(), pa.int64(), pa.binary()), OBJECTS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pack").option("recursiveFileLookup", True).load(path)
    table = shared_table(files.select("path", "content").mapInArrow(run, PENDING))
    done, waiting = table.where("base is null").select("type", "sha", "size", "content"), table.where("base is not null").select("content", "base", "at")
    for _ in range(most):
        if waiting.isEmpty():
            return done.dropDuplicates(["sha"])
        bases = (done if known is None else done.unionByName(known.select("type", "sha", "size", "content"))).dropDuplicates(["sha"]).select(F.col("sha").alias("base"), "type", F.col("content").alias("whole"))
        new = shared_table(waiting.join(bases, "base").select("type", "whole", "content").mapInArrow(join, OBJECTS))
        left = shared_table(waiting.join(bases.select("base"), "base", "left_anti"))
        if new.isEmpty():
            break
        done, waiting = done.unionByName(new), left
    raise TreelakeError("missing_base", sha=waiting.first().base)


def _rows(rows: list[tuple], kinds: tuple, ddl: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in ddl.split(", ")])


def pack_objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects of all packs under a path. A pack that can't be read fails its task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for data in b.column(0):
                objs = read_pack(data.as_py())
                for s in range(0, len(objs), 1000):
                    part = objs[s : s + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array([o.type for o in part]), pa.array([o.sha for o in part]), pa.array([len(o.content) for o in part], pa.int64()), pa.array([o.content for o in part], pa.binary())], ["type", "sha", "size", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pack").option("recursiveFileLookup", True).load(path)
    return files.select("content").mapInArrow(run, OBJECTS)


def pack_index(spark: SparkSession, path: str) -> DataFrame:
    """sha, crc, pack_offset of all indexes under a path."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                e = Index(data.as_py()).entries()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(e), pa.string()), *[pa.array([x[k] for x in e], t) for k, t in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))]], ["file", "sha", "crc", "pack_offset"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.idx").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, "file string, sha string, crc long, pack_offset long")


def find_in_pack(index_file: str, shas: list[str]) -> list[tuple[str, str, bytes]]:
    """type, id and content of those ids that a pack has, by its index; only these and their delta bases are inflated, from a mapped file."""
    import mmap

    with open(index_file, "rb") as f:
        index = Index(f.read())
    places = [(s, p) for s in shas if (p := index.lookup(s)) is not None]
    if not places:
        return []
    with open(index_file.removesuffix(".idx") + ".pack", "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
        reader = Reader.__new__(Reader)
        reader.data = reader.body = data
        reader.external, reader.limits, reader.raw, reader.done = None, Limits(), {}, {}
        reader.by_sha = dict(zip(index.shas, index.offsets))
        out = []
        for sha, p in places:
            kind, content = reader.at(p)
            if object_id(kind, content) != sha:
                raise TreelakeError("id_mismatch", sha=sha)
            out.append((kind, sha, content))
        return out


def lookup_objects(spark: SparkSession, path: str, shas: list[str]) -> DataFrame:
    """Objects of some ids in the packs under a folder that all executors share, a task for each index; other objects aren't read."""
    wanted = sorted(set(shas))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for name in b.column(0).to_pylist():
                if found := find_in_pack("/" + name.removeprefix("file:").lstrip("/"), wanted):
                    kinds, ids, contents = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(ids), pa.array(list(map(len, contents)), pa.int64()), pa.array(contents, pa.binary())], ["type", "sha", "size", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.idx").option("recursiveFileLookup", True).load(path)
    return files.select("path").mapInArrow(run, OBJECTS).dropDuplicates(["sha"])


def write_packs(objects: DataFrame, folder: str, packs: int) -> list[str]:
    """Packs and indexes of a table of objects (type, content), each distinct object once, as many packs as tasks. The folder is one
    that all executors share. Names of the packs come back."""
    import os

    os.makedirs(folder, exist_ok=True)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in it for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        if rows:
            data, index = write_pack(rows)
            name = os.path.join(folder, f"pack-{data[-20:].hex()}")
            for suffix, body in ((".idx", write_index(index, data[-20:])), (".pack", data)):
                with open(f"{name}{suffix}.{os.getpid()}", "wb") as f:
                    f.write(body)
                os.replace(f"{name}{suffix}.{os.getpid()}", name + suffix)
            yield pa.RecordBatch.from_arrays([pa.array([name + ".pack"])], ["name"])

    one = objects.select("type", "content", F.sha1(F.concat(F.encode(F.concat("type", F.lit(" "), F.octet_length("content")), "UTF-8"), F.lit(b"\0"), "content")).alias("sha")).dropDuplicates(["sha"])
    return [r.name for r in one.repartitionByRange(packs, "sha").select("type", "content").mapInArrow(run, "name string").collect()]
