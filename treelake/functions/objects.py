"""Codecs of content-addressed objects: ids, blobs, trees, commits, tags, varints and hex, on bytes."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

TYPES = ("blob", "tree", "commit", "tag")
KNOWN_MODES = ("40000", "160000", "120000", "100644", "100755")
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


class TreelakeError(ValueError):
    """A code, what it happened to, and a text."""

    def __init__(self, code: str, **context: object):
        super().__init__(code + (f" {context}" if context else ""))
        self.code, self.context = code, context


def object_id(kind: str, content: bytes) -> str:
    return hashlib.sha1(b"%s %d\0" % (kind.encode(), len(content)) + content).hexdigest()


def canonical_mode(mode: str, strict: bool = False) -> str:
    """A known mode as it is; another octal one by its execute bits; strict raises on any other."""
    if mode in KNOWN_MODES:
        return mode
    if strict:
        raise TreelakeError("invalid_mode", mode=mode)
    if not re.fullmatch(r"[+-]?[0-7]+", mode):
        return mode
    return "100755" if int(mode, 8) & 0o111 else "100644"


def entry_name_error(name: bytes) -> str | None:
    if name in (b"", b".", b".."):
        return {b"": "empty", b".": "dot", b"..": "dotdot"}[name]
    if b"/" in name:
        return "slash"
    if b"\0" in name:
        return "nul"
    return "reserved" if name.lower() == b".git" else None


@dataclass(frozen=True)
class Entry:
    mode: str
    name: bytes
    sha: str


def sort_key(e: Entry) -> bytes:
    return e.name + b"/" if e.mode == "40000" else e.name


def new_tree(entries: list[Entry], strict: bool = False) -> list[Entry]:
    return sorted([Entry(canonical_mode(e.mode, strict), e.name, e.sha) for e in entries], key=sort_key)


def encode_tree(entries: list[Entry]) -> bytes:
    return b"".join([e.mode.encode() + b" " + e.name + b"\0" + bytes.fromhex(e.sha) for e in entries])


def decode_tree(data: bytes) -> list[Entry]:
    """Entries as stored, modes and order untouched; unsafe names are errors."""
    out, at = [], 0
    while at < len(data):
        space = data.find(b" ", at)
        end = data.find(b"\0", space + 1)
        if space < 0 or end < 0 or end + 21 > len(data):
            raise TreelakeError("malformed_tree")
        name = data[space + 1 : end]
        if why := entry_name_error(name):
            raise TreelakeError(f"tree_entry_name_{why}", name=name)
        out.append(Entry(data[at:space].decode("latin-1"), name, data[end + 1 : end + 21].hex()))
        at = end + 21
    return out


@dataclass
class Commit:
    """Headers in order, repeats and unknown ones kept, and the message."""

    headers: list[tuple[str, str]]
    message: str

    def all(self, name: str) -> list[str]:
        return [v for k, v in self.headers if k == name]

    def one(self, name: str) -> str | None:
        return next(iter(self.all(name)), None)

    tree = property(lambda self: self.one("tree"))
    parents = property(lambda self: self.all("parent"))
    author = property(lambda self: self.one("author"))
    committer = property(lambda self: self.one("committer"))
    gpgsig = property(lambda self: self.one("gpgsig"))


def _headers(text: str) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in text.split("\n"):
        if line.startswith(" ") and out:
            out[-1] = (out[-1][0], out[-1][1] + "\n" + line[1:])
        else:
            key, space, value = line.partition(" ")
            if not space:
                raise TreelakeError("malformed_header", line=line)
            out.append((key, value))
    return out


def _encode_headers(headers: list[tuple[str, str]]) -> str:
    return "".join([f"{k} {v.replace(chr(10), chr(10) + ' ')}\n" for k, v in headers])


HEX40 = re.compile(r"[0-9a-f]{40}")


def decode_commit(data: bytes) -> Commit:
    head, blank, message = data.decode("utf-8", "surrogateescape").partition("\n\n")
    if not blank:
        raise TreelakeError("malformed_commit")
    c = Commit(_headers(head), message)
    for name in ("tree", "author", "committer"):
        if c.one(name) is None:
            raise TreelakeError("missing_header", name=name)
    for sha in [c.tree, *c.parents]:
        if not HEX40.fullmatch(sha):
            raise TreelakeError("invalid_id", id=sha)
    return c


def encode_commit(c: Commit) -> bytes:
    return (_encode_headers(c.headers) + "\n" + c.message).encode("utf-8", "surrogateescape")


@dataclass
class Tag:
    object: str
    type: str
    tag: str
    message: str
    tagger: str | None = None


def decode_tag(data: bytes) -> Tag:
    head, blank, message = data.decode("utf-8", "surrogateescape").partition("\n\n")
    got = dict(reversed(_headers(head)))
    if not blank or not {"object", "type", "tag"} <= got.keys() or not HEX40.fullmatch(got["object"]) or got["type"] not in TYPES:
        raise TreelakeError("malformed_tag")
    return Tag(got["object"], got["type"], got["tag"], message, got.get("tagger"))


def encode_tag(t: Tag) -> bytes:
    headers = [("object", t.object), ("type", t.type), ("tag", t.tag)] + ([("tagger", t.tagger)] if t.tagger is not None else [])
    return (_encode_headers(headers) + "\n" + t.message).encode("utf-8", "surrogateescape")


IDENTITY = re.compile(r"(.+?)\s+<([^>]*)>\s+(\d+)\s+[+-]\d{4}")


@dataclass(frozen=True)
class Identity:
    name: str = ""
    email: str = ""
    time: int = 0


def parse_identity(line: str | None) -> Identity:
    m = IDENTITY.match(line or "")
    return Identity(m[1], m[2], int(m[3])) if m else Identity()


def format_identity(name: str, email: str, time: int, offset: str = "+0000") -> str:
    return f"{name} <{email}> {time} {offset}"


# Varints of packs.


def encode_size(kind: int, size: int) -> bytes:
    """Type and size: four bits of size in the first byte, seven in each that follows."""
    out, byte = bytearray(), kind << 4 | size & 15
    size >>= 4
    while size:
        out.append(byte | 0x80)
        byte = size & 0x7F
        size >>= 7
    out.append(byte)
    return bytes(out)


def decode_size(data: bytes, at: int) -> tuple[int, int, int]:
    """kind, size, place after."""
    byte = _byte(data, at)
    kind, size, shift = byte >> 4 & 7, byte & 15, 4
    while byte & 0x80:
        at += 1
        byte = _byte(data, at)
        size |= (byte & 0x7F) << shift
        shift += 7
        if shift > 63:
            raise TreelakeError("varint_too_long")
    return kind, size, at + 1


def encode_varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def decode_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = _byte(data, at)
        n |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not byte & 0x80:
            return n, at
        if shift > 63:
            raise TreelakeError("varint_too_long")


def encode_offset(n: int) -> bytes:
    """Distance to a delta's base: big end first, one added at each byte that continues."""
    out = [n & 0x7F]
    n >>= 7
    while n:
        n -= 1
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(reversed(out))


def decode_offset(data: bytes, at: int) -> tuple[int, int]:
    byte = _byte(data, at)
    n = byte & 0x7F
    while byte & 0x80:
        at += 1
        byte = _byte(data, at)
        n = (n + 1) << 7 | byte & 0x7F
        if n >> 63:
            raise TreelakeError("varint_too_long")
    return n, at + 1


def _byte(data: bytes, at: int) -> int:
    if at >= len(data):
        raise TreelakeError("truncated_varint")
    return data[at]


@dataclass
class Pointer:
    oid: str
    size: int
    raw: bytes = field(repr=False, default=b"")


LFS_VERSION = b"version https://git-lfs.github.com/spec/v1\n"
_KEY = re.compile(r"[a-z0-9][a-z0-9-]*")


def lfs_pointer(data: bytes) -> Pointer | None:
    """A large-file pointer, or None: at most 1,024 bytes, the version line, then sorted distinct keys with one value each."""
    if len(data) > 1024 or not data.endswith(b"\n") or not data.startswith(LFS_VERSION):
        return None
    try:
        body = data[len(LFS_VERSION) :].decode()
    except UnicodeDecodeError:
        return None
    got: dict[str, str] = {}
    for line in body.split("\n")[:-1]:
        key, space, value = line.partition(" ")
        if not space or not value or " " in value or not _KEY.fullmatch(key) or (got and key <= max(got)):
            return None
        extra = re.fullmatch(r"ext-[+]?[0-9]+-(.+)", key)
        if key not in ("oid", "size") and not (extra and _KEY.fullmatch(extra[1])):
            return None
        got[key] = value
    if not re.fullmatch(r"sha256:[0-9a-f]{64}", got.get("oid", "")) or not re.fullmatch(r"[+]?[0-9]+", got.get("size", "")):
        return None
    return Pointer(got["oid"], int(got["size"]), data)
