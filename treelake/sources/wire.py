"""Fetching and pushing over HTTP: the public protocol of packet lines, version 2 for reading.

Requests go through a function (method, url, headers, body) that gives the answer's bytes, so anything that can post may carry them;
`urlopen` is the standard library's. The driver talks to the server; what comes back is a table, or a pack in a folder that
executors read as any other.
"""

from __future__ import annotations

import base64
import os
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from treelake.functions.objects import HEX40, TreelakeError
from treelake.functions.pktline import decode_all, demultiplex, encode, mark
from treelake.operators.reports import traced
from treelake.sources.pack import Index, StreamReader, write_index, write_pack
from treelake.sources.repository import REFS

Send = Callable[[str, str, dict[str, str], bytes | None], bytes]
AGENT = b"agent=treelake"
NOTHING = "0" * 40


def urlopen(method: str, url: str, headers: dict[str, str], body: bytes | None, seconds: float = 60) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, body, headers, method=method), timeout=seconds) as answer:
        return answer.read()


@dataclass(frozen=True)
class Credentials:
    """A header for some hosts alone; never shown."""

    hosts: tuple[str, ...]
    header: str = field(repr=False)

    @staticmethod
    def basic(user: str, password: str, *hosts: str) -> Credentials:
        return Credentials(hosts, "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode())

    @staticmethod
    def bearer(token: str, *hosts: str) -> Credentials:
        return Credentials(hosts, f"Bearer {token}")

    @staticmethod
    def token(token: str, *hosts: str, user: str = "x-access-token") -> Credentials:
        """Hosts that take a token as the password of a fixed user."""
        return Credentials.basic(user, token, *hosts)

    def headers(self, url: str) -> dict[str, str]:
        parts = urllib.parse.urlsplit(url)
        return {"Authorization": self.header} if parts.hostname in self.hosts and parts.scheme == "https" else {}


def request(command: bytes, capabilities: Iterable[bytes], arguments: Iterable[bytes]) -> bytes:
    lines = [encode(b"command=" + command + b"\n"), *[encode(c + b"\n") for c in capabilities], mark("delim"), *[encode(a + b"\n") for a in arguments]]
    return b"".join(lines) + mark("flush")


def parse_capabilities(answer: bytes) -> dict[str, str]:
    """Capabilities of a version 2 server; another version is an error."""
    lines = [p.rstrip(b"\n").decode() for kind, p in decode_all(answer) if kind == "data"]
    lines = [x for x in lines if not x.startswith("# service=")]
    if not lines or lines[0] != "version 2":
        raise TreelakeError("protocol_version", line=lines[0] if lines else "")
    return {k: v for k, _, v in (x.partition("=") for x in lines[1:])}


def parse_refs(answer: bytes) -> list[tuple[str, str, str | None, str | None, str | None]]:
    """name, kind, sha, target, peeled of each reference."""
    out = []
    for kind, payload in decode_all(answer):
        if kind != "data":
            continue
        if payload.startswith(b"ERR "):
            raise TreelakeError("remote", text=payload[4:].decode("utf-8", "replace").strip())
        sha, name, *more = payload.rstrip(b"\n").decode().split(" ")
        if sha != "unborn" and not HEX40.fullmatch(sha):
            raise TreelakeError("invalid_ref", text=sha[:60])
        extra = dict(x.partition(":")[::2] for x in more)
        target = extra.get("symref-target")
        out.append((name, "symbolic" if target else "direct", None if sha == "unborn" else sha, target, extra.get("peeled")))
    return out


def parse_fetch(answer: bytes) -> tuple[bytes, list[str]]:
    """The pack, and what the server said beside it. Packs outside of side bands are taken, too."""
    packets = decode_all(answer)
    at = next((k for k, (kind, p) in enumerate(packets) if kind == "data" and p.rstrip(b"\n") == b"packfile"), None)
    for kind, p in packets[: at if at is not None else None]:
        if kind == "data" and p.startswith(b"ERR "):
            raise TreelakeError("remote", text=p[4:].decode("utf-8", "replace").strip())
    if at is None:
        raise TreelakeError("no_pack")
    end = next((k for k in range(at, len(packets)) if packets[k][0] == "flush"), len(packets))
    body = packets[at + 1 : end]
    if body and body[0][1][:4] == b"PACK":
        return b"".join(p for _, p in body), []
    bands = demultiplex(body)
    if bands["error"]:
        raise TreelakeError("remote", text=b"".join(bands["error"]).decode("utf-8", "replace").strip())
    return b"".join(bands["data"]), [x.decode("utf-8", "replace") for x in bands["progress"]]


def parse_report(answer: bytes) -> dict[str, str]:
    """The result of each reference of a push: ok or the server's reason."""
    packets = [p for kind, p in decode_all(answer) if kind == "data"]
    if packets and packets[0][:1] in (b"\1", b"\2", b"\3"):
        bands = demultiplex([("data", p) for p in packets])
        if bands["error"]:
            raise TreelakeError("remote", text=b"".join(bands["error"]).decode("utf-8", "replace").strip())
        packets = [p for kind, p in decode_all(b"".join(bands["data"])) if kind == "data"]
    lines = [p.rstrip(b"\n").decode("utf-8", "replace") for p in packets]
    if not lines or lines[0] != "unpack ok":
        raise TreelakeError("unpack_failed", text=lines[0] if lines else "")
    out = {}
    for x in lines[1:]:
        verdict, _, rest = x.partition(" ")
        name, _, why = rest.partition(" ")
        out[name] = "ok" if verdict == "ok" else why or "ng"
    return out


@dataclass
class Remote:
    """A repository behind an address. Capabilities are asked for once."""

    url: str
    credentials: Credentials | None = None
    send: Send = urlopen
    _capabilities: dict[str, str] | None = field(default=None, repr=False)

    def _call(self, method: str, path: str, body: bytes | None = None, kind: str = "") -> bytes:
        url = f"{self.url.rstrip('/')}/{path}"
        headers = {"Git-Protocol": "version=2"} | (self.credentials.headers(url) if self.credentials else {})
        if kind:
            headers |= {"Content-Type": f"application/x-{kind}-request", "Accept": f"application/x-{kind}-result"}
        return self.send(method, url, headers, body)

    def capabilities(self) -> dict[str, str]:
        if self._capabilities is None:
            self._capabilities = parse_capabilities(self._call("GET", "info/refs?service=git-upload-pack"))
        return self._capabilities

    def _read(self, command: bytes, arguments: list[bytes]) -> bytes:
        if command.decode() not in self.capabilities():
            raise TreelakeError("not_supported", command=command.decode())
        return self._call("POST", "git-upload-pack", request(command, [AGENT], arguments), "git-upload-pack")

    def refs(self, prefixes: Iterable[str] = ()) -> list[tuple[str, str, str | None, str | None, str | None]]:
        return parse_refs(self._read(b"ls-refs", [b"peel", b"symrefs", *[b"ref-prefix " + p.encode() for p in prefixes]]))

    def ref_table(self, spark: SparkSession, prefixes: Iterable[str] = ()) -> DataFrame:
        return spark.createDataFrame(self.refs(prefixes), REFS + ", peeled string")

    @traced("transfer.fetch")
    def fetch(self, wants: list[str], haves: Iterable[str] = (), spec: str | None = None, depth: int | None = None) -> bytes:
        """A pack of what the wanted ids reach and the others don't."""
        offers = self.capabilities().get("fetch", "").split(" ")
        for option, on in (("filter", spec is not None), ("shallow", depth is not None)):
            if on and option not in offers:
                raise TreelakeError("not_supported", option=option)
        arguments = [b"ofs-delta", b"no-progress", *[b"want " + s.encode() for s in wants], *[b"have " + s.encode() for s in haves]]
        arguments += [b"filter " + spec.encode()] if spec is not None else []
        arguments += [b"deepen %d" % depth] if depth is not None else []
        return parse_fetch(self._read(b"fetch", [*arguments, b"done"]))[0]

    def fetch_into(self, folder: str, wants: list[str], **options) -> str:
        """The same as a checked pack with its index in a folder that all executors share; its name."""
        data = self.fetch(wants, **options)
        reader = StreamReader()
        for k in range(0, len(data), 1 << 20):
            reader.feed(data[k : k + (1 << 20)])
        whole, index = write_pack([(o.type, o.content) for o in reader.finish()])
        os.makedirs(folder, exist_ok=True)
        name = os.path.join(folder, f"pack-{whole[-20:].hex()}")
        body = write_index(index, whole[-20:])
        Index(body)
        for suffix, content in ((".pack", whole), (".idx", body)):
            with open(f"{name}{suffix}.new", "wb") as f:
                f.write(content)
            os.replace(f"{name}{suffix}.new", name + suffix)
        return name

    @traced("transfer.push")
    def push(self, updates: list[tuple[str, str | None, str | None]], objects: list[tuple[str, bytes]]) -> dict[str, str]:
        """updates: name, the id that is expected there (None: nothing) and the new one (None: remove it). The result by name."""
        lines = [f"{old or NOTHING} {new or NOTHING} {name}".encode() for name, old, new in updates]
        if not lines:
            return {}
        body = encode(lines[0] + b"\0report-status " + AGENT + b"\n") + b"".join(encode(x + b"\n") for x in lines[1:]) + mark("flush")
        if any(new for _, _, new in updates):
            body += write_pack(objects)[0]
        got = parse_report(self._call("POST", "git-receive-pack", body, "git-receive-pack"))
        return {name: got.get(name, "not_reported") for name, _, _ in updates}
