"""Packet lines: four hex digits of length, then the payload; and the marks flush, delim and response_end."""

from __future__ import annotations

from treelake.functions.objects import TreelakeError

MARKS = {0: "flush", 1: "delim", 2: "response_end"}
Packet = tuple[str, bytes]  # kind, payload
MOST = 65516


def encode(payload: bytes) -> bytes:
    if len(payload) > MOST:
        raise TreelakeError("packet_too_long", size=len(payload))
    return b"%04x" % (len(payload) + 4) + payload


def mark(kind: str) -> bytes:
    return b"%04x" % next(n for n, k in MARKS.items() if k == kind)


class Decoder:
    """Takes bytes in any portions and gives the packets that are complete."""

    def __init__(self, rest: bytes = b""):
        self.rest = rest

    def feed(self, data: bytes) -> list[Packet]:
        buffer, at, out = self.rest + data, 0, []
        while len(buffer) - at >= 4:
            try:
                n = int(buffer[at : at + 4], 16)
            except ValueError:
                raise TreelakeError("invalid_length", at=at) from None
            if n in MARKS:
                out.append((MARKS[n], b""))
                at += 4
            elif n == 3:
                raise TreelakeError("invalid_length", at=at)
            elif len(buffer) - at < n:
                break
            else:
                out.append(("data", buffer[at + 4 : at + n]))
                at += n
        self.rest = buffer[at:]
        return out

    def finish(self) -> None:
        if self.rest:
            raise TreelakeError("truncated", left=len(self.rest))


def decode_all(data: bytes) -> list[Packet]:
    d = Decoder()
    out = d.feed(data)
    d.finish()
    return out


def demultiplex(packets: list[Packet]) -> dict[str, list[bytes]]:
    """Side bands: 1 data, 2 progress, 3 error."""
    out: dict[str, list[bytes]] = {"data": [], "progress": [], "error": []}
    for kind, payload in packets:
        if kind == "data" and payload:
            band = {1: "data", 2: "progress", 3: "error"}.get(payload[0])
            if band is None:
                raise TreelakeError("unknown_band", band=payload[0])
            out[band].append(payload[1:])
    return out
