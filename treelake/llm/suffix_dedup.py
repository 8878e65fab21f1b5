"""Exact removal of long repeats with a logarithmic family of sparse suffix arrays.

Every byte that some `length`-byte string covers which also starts anywhere else goes. Sorting all suffixes of a corpus is more than
needed: of each window of the shortest length one suffix is chosen by the window's content alone (the smallest hash among its strings
of a quarter of that length), so equal windows choose equal suffixes at equal places. What is around a chosen suffix, from its first
window to the end of the longest string that begins in its last, is its context.

1. Each task sorts its batch's chosen suffixes. Blocks of such arrays go to buckets, where a family of levels takes them: each new
   array is merge-scanned against the levels there are, and levels of equal size are merged, so that n suffixes lie in O(log n)
   levels. Here suffixes are ordered by fingerprints of their beginnings; what is unique is in no repeat.
2. Of what is left, contexts that are equal as a whole are found in the same way, by 128 bits. They are repeats as a whole.
3. One of each kind of contexts is compared with the other kinds of its suffix on bytes: suffixes are sorted as text, merged through
   the same kind of family, and common prefixes to the right and common suffixes to the left tell which strings occur elsewhere.

A passage in a third of all documents puts at most one row a task into one place: of equal keys in a task only one goes on under its
key, marked as repeated, and the others go on under keys of their own. A suffix with more than `hot` kinds of contexts isn't compared in
one task: each of its windows goes by its own fingerprint (128 bits).

SuffixIndex keeps the levels: each batch of documents is sorted, scanned against all levels in the folder, and added as a level; equal
ones merge. Without an index the table is one batch, and its levels are those of the tasks.

Defined cases: null and empty texts have no bytes; matches don't cross documents; rows with one doc_id and other texts are documents
of their own, and repeated rows are copies of each other; an empty table gives an empty result; other columns, whatever their names,
are kept by remove_repeats and ignored by digests.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.llm.common import cut, release, rows_batch, unused

U = np.uint64
SEGMENT, PLACE = 1 << 18, 20  # windows handled at once; bits of a place among them
NO_ID = -(1 << 63)
LENGTHS = (200, 400)
_random = np.random.default_rng(20240229)
TABLE = _random.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * U(2) + U(1)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, at least n of them."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        base = BASES[which]
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, SEGMENT + 4096), b, U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U))
        _POWERS[which] = (both[0], both[1])
    return _POWERS[which]


def prefix_hash(data: np.ndarray, which: int) -> np.ndarray:
    power, _ = _powers(which, len(data) + 1)
    h = np.zeros(len(data) + 1, U)
    np.cumsum(TABLE[which][data] * power[: len(data)], out=h[1:])
    return h


def _finish(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    return x ^ x >> U(29)


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """Fingerprints of spans of the data that h was made of."""
    return _finish((h[end] - h[start]) * _powers(which, len(h))[1][start])


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ np.multiply(b, U(0x9E3779B97F4A7C15), dtype=U)) * U(0xBF58476D1CE4E5B9)
    return x ^ x >> U(31)


def chosen(data: np.ndarray, starts: np.ndarray, length: int, longest: int) -> tuple[np.ndarray, ...]:
    """The chosen suffixes of joined documents, which begin at starts (the end is in starts, too): document, place of the suffix, first
    and last window that chose it (places in the document), fingerprint of the suffix's beginning, and of its context."""
    k = max(1, length // 4)
    w = length - k + 1
    out: list[tuple[np.ndarray, ...]] = []
    first_ok, last_ok = starts[:-1], starts[1:] - length  # windows of document d start from first_ok to last_ok
    for s in range(0, max(0, len(data) - length + 1), SEGMENT):
        m = min(SEGMENT, len(data) - length + 1 - s)
        lo, hi = np.searchsorted(starts, s, "right") - 1, np.searchsorted(starts, s + m, "left")
        a, b = np.maximum(first_ok[lo:hi], s) - s, np.minimum(last_ok[lo:hi], s + m - 1) - s
        some = b >= a
        if not some.any():
            continue
        seg = data[s : s + m + longest - 1]
        h = prefix_hash(seg[: m + length - 1], 0)
        at = np.arange(len(h) - k)
        kmer = _finish((h[k:] - h[:-k]) * _powers(0, len(h))[1][: len(at)])
        key = kmer & ~U((1 << PLACE) - 1) | at.astype(U)
        pad = np.full(-len(key) % w, ~U(0), U)
        blocks = np.concatenate([key, pad]).reshape(-1, w)
        fwd = np.minimum.accumulate(blocks, axis=1).ravel()
        bwd = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(bwd[:m], fwd[w - 1 : w - 1 + m]) & U((1 << PLACE) - 1)).astype(np.int64)
        edge = np.zeros(m + 1, bool)
        edge[1:m] = place[1:] != place[:-1]
        edge[a[some]] = True
        edge[b[some] + 1] = True
        run = np.flatnonzero(edge[:m])
        end = np.append(run[1:], m) - 1
        doc = np.searchsorted(starts, run + s, "right") - 1
        ok = (run + s >= first_ok[doc]) & (end + s <= last_ok[doc])
        run, end, doc = run[ok], end[ok], doc[ok]
        p = place[run]
        h2 = prefix_hash(seg, 1)
        stop = np.minimum(end + longest, starts[doc + 1] - s)
        whole = span_hash(h2, run, stop, 1) + _mix((end - run).astype(U), (stop - run).astype(U))
        base = s - starts[doc]
        out.append((doc, p + base, run + base, end + base, kmer[p], whole))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64,) * 4 + (U,) * 2)
    return tuple(np.concatenate(c) for c in zip(*out))


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of a column, and where each begins (with the end)."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _equal_size(a: int, b: int) -> bool:
    """Whether a level of b is large enough to be merged into the one of a before it."""
    return a.bit_length() <= b.bit_length()


class Levels:
    """A family of sorted arrays of distinct fingerprints (key and check), each about twice as large as the next. `add` sorts a batch,
    merge-scans it against all levels, and keeps what is new; equal-sized levels are then merged."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = 0
        self._again: list[np.ndarray] = []
        self._hit: list[np.ndarray] = []

    def add(self, key: np.ndarray, check: np.ndarray) -> None:
        """Keys get the numbers that follow those before."""
        order = np.lexsort((check, key))
        k, c, number = key[order], check[order], order + self.count
        self.count += len(key)
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        group = np.cumsum(new) - 1
        heads = number[new]
        self._again.append(number[~new])
        self._hit.append(heads[group[~new]])
        k, c, number = k[new], c[new], heads
        for lk, lc, ln in self.levels:
            at = np.searchsorted(lk, k)
            found = np.zeros(len(k), bool)
            open_ = np.arange(len(k))
            while len(open_):
                open_ = open_[at[open_] < len(lk)]
                open_ = open_[lk[at[open_]] == k[open_]]
                same = lc[at[open_]] == c[open_]
                found[open_[same]] = True
                open_ = open_[~same]
                at[open_] += 1
            self._again.append(number[found])
            self._hit.append(ln[at[found]])
            k, c, number = k[~found], c[~found], number[~found]
        if len(k):
            self.levels.append((k, c, number))
        while len(self.levels) > 1 and _equal_size(len(self.levels[-2][0]), len(self.levels[-1][0])):
            (k1, c1, n1), (k2, c2, n2) = self.levels.pop(), self.levels.pop()
            k, c, n = np.concatenate([k2, k1]), np.concatenate([c2, c1]), np.concatenate([n2, n1])
            order = np.argsort(k, kind="stable")  # equal keys with other checks stay in any order
            self.levels.append((k[order], c[order], n[order]))

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """For each number: whether its key is there twice or more, and whether it is its key's first."""
        twice, first = np.zeros(self.count, bool), np.ones(self.count, bool)
        for x in self._again:
            twice[x], first[x] = True, False
        for x in self._hit:
            twice[x] = True
        return twice, first


class SuffixArrays:
    """A family of suffix arrays over bytes: each level is sorted by the text from its suffixes on, and levels of equal size merge."""

    def __init__(self):
        self.levels: list[list[tuple[bytes, bytes, int]]] = []

    def add(self, batch: list[tuple[bytes, bytes, int]]) -> None:
        """Each: what the suffix begins with, what is before it backwards, and its number."""
        if batch:
            self.levels.append(sorted(batch))
        while len(self.levels) > 1 and _equal_size(len(self.levels[-2]), len(self.levels[-1])):
            last = self.levels.pop()
            self.levels[-1] = sorted(self.levels[-1] + last)  # two sorted runs: one linear merge

    def merged(self) -> list[tuple[bytes, bytes, int]]:
        while len(self.levels) > 1:
            last = self.levels.pop()
            self.levels[-1] = sorted(self.levels[-1] + last)
        return self.levels[0] if self.levels else []


def common_prefixes(parts: list[bytes], rows: int = 4096) -> np.ndarray:
    """Length of what each of sorted texts has in common with the one before it."""
    out = np.zeros(len(parts), np.int64)
    for s in range(0, len(parts) - 1, rows):
        some = parts[s : s + rows + 1]
        size = np.fromiter(map(len, some), np.int64, len(some))
        m = np.full((len(some), int(size.max()) + 1), 256, np.int16)
        m[1::2] = 257  # so neighbours differ behind their ends
        m[np.arange(m.shape[1]) < size[:, None]] = np.frombuffer(b"".join(some), np.uint8)
        out[s + 1 : s + len(some)] = (m[1:] != m[:-1]).argmax(axis=1)
    return out


def repeated_starts(arrays: SuffixArrays, first: np.ndarray, last: np.ndarray, lengths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length the pairs (number, how far before the suffix) of strings that occur in another context, too. first, last: by number,
    how far before its suffix the last and the first window of a context begin."""
    order = arrays.merged()
    n = len(order)
    if n < 2:
        return [(np.zeros(0, np.int64),) * 2 for _ in lengths]
    number = np.fromiter((x[2] for x in order), np.int64, n)
    right, size = common_prefixes([x[0] for x in order]), np.fromiter((len(x[0]) for x in order), np.int64, n)
    by_left = np.array(sorted(range(n), key=lambda i: order[i][1]))
    left = common_prefixes([order[i][1] for i in by_left])
    first, last = first[number], last[number]
    hits: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in lengths]
    kind = np.empty(n, np.int64)
    for before in range(int(last.max()) + 1):
        on = np.flatnonzero((first <= before) & (before <= last))
        if len(on) < 2:
            continue
        kind[by_left] = np.cumsum(left < before)
        for j, length in enumerate(lengths):
            some = on[size[on] >= length - before]
            key = np.cumsum(right < length - before)[some] * n + kind[some]
            by = np.argsort(key)
            same = key[by[1:]] == key[by[:-1]]
            hit = np.zeros(len(some), bool)
            hit[by[1:][same]] = True
            hit[by[:-1][same]] = True
            hits[j].append((number[some[hit]], np.full(int(hit.sum()), before)))
    return [tuple(np.concatenate(c) for c in zip(*h)) if h else (np.zeros(0, np.int64),) * 2 for h in hits]  # type: ignore[misc]


# Blocks: arrays of suffixes, sorted by fingerprint, as one binary value for each bucket

SUFFIX = {"kh": U, "wh": U, "uid": U, "tag": np.uint32, "p1": np.int32, "span": np.uint16, "off": np.uint16, "flags": np.uint8}
SINGLE = {"key": U, "check": U, "uid": U, "tag": np.uint32, "p1": np.int32, "flags": np.uint8}
ROUTED, KNOWN, FULL, REP, WANT = 1, 2, 4, 8, 16  # it stands for its key in its bucket; its key is repeated; its context is; it stands for its kind
BLOCKS = "bucket int, block binary"
STEP = "uid long, tag int, kh long, p1 int, p2 int, off int, full boolean, rep boolean"
CONTEXT = "bucket int, uid long, tag int, p1 int, p2 int, off int, want boolean, context binary, block binary"
SPAN = "uid long, tag int, p1 int, p2 int, lengths int"
Columns = dict[str, np.ndarray]


def _row(kinds: dict[str, type]) -> int:
    return sum(np.dtype(k).itemsize for k in kinds.values())


def _unpack(blocks: list[bytes], kinds: dict[str, type]) -> Columns:
    parts: dict[str, list[np.ndarray]] = {c: [] for c in kinds}
    for block in blocks:
        n, at = len(block) // _row(kinds), 0
        for c, k in kinds.items():
            parts[c].append(np.frombuffer(block, k, n, at))
            at += n * np.dtype(k).itemsize
    return {c: np.concatenate(p) if p else np.zeros(0, kinds[c]) for c, p in parts.items()}


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def _packed(cols: Columns, bucket: np.ndarray, kinds: dict[str, type]) -> Iterator[tuple[int, bytes]]:
    """Each bucket's rows, sorted by the first two columns."""
    k1, k2 = list(kinds)[:2]
    order = np.lexsort((cols[k2], cols[k1], bucket))
    bucket = bucket[order]
    cols = {c: cols[c][order].astype(k, copy=False) for c, k in kinds.items()}
    edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield int(bucket[a]), b"".join([x[a:b].tobytes() for x in cols.values()])


def _block_batches(rows: Iterator[tuple[int, bytes]], most: int = 256) -> Iterator[pa.RecordBatch]:
    schema, held = pa.schema([("bucket", pa.int32()), ("block", pa.binary())]), []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield rows_batch(schema, list(zip(*held)))
            held = []
    if held:
        yield rows_batch(schema, list(zip(*held)))


def _routes(cols: Columns, key: np.ndarray, check: np.ndarray, buckets: int, joins: np.ndarray | None = None) -> np.ndarray:
    """Buckets. Of the rows with one key in this task the first is routed by it, and all are known as repeated if there are more; the
    others get buckets of their own. joins: the rows that have a key at all."""
    at = np.arange(len(key)) if joins is None else np.flatnonzero(joins)
    at = at[np.lexsort((check[at], key[at]))]
    new = np.ones(len(at), bool)
    new[1:] = (key[at[1:]] != key[at[:-1]]) | (check[at[1:]] != check[at[:-1]])
    alone = new & np.append(new[1:], True)
    flags = cols["flags"] & np.uint8(255 - ROUTED - KNOWN)
    flags[at[new]] |= np.uint8(ROUTED)
    flags[at[~alone]] |= np.uint8(KNOWN)
    cols["flags"] = flags
    own = _mix(cols["uid"], cols["p1"].astype(U) * U(2) + U(1))
    return _bucket(_mix(np.where(flags & ROUTED > 0, key ^ check, own), np.full(1, 3, U)), buckets)


def _reduce(it: Iterator[pa.RecordBatch], whole: bool) -> tuple[Columns, np.ndarray, np.ndarray] | None:
    """All rows of a task, which of them are repeated, and which is its key's first. The key is the suffix, and the context if whole."""
    levels, parts, where, n = Levels(), [], [], 0
    for b in it:
        for block in b.column(1):
            c = _unpack([block.as_py()], SUFFIX)
            at = np.flatnonzero(c["flags"] & ROUTED)
            levels.add(c["kh"][at], c["wh"][at] if whole else np.zeros(len(at), U))
            where.append(at + n)
            parts.append(c)
            n += len(c["kh"])
    if not n:
        return None
    cols = {c: np.concatenate([p[c] for p in parts]) for c in SUFFIX}
    at = np.concatenate(where)
    twice, first = np.zeros(n, bool), np.zeros(n, bool)
    twice[at], first[at] = levels.result()
    return cols, twice | (cols["flags"] & KNOWN > 0), first


def _choose(lengths: tuple[int, ...], buckets: int) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in it:
            if b.num_rows:
                data, starts = joined(b.column(2))
                doc, at, p1, p2, kh, wh = chosen(data, starts, lengths[0], lengths[-1])
                uid, tag = b.column(0).to_numpy().view(U)[doc], b.column(1).to_numpy().view(np.uint32)[doc]
                parts.append((kh, wh, uid, tag, p1.astype(np.int32), (p2 - p1).astype(np.uint16), (at - p1).astype(np.uint16), np.zeros(len(doc), np.uint8)))
        if parts:
            cols = dict(zip(SUFFIX, map(np.concatenate, zip(*parts))))
            parts.clear()
            yield from _block_batches(_packed(cols, _routes(cols, cols["kh"], np.zeros(len(cols["kh"]), U), buckets), SUFFIX))
            del cols
            release()

    return run


def _by_suffix(buckets: int) -> Callable:
    """Keeps suffixes that are repeated, and routes them by their contexts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _reduce(it, False)) is not None:
            cols, twice, _ = got
            cols = {c: x[twice] for c, x in cols.items()}
            yield from _block_batches(_packed(cols, _routes(cols, cols["kh"], cols["wh"], buckets), SUFFIX))

    return run


def _by_context(buckets: int) -> Callable:
    """Marks contexts that are repeated as a whole; one of each kind is routed by its suffix, to see if there are other kinds."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _reduce(it, True)) is not None:
            cols, twice, first = got
            cols["flags"] = np.where(twice, FULL, 0).astype(np.uint8) | np.where(first, REP, 0).astype(np.uint8)
            yield from _block_batches(_packed(cols, _routes(cols, cols["kh"], np.zeros(len(first), U), buckets, first), SUFFIX))

    return run


def _contested(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows: rep says that other contexts have the suffix, too, and that this one stands for its kind."""
    if (got := _reduce(it, False)) is not None:
        cols, twice, _ = got
        full, rep = cols["flags"] & FULL > 0, (cols["flags"] & REP > 0) & twice
        schema = pa.schema([("uid", pa.int64()), ("tag", pa.int32()), ("kh", pa.int64()), ("p1", pa.int32()), ("p2", pa.int32()), ("off", pa.int32()), ("full", pa.bool_()), ("rep", pa.bool_())])
        at = np.flatnonzero(full | rep)
        for s in range(0, len(at), 50_000):
            c = {k: x[at[s : s + 50_000]] for k, x in cols.items()}
            p2 = c["p1"] + c["span"]
            yield rows_batch(schema, [c["uid"].view(np.int64), c["tag"].view(np.int32), c["kh"].view(np.int64), c["p1"], p2.astype(np.int32), c["off"].astype(np.int32), full[at[s : s + 50_000]], rep[at[s : s + 50_000]]])


def _contexts(lengths: tuple[int, ...], buckets: int) -> Callable:
    """Contested contexts of each document, by suffix; but of a suffix with very many kinds each window for itself."""
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
    schema = pa.schema(list(zip([c.split()[0] for c in CONTEXT.split(", ")], kinds)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone: list[tuple[np.ndarray, ...]] = []
        for b in it:
            if not b.num_rows:
                continue
            data, starts = joined(b.column(2))
            spans = b.column(3)
            doc = np.repeat(np.arange(b.num_rows), spans.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            s = spans.flatten()
            p1, p2, off, kh = (s.field(c).to_numpy().astype(np.int64) for c in ("p1", "p2", "off", "kh"))
            full, hot = (s.field(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("full", "hot"))
            uid, tag = b.column(0).to_numpy()[doc], b.column(1).to_numpy()[doc]
            begin, stop = starts[doc] + p1, np.minimum(starts[doc] + p2 + lengths[-1], starts[doc + 1])
            at = np.flatnonzero(~hot)
            for k in range(0, len(at), 10_000):
                c = at[k : k + 10_000]
                bytes_ = [data[x:y].tobytes() for x, y in zip(begin[c].tolist(), stop[c].tolist())]
                yield rows_batch(schema, [_bucket(_mix(kh[c].view(U), np.full(1, 5, U)), buckets).astype(np.int32), uid[c], tag[c], p1[c].astype(np.int32), p2[c].astype(np.int32), off[c].astype(np.int32), ~full[c], pa.array(bytes_, pa.binary()), pa.nulls(len(c), pa.binary())])
            for i in np.flatnonzero(hot).tolist():
                part = data[begin[i] : stop[i]]
                h = [prefix_hash(part, which) for which in (0, 1)]
                for j, length in enumerate(lengths):
                    p = np.arange(min(p2[i] - p1[i] + 1, len(part) - length + 1))
                    if len(p):
                        key, check = (span_hash(h[which], p, p + length, which) + U(j) for which in (0, 1))
                        same = len(p)
                        alone.append((key, check, np.full(same, uid[i]).view(U), np.full(same, tag[i]).view(np.uint32), (p + p1[i]).astype(np.int32), np.full(same, (0 if full[i] else WANT) | 32 << j, np.uint8)))
        if alone:
            cols = dict(zip(SINGLE, map(np.concatenate, zip(*alone))))
            for bucket, block in _packed(cols, _routes(cols, cols["key"], cols["check"], buckets), SINGLE):
                yield rows_batch(schema, [[bucket], [0], [0], [0], [0], [0], [False], pa.nulls(1, pa.binary()), pa.array([block], pa.binary())])

    return run


def _spans(uid: np.ndarray, tag: np.ndarray, p1: np.ndarray, p2: np.ndarray, lengths: np.ndarray | int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("uid", pa.int64()), ("tag", pa.int32()), ("p1", pa.int32()), ("p2", pa.int32()), ("lengths", pa.int32())])
    bits = np.broadcast_to(np.asarray(lengths, np.int32), p1.shape)
    for s in range(0, len(p1), 50_000):
        e = s + 50_000
        yield rows_batch(schema, [uid[s:e].view(np.int64), tag[s:e].view(np.int32), p1[s:e].astype(np.int32), p2[s:e].astype(np.int32), bits[s:e]])


def _repeated(lengths: tuple[int, ...]) -> Callable:
    """Runs of repeated windows, by length (a bit for each)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        singles, single_parts = Levels(), []
        arrays, rows, n = SuffixArrays(), [], 0
        for b in it:
            for block in b.column(8).drop_null():
                c = _unpack([block.as_py()], SINGLE)
                single_parts.append(c)
                at = c["flags"] & ROUTED > 0
                singles.add(c["key"][at], c["check"][at])
            some = np.flatnonzero(b.column(7).is_valid().to_numpy(zero_copy_only=False))
            if len(some):
                off = b.column(5).to_numpy()[some]
                arrays.add([(c[o:], c[:o][::-1], n + i) for i, (c, o) in enumerate(zip(b.column(7).take(pa.array(some)).to_pylist(), off.tolist()))])
                n += len(some)
                rows.append((b.column(1).to_numpy()[some], b.column(2).to_numpy()[some], b.column(3).to_numpy()[some], b.column(4).to_numpy()[some], off, b.column(6).to_numpy(zero_copy_only=False)[some].astype(bool)))
        if rows:
            uid, tag, p1, p2, off, want = map(np.concatenate, zip(*rows))
            at = p1.astype(np.int64) + off
            for j, (number, before) in enumerate(repeated_starts(arrays, at - p2, at - p1, lengths)):
                keep = want[number]
                number, p = number[keep], (at[number] - before)[keep]
                order = np.lexsort((p, number))
                number, p = number[order], p[order]
                begin = np.ones(len(p), bool)
                begin[1:] = (number[1:] != number[:-1]) | (p[1:] != p[:-1] + 1)
                end = np.append(begin[1:], True)[: len(p)]
                yield from _spans(uid[number[begin]], tag[number[begin]], p[begin], p[end], 1 << j)
        if single_parts:
            cols = {c: np.concatenate([p[c] for p in single_parts]) for c in SINGLE}
            twice = cols["flags"] & KNOWN > 0
            twice[np.flatnonzero(cols["flags"] & ROUTED > 0)] |= singles.result()[0]
            hit = np.flatnonzero(twice & (cols["flags"] & WANT > 0))
            yield from _spans(cols["uid"][hit], cols["tag"][hit], cols["p1"][hit], cols["p1"][hit], (cols["flags"][hit] >> 5).astype(np.int32))
        arrays.levels.clear()
        rows.clear()
        release()

    return run


def _key_columns(salt: int = 0) -> dict:
    """What tells rows with other ids or texts apart: 96 bits."""
    text, id_ = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return {"uid": F.xxhash64(id_, text, F.lit(salt)), "tag": F.hash(text, id_, F.lit(salt))}


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _from_blocks(blocks: DataFrame, keyed: DataFrame, names: tuple[str, str, str], lengths: tuple[int, ...], hot: int, buckets: int) -> DataFrame:
    """The spans of `repeats` from blocks of chosen suffixes and the documents that they are of. All columns of keyed are read, so that
    the shuffled documents are the ones that the spans are joined to in the end."""
    uid, tag, text = names
    step = blocks
    for by in (_by_suffix(buckets), _by_context(buckets)):
        step = step.repartitionById(buckets, "bucket").mapInArrow(by, BLOCKS)
    step = cut(step.repartitionById(buckets, "bucket").mapInArrow(_contested, STEP), "suffixes")
    rep = step.where("rep")
    many = rep.groupBy("kh").count().where(F.col("count") > hot).select("kh", F.lit(True).alias("hot"))
    of = rep.join(many, "kh", "left").groupBy(F.col("uid").alias(uid), F.col("tag").alias(tag)).agg(F.collect_set(F.struct("p1", "p2", "off", "kh", "full", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("_spans"))
    others = [F.col(f"`{c}`") for c in keyed.columns if c not in names]
    found = keyed.join(of.withColumnRenamed("_spans", hidden := unused(keyed, "spans")), [uid, tag]).select(uid, tag, text, hidden, *others).mapInArrow(_contexts(lengths, buckets), CONTEXT)
    found = found.repartitionById(buckets, "bucket").mapInArrow(_repeated(lengths), SPAN)
    every = found.unionByName(step.where("full").select("uid", "tag", "p1", "p2", F.lit((1 << len(lengths)) - 1).alias("lengths")))
    return every.groupBy("uid", "tag").agg(F.collect_set(F.struct("p1", "p2", "lengths")).alias("spans"))


def _keyed(docs: DataFrame) -> tuple[DataFrame, tuple[str, str, str]]:
    names = (unused(docs, "uid"), unused(docs, "tag"), "text")
    return docs.withColumns(dict(zip(names, _key_columns().values()))), names


def repeats(keyed: DataFrame, names: tuple[str, str, str], lengths: tuple[int, ...] = LENGTHS, hot: int = 5000) -> DataFrame:
    """uid, tag, spans of each document that has repeats: first and last start of runs of repeated windows, with a bit for each of the
    lengths (ascending) that they are repeated at; those of a long length reach as far as the document has room for it. hot: from so many
    kinds of contexts on those of one suffix aren't compared in one task."""
    buckets = _buckets(keyed.sparkSession)
    blocks = keyed.select(*names).mapInArrow(_choose(lengths, buckets), BLOCKS)
    return _from_blocks(blocks, keyed, names, lengths, hot, buckets)


def _mask_of(n: int, spans: pa.Scalar, bit: int, length: int) -> np.ndarray:
    if not spans.is_valid:
        return np.zeros(n, bool)
    p1, p2, lengths = (spans.values.field(c).to_numpy().astype(np.int64) for c in ("p1", "p2", "lengths"))
    p2 = np.minimum(p2, n - length)
    ok = (lengths >> bit & 1 > 0) & (p2 >= p1)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, p1[ok], 1)
    np.add.at(edge, p2[ok] + length, -1)
    return np.cumsum(edge[:n]) > 0


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, repeats boolean"


def _digests(lengths: tuple[int, ...]) -> Callable:
    schema = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]]) for c in DIGESTS.split(", ")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            data, starts = joined(b.column(1))
            out = []
            for k in range(b.num_rows):
                raw, spans = data[starts[k] : starts[k + 1]], b.column(2)[k]
                gone = _mask_of(len(raw), spans, len(lengths) - 1, lengths[-1])
                short = int(_mask_of(len(raw), spans, 0, lengths[0]).sum())
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(raw[~gone].tobytes()).hexdigest(), short, short > 0))
            yield rows_batch(schema, [b.column(0), *zip(*out)])

    return run


def digests(docs: DataFrame, length: int = 400, short: int = 200, hot: int = 5000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is left, of each document, by strings of `length` bytes; and n_repeated,
    the bytes that strings of `short` bytes cover which start elsewhere, too, and repeats, whether there are any."""
    lengths = (min(short, length), length) if short < length else (length,)
    keyed, names = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = repeats(keyed, names, lengths, hot).withColumnsRenamed({"uid": names[0], "tag": names[1]})
    return keyed.join(found, list(names[:2]), "left").select("doc_id", "text", "spans").mapInArrow(_digests(lengths), DIGESTS)


def remove_repeats(docs: DataFrame, length: int = 400, hot: int = 5000) -> DataFrame:
    """docs with the repeated bytes cut out of text, all other columns as they are. Bytes of a character that is cut in two go with it."""
    keyed, names = _keyed(docs)
    found = repeats(keyed, names, (length,), hot).toDF(names[0], names[1], hidden := unused(docs, "spans"))
    joined_ = keyed.join(found, list(names[:2]), "left").select(*[F.col(f"`{c}`") for c in docs.columns], hidden)
    text = docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            spans = b.column(b.num_columns - 1)
            if spans.null_count < b.num_rows:
                new = []
                for t, s in zip(b.column(text), spans):
                    t = t.as_py()
                    if t is not None and s.is_valid:
                        raw = np.frombuffer(t.encode("utf-8"), np.uint8)
                        t = raw[~_mask_of(len(raw), s, 0, length)].tobytes().decode("utf-8", "ignore")
                    new.append(t)
                b = b.set_column(text, b.schema.field(text), pa.array(new, b.schema.field(text).type))
            yield b.select(list(range(b.num_columns - 1)))

    return joined_.mapInArrow(run, docs.schema)


class SuffixIndex:
    """A logarithmic family of levels in a folder: `docs` and `levels` by batch, `spans` of all batches so far, and `state`, which names
    the levels (path and number of suffixes, largest first). A batch that fails leaves the state as it was."""

    def __init__(self, spark: SparkSession, folder: str, lengths: tuple[int, ...] = LENGTHS, buckets: int | None = None, hot: int = 5000):
        self.spark, self.folder, self.lengths, self.hot = spark, folder.rstrip("/"), lengths, hot
        self.buckets, self.batches, self.levels = buckets or _buckets(spark), 0, []
        path, fs = self._hadoop(f"{self.folder}/state")
        done = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(self._hadoop(f"{s.getPath()}/_SUCCESS")[0])] if fs.exists(path) else []
        if done:
            state = json.loads(spark.read.text(f"{self.folder}/state/{max(done)}").first().value)
            self.batches, self.levels = state["batches"], [tuple(x) for x in state["levels"]]
            self.buckets, self.lengths = state["buckets"], tuple(state["lengths"])

    def _hadoop(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _docs(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/docs/{k}" for k in range(self.batches)])

    def add(self, docs: DataFrame) -> None:
        """Sorts the batch's suffixes, scans them against all levels, and merges levels of equal size."""
        n, at = self.batches, self.folder
        batch = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        batch.withColumns(_key_columns(n)).write.mode("overwrite").parquet(f"{at}/docs/{n}")
        fresh = self.spark.read.parquet(f"{at}/docs/{n}").select("uid", "tag", "text").mapInArrow(_choose(self.lengths, self.buckets), BLOCKS)
        self._level(fresh, f"{at}/levels/{n}")
        self.batches, levels = n + 1, [*self.levels, (f"levels/{n}", self._size(f"{at}/levels/{n}"))]
        keyed = self._docs().select("uid", "tag", "text")
        blocks = self.spark.read.parquet(*[f"{at}/{p}" for p, _ in levels])
        _from_blocks(blocks, keyed, ("uid", "tag", "text"), self.lengths, self.hot, self.buckets).write.mode("overwrite").parquet(f"{at}/spans/{n}")
        old, k = [], 0
        while len(levels) > 1 and _equal_size(levels[-2][1], levels[-1][1]):
            (b, nb), (a, na) = levels.pop(), levels.pop()
            self._level(self.spark.read.parquet(f"{at}/{a}", f"{at}/{b}"), f"{at}/levels/{n}-{k}")
            levels.append((f"levels/{n}-{k}", na + nb))
            old, k = [*old, a, b], k + 1
        state = json.dumps({"batches": n + 1, "levels": levels, "buckets": self.buckets, "lengths": self.lengths})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/state/{n:09d}")
        self.levels = levels
        for p in old + ([f"spans/{n - 1}"] if n else []):
            path, fs = self._hadoop(f"{at}/{p}")
            fs.delete(path, True)

    def _size(self, path: str) -> int:
        return (self.spark.read.parquet(path).agg(F.sum(F.octet_length("block"))).first()[0] or 0) // _row(SUFFIX)

    def _level(self, blocks: DataFrame, path: str) -> None:
        """One sorted array for each bucket."""

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[bytes]] = {}
            for b in it:
                for bucket, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    held.setdefault(bucket, []).append(block)
            for bucket, some in sorted(held.items()):
                cols = _unpack(some, SUFFIX)
                yield from _block_batches(_packed(cols, np.full(len(cols["kh"]), bucket), SUFFIX))

        blocks.repartitionById(self.buckets, "bucket").mapInArrow(run, BLOCKS).write.mode("overwrite").parquet(path)

    def digests(self) -> DataFrame:
        """As the function of that name, over all batches."""
        spans = self.spark.read.parquet(f"{self.folder}/spans/{self.batches - 1}")
        return self._docs().join(spans, ["uid", "tag"], "left").select("doc_id", "text", "spans").mapInArrow(_digests(self.lengths), DIGESTS)
