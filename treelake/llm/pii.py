"""Personal data: fixed patterns, and a skip-chain conditional random field that adds spans.

The patterns find e-mail addresses, IP addresses, card and phone numbers. The field labels each token that has a digit, an @, an equals
sign or a double quote, by these kinds or as a secret. Neighbouring such tokens share potentials, and so do distant ones that are
repeated or similar (the same letters and digits, or the same seven digits or more): each with the one before it of its kind, so that a
group of n has n - 1 links. Loopy belief propagation, until messages are steady, makes the labels consistent across a document. Tokens
that are surely of a kind (marginal of at least `sure`) and touch no pattern's span become spans; neighbouring ones are joined. Names,
addresses and secrets in words alone are not looked for.

The field learns from the patterns' own labels, and for secrets from values that are assigned to a word such as token or password, on a
bounded sample (at most `sample` documents with such tokens), by pseudo-likelihood. A token's own features, or those of what is around
it, are left out at random while it learns, so that a value is known without its assignment and the links count.
The sample is the first by hash of id and text, half of it shared evenly by the sets of kinds that a text has and the rest in proportion,
so it is drawn from all rows and depends neither on their order nor on their partitions; repeated rows count once.
Defined cases: null and empty texts have no spans; places count code points, ends are exclusive; repeated rows have equal spans; an
empty table gives an empty result; with no sample nothing is added; other columns, whatever their names, are kept by redact and ignored
by digests; all work on a text is in proportion to its length, besides messages, whose rounds are at most those of the longest group.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from itertools import accumulate
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelake.llm.common import cut, map_batches, rows_batch, texts

KINDS = ("email", "ip", "card", "phone", "secret")
PATTERNS = 4  # the first kinds are those of patterns
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match from within digits would also be one from their start
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TOKEN = re.compile(r"(?<![^ \t-\r])(?=[^ \t-\r0-9@=\"]*+[0-9@=\"])[^ \t-\r]++")
ASSIGNED = re.compile(r"(?<![A-Za-z])(?:[A-Za-z]{1,12}[_-])?(?:token|secret|password|passwd|pwd|key|apikey)[\"']? ?[=:] ?[\"']?([^ \t-\r\"']{8,})", re.I)
DIGITS = tuple("0123456789")
SIGNS = (*DIGITS, "@", "=", '"')
WORD = re.compile(r"[^\W\d_]+")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def base_spans(text: str) -> list[Span]:
    """The patterns' spans by kind, then start: leftmost, not overlapping within a kind, failing matches dropped."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:  # what is before an @ can only end there, so matches are looked for from each @
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    if any([d in text for d in DIGITS]):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m.group().split("."))]
        out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def assigned(text: str, spans: list[Span]) -> list[Span]:
    """Values that are assigned to a word for secrets and have a digit; only the field's training uses them."""
    touch = _Touch(spans)
    return [(4, *m.span(1)) for m in ASSIGNED.finditer(text) if any([d in m[1] for d in DIGITS]) and not touch(*m.span(1))]


class _Touch:
    """Whether some span has a place in common with a range."""

    def __init__(self, spans: list[Span]):
        ordered = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in ordered]
        self.ends = list(accumulate((b for _, b in ordered), max))

    def __call__(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a


def written(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans)])


LABELS = 1 + len(KINDS)  # 0: none
OWN = 11  # features of a token itself come first
EDGES = ".,;:!?\"'#*%&$|="
WIDTH = 4096


def _features(token: str) -> list[str]:
    digits, letters = sum(map(str.isdigit, token)), sum(map(str.isalpha, token))
    core = token.strip(EDGES)
    shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]", "9", core)))[:24]
    return [
        "", f"d{min(digits, 20)}", f"l{min(letters, 6)}", f"s{shape}", f"at{'@' in core}{'.' in core.partition('@')[2]}", f"dots{min(core.count('.'), 5)}", f"hy{min(core.count('-'), 4)}",
        f"b{core[:1] if not core[:1].isalnum() else ''}", f"=({'=' in core}{'(' in core}", f"mix{digits > 0 and letters > 0}", f"quad{core.count('.') == 3 and core.replace('.', '').isdigit()}",
    ]


def _places(names: list[str]) -> list[int]:
    return [zlib.crc32(n.encode()) % WIDTH for n in names]


class Graph:
    """Tokens of a text with features, and the links between them."""

    def __init__(self, text: str):
        found = list(TOKEN.finditer(text))
        self.spans = [m.span() for m in found]
        own = [_features(m.group()) for m in found]
        self.x: list[list[int]] = []
        self.near: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        last: dict[str, int] = {}
        self.longest, near = 1, 0  # of tokens in one chain or group
        group: dict[str, int] = {}
        for k, m in enumerate(found):
            names = list(own[k])
            if k and not text[self.spans[k - 1][1] : m.start()].strip():
                names += ["p" + f for f in own[k - 1][1:5]]
                self.near.append((k - 1, k))
                near += 1
                self.longest = max(self.longest, near)
            else:
                near = 1
            if k + 1 < len(found) and not text[m.end() : self.spans[k + 1][0]].strip():
                names += ["n" + f for f in own[k + 1][1:5]]
            before = WORD.findall(text, max(0, m.start() - 24), m.start())
            names.append("w" + (before[-1].lower()[:12] if before else ""))
            self.x.append(_places(names))
            token = m.group()
            keys = {"t" + "".join(filter(str.isalnum, token)).lower(), "d" + d if len(d := _digits(token)) >= 7 else ""} - {"", "t"}
            for at in sorted({last[key] for key in keys if key in last}):  # a pair that is alike in both ways has one link
                if at != k - 1 or self.near[-1:] != [(at, k)]:
                    self.skip.append((at, k))
            last.update(dict.fromkeys(keys, k))
            for key in keys:
                group[key] = group.get(key, 0) + 1
                self.longest = max(self.longest, group[key])

    def labels(self, spans: list[Span]) -> list[int]:
        """The first kind of which a span covers at least half of each token."""
        by = [sorted((s, e) for k, s, e in spans if k == kind) for kind in range(len(KINDS))]
        ends = [[e for _, e in x] for x in by]
        out = []
        for a, b in self.spans:
            label = 0
            for kind, some in enumerate(by):
                k = bisect_right(ends[kind], a)
                while not label and k < len(some) and some[k][0] < b:
                    if 2 * (min(b, some[k][1]) - max(a, some[k][0])) >= b - a:
                        label = kind + 1
                    k += 1
            out.append(label)
        return out


class SkipChainCrf:
    def __init__(self):
        self.w = np.zeros((WIDTH, LABELS))
        self.near = np.zeros((LABELS, LABELS))
        self.skip = np.zeros((LABELS, LABELS))

    def train(self, data: list[tuple[Graph, list[int]]], epochs: int = 4) -> None:
        """Pseudo-likelihood: each token given its links' labels; AdaGrad steps. Half of the time a token's own features are left out, or
        those around it."""
        gw, gn, gs = (np.full(p.shape, 1e-2) for p in (self.w, self.near, self.skip))
        random = np.random.default_rng(0)
        for _ in range(epochs):
            for i in random.permutation(len(data)):
                g, y = data[i]
                links: list[list[tuple[np.ndarray, np.ndarray, int, bool]]] = [[] for _ in y]
                for table, sums, pairs in ((self.near, gn, g.near), (self.skip, gs, g.skip)):
                    for a, b in pairs:
                        links[a].append((table, sums, y[b], False))
                        links[b].append((table, sums, y[a], True))
                drop = random.random(len(y))
                for k, label in enumerate(y):
                    x = [0, *g.x[k][OWN:]] if drop[k] < 0.25 else g.x[k][:OWN] if drop[k] < 0.5 else g.x[k]
                    s = self.w[x].sum(axis=0)
                    for table, _, other, second in links[k]:
                        s = s + (table[other] if second else table[:, other])
                    p = np.exp(s - s.max())
                    p /= p.sum()
                    p[label] -= 1
                    at = list(set(x))
                    gw[at] += p * p
                    self.w[at] -= 0.3 * p / np.sqrt(gw[at])
                    for table, sums, other, second in links[k]:
                        if second:
                            sums[other] += p * p
                            table[other] -= 0.1 * p / np.sqrt(sums[other])
                        else:
                            sums[:, other] += p * p
                            table[:, other] -= 0.1 * p / np.sqrt(sums[:, other])

    def marginals(self, g: Graph, seen: list[int], steady: float = 1e-4) -> np.ndarray:
        """P(label) of each token by loopy message passing, damped, until no message changes by more than `steady`; at most 20 rounds
        more than three for each token of the longest group. Labels of the patterns' tokens (not 0) are given."""
        n = len(g.x)
        score = np.array([self.w[x].sum(axis=0) for x in g.x])
        for k, label in enumerate(seen):
            if label:
                score[k] = -30
                score[k, label] = 30
        pairs = g.near + g.skip
        if pairs:
            a, b = np.array(pairs).T
            table = np.stack([self.near] * len(g.near) + [self.skip] * len(g.skip))
            to_b, to_a = np.zeros((len(pairs), LABELS)), np.zeros((len(pairs), LABELS))
            for _ in range(20 + 3 * g.longest):
                belief = score.copy()
                np.add.at(belief, b, to_b)
                np.add.at(belief, a, to_a)
                new_b = (belief[a] - to_a)[:, :, None] + table
                new_b = np.logaddexp.reduce(new_b, axis=1)
                new_a = (belief[b] - to_b)[:, None, :] + table
                new_a = np.logaddexp.reduce(new_a, axis=2)
                new_b -= new_b.max(axis=1, keepdims=True)
                new_a -= new_a.max(axis=1, keepdims=True)
                moved = max(np.abs(new_b - to_b).max(), np.abs(new_a - to_a).max())
                to_b, to_a = 0.5 * (to_b + new_b), 0.5 * (to_a + new_a)
                if moved < steady:
                    break
            np.add.at(score, b, to_b)
            np.add.at(score, a, to_a)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True) if n else p

    def added(self, text: str, spans: list[Span], sure: float) -> list[Span]:
        g = Graph(text)
        if not g.x:
            return []
        p = self.marginals(g, g.labels(spans))
        out: list[Span] = []
        touch = _Touch(spans)
        for k, (a, b) in enumerate(g.spans):
            kind = int(p[k].argmax())
            if not kind or p[k, kind] < sure or touch(a, b):
                continue
            whole = text[a:b]
            core = whole.strip(EDGES)
            a += len(whole) - len(whole.lstrip(EDGES)) if core else 0
            b = a + len(core)
            if out and out[-1][0] == kind - 1 and not text[out[-1][2] : a].strip():
                out[-1] = (kind - 1, out[-1][1], b)
            elif core:
                out.append((kind - 1, a, b))
        return out


def shares(sizes: dict[int, int], sample: int) -> dict[int, int]:
    """How many to take of each stratum, at most `sample` in all: half shared evenly, the rest in proportion to what is left."""
    if sum(sizes.values()) <= sample:
        return dict(sizes)
    got: dict[int, int] = {}
    for k in sorted(sizes, key=lambda k: (sizes[k], k)):
        got[k] = min(sizes[k], (sample // 2 - sum(got.values())) // (len(sizes) - len(got)))
    rest, left = sample - sum(got.values()), {k: n - got[k] for k, n in sizes.items()}
    for k in sorted(sizes, key=lambda k: (left[k], k)):
        more = rest * left[k] // max(sum(left.values()), 1)
        got[k], rest, left[k] = got[k] + more, rest - more, 0
    return got


def fit(docs: DataFrame, sample: int = 3000) -> SkipChainCrf | None:
    """Trained in one task on a bounded sample; None without one."""
    import pickle

    def learn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = []
        for _, t in sorted([r for b in it for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], key=lambda r: (r[0] or 0, r[1])):
            g, base = Graph(t), base_spans(t)
            data.append((g, g.labels(base + assigned(t, base))))
        if data:
            crf = SkipChainCrf()
            crf.train(data)
            yield rows_batch(pa.schema([("model", pa.binary())]), [[zlib.compress(pickle.dumps(crf))]])

    schema = pa.schema([("key", pa.int64()), ("kinds", pa.int32())])

    def strata_of(t: str) -> int:
        base = base_spans(t)
        return sum(1 << k for k in {k for k, _, _ in base + assigned(t, base)})

    def kinds(b: pa.RecordBatch) -> pa.RecordBatch:
        return rows_batch(schema, [b.column(0), [strata_of(t.as_py()) for t in b.column(1)]])

    some = texts(docs).where(F.col("text").rlike("[0-9@=\"]")).withColumn("key", F.xxhash64("doc_id", "text"))
    strata = cut(map_batches(some.select("key", "text"), kinds, "key long, kinds int").distinct(), "pii-strata")
    sizes = {r.kinds: r["count"] for r in strata.groupBy("kinds").count().collect()}
    ids = strata.where("false")
    for k, n in sorted(shares(sizes, sample).items()):
        ids = ids.unionByName(strata.where(F.col("kinds") == k).orderBy("key").limit(n))
    some = some.join(F.broadcast(ids.select("key")), "key").select("doc_id", "text").distinct()  # at most `sample` keys
    got = some.repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(zlib.decompress(bytes(got[0].model))) if got else None


def all_spans(text: str, crf: SkipChainCrf | None, sure: float = 0.98) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and all."""
    base = base_spans(text)
    extra = crf.added(text, base, sure) if crf is not None and any([d in text for d in SIGNS]) else []
    return base, sorted(base + extra)


def digests(docs: DataFrame, crf: SkipChainCrf | None, sure: float = 0.98) -> DataFrame:
    """doc_id, the patterns' spans by kind and their digest, and all spans; n_added and n_spans count the field's and all of them."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    names = ["doc_id", *(f"n_{k}" for k in KINDS[:PATTERNS]), "base_sha256", "spans", "n_added", "n_spans"]
    schema = pa.schema([(n, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n in names])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, t in zip(b.column(0).to_pylist(), b.column(1)):
            base, every = all_spans(t.as_py(), shared.value, sure)
            out.append((doc, *[sum(k == i for k, _, _ in base) for i in range(PATTERNS)], hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(every) - len(base), len(every)))
        return rows_batch(schema, list(zip(*out)))

    return map_batches(texts(docs), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones joined, replaced by its kind in angle brackets."""
    out, done = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"<{KINDS[k]}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, crf: SkipChainCrf | None, sure: float = 0.98) -> DataFrame:
    """docs with all spans in text replaced, all other columns as they are."""
    shared, text = docs.sparkSession.sparkContext.broadcast(crf), docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            new = [None if (s := t.as_py()) is None else redacted(s, all_spans(s, shared.value, sure)[1]) for t in b.column(text)]
            yield b.set_column(text, b.schema.field(text), pa.array(new, b.schema.field(text).type))

    return docs.mapInArrow(run, docs.schema)
