"""SentencePiece BPE encoding and decoding by a prefix table.

In merge-type encodings each prefix of a text has one last token. The table is filled from left to right: an Aho-Corasick
automaton gives the pieces that end at a position, and the one that is compatible with the last token of the prefix before it is
the last token of this prefix. Ids are then recovered from the end backwards. Two tokens are compatible if encoding their joined
text gives them back, which is decided by walking down their merge trees.

No piece has a space mark after another character, so texts are cut into segments `mark* other*`, each encoded once a cache.
Runs of two or more marks, whose pieces all have one score, are encoded by the plain agenda (lowest score first, leftmost of equals).

Defined cases: a null or empty text has the end id alone and decodes to the empty text; U+2581 in a text decodes to a space, as
in the library; characters outside the vocabulary become byte pieces; other columns of the input are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from treelake.llm.common import map_batches, rows_batch, texts

MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
RUNS = re.compile(r"\w+|\W+")
NEVER = 1 << 30
#: Segments kept by a worker before its cache is emptied; longer ones aren't kept. Only speed depends on these.
CACHE, CACHED_LENGTH = 400_000, 48
#: Characters of text that are looked up at once.
CHUNK = 3_000_000


class PrefixTableCodec:
    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.eos = sp.eos_id()
        self.ids: dict[str, int] = {}
        self.byte_id = [0] * 256
        self.text: list[str] = [""] * n
        self.byte_of: dict[int, int] = {}
        score = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.byte_of[i] = int(piece[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], score[i], self.text[i] = i, sp.get_score(i), piece.replace(MARK, " ")
        self.score = score
        order = sorted({-s for s in score.values()})
        place = {s: k for k, s in enumerate(order)}
        #: Place in the order of merging; single characters come before all.
        self.rank = {i: place[-s] for i, s in score.items()}
        self.split: dict[int, tuple[int, int]] = {}
        self.trie, end = [{}], {}
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.rank[i] = -1
            elif set(piece) == {MARK}:
                continue
            else:
                parts, last = self._agenda(piece)
                if len(parts) != 1:
                    continue  # the agenda never makes this piece
                self.split[i] = last
            at = 0
            for c in piece:
                if c not in self.trie[at]:
                    self.trie[at][c] = len(self.trie)
                    self.trie.append({})
                at = self.trie[at][c]
            end[at] = (len(piece), i)
        #: Aho-Corasick: fail links, and for each state the pieces that end there, longest first.
        self.fail, self.matches = [0] * len(self.trie), [()] * len(self.trie)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            for c, to in self.trie[at].items():
                f = self.fail[at]
                while at and c not in self.trie[f] and f:
                    f = self.fail[f]
                self.fail[to] = self.trie[f].get(c, 0) if at else 0
                self.matches[to] = ((end[to],) if to in end else ()) + self.matches[self.fail[to]]
                queue.append(to)
        self.goto: list[dict[str, int]] = [{} for _ in self.trie]
        self.length = [len(t) for t in self.text]
        self.chars = frozenset(p for p in self.ids if len(p) == 1)
        self.pairs: dict[int, bool] = {}
        #: Of segments after one mark, and of parts without.
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.bare: dict[str, tuple[int, str, str]] = {}
        self.beside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}

    def _agenda(self, text: str) -> tuple[list[int], tuple[int, int]]:
        """Merges neighbours, best score first and leftmost of equals; the ids (-1: unknown character) and the last merge."""
        ids, score = self.ids, self.score
        sym, prev, nxt = list(text), list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        end, heap, last = len(sym), [], (-1, -1)

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < end and (i := ids.get(sym[a] + sym[b])) is not None:
                heapq.heappush(heap, (-score[i], a, b, sym[a] + sym[b], i))

        for k in range(end - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, both, i = heapq.heappop(heap)
            if not sym[a] or nxt[a] != b or not sym[b] or sym[a] + sym[b] != both:
                continue
            last = (ids.get(sym[a], -1), ids.get(sym[b], -1))
            sym[a], sym[b] = both, ""
            nxt[a] = nxt[b]
            if nxt[a] < end:
                prev[nxt[a]] = a
            offer(prev[a], a)
            offer(a, nxt[a])
        return [ids.get(s, -1) for s in sym if s], last

    def compatible(self, a: int, b: int) -> bool:
        """Whether encoding the joined text of two pieces gives the two pieces: no merge across the border comes up in time."""
        key = a << 20 | b
        if (known := self.pairs.get(key)) is not None:
            return known
        rank, split, ids, text = self.rank, self.split, self.ids, self.text
        limit, ok = NEVER, True
        x, y = a, b
        while True:
            both = ids.get((text[x] + text[y]).replace(" ", MARK))
            if both is not None and rank[both] < limit:
                ok = False
                break
            rx, ry = rank[x], rank[y]
            if rx < 0 and ry < 0:
                break
            if rx > ry:  # the later merge is undone first; of equals the right one came later
                limit, x = rx, split[x][1]
            else:
                limit, y = ry + 1, split[y][0]
        if len(self.pairs) > 400_000:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def _step(self, state: int, c: str) -> int:
        """The automaton's next state, kept in its table once known."""
        at = state
        while c not in self.trie[at] and at:
            at = self.fail[at]
        to = self.trie[at].get(c, 0)
        self.goto[state][c] = to
        return to

    def _known(self, seg: str) -> list[int]:
        """Ids of a segment whose characters are all pieces, by the prefix table."""
        return next(self._known_sorted([seg]))

    def _known_sorted(self, segs: list[str]) -> Iterator[list[int]]:
        """The same of many; the table's rows of a prefix shared with the segment before are kept, so sorted segments are fastest."""
        pairs, goto, matches, lengths = self.pairs, self.goto, self.matches, self.length
        before, last, states = "", [0], [0]
        for seg in segs:
            n, same = len(seg), 0
            for x, y in zip(before, seg):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], states[same + 1 :]
            before, end, state = seg, same, states[same]
            for c in seg[same:] if same else seg:
                end += 1
                to = goto[state].get(c)
                state = self._step(state, c) if to is None else to
                for length, i in matches[state]:
                    if length == end:
                        break
                    left = last[end - length]
                    ok = pairs.get(left << 20 | i)
                    if ok or (ok is None and self.compatible(left, i)):
                        break
                last.append(i)
                states.append(state)
            out = []
            while n:
                i = last[n]
                out.append(i)
                n -= lengths[i]
            out.reverse()
            yield out

    def segment(self, seg: str) -> list[int]:
        ids = self.ids
        if seg.startswith(MARK * 2):
            out, _ = self._agenda(seg)
            if -1 not in out:
                return out
            out = []
            body = seg.lstrip(MARK)
            k = 0
            while k < len(body) and body[k] in ids:
                k += 1
            head, _ = self._agenda(seg[: len(seg) - len(body) + k])
            return head + (self.segment(body[k:]) if k < len(body) else [])
        if self.chars.issuperset(seg):
            return self._known(seg)
        out, run = [], []
        for c in seg:
            if c in ids:
                run.append(c)
            else:
                if run:
                    out += self._known("".join(run))
                    run = []
                out += [self.byte_id[x] for x in c.encode("utf-8")]
        return out + (self._known("".join(run)) if run else [])

    def encode(self, text: str) -> list[int]:
        """All ids without an end id."""
        if not text:
            return []
        return [i for s in SEGMENT.findall(MARK + text.replace(" ", MARK)) for i in self.segment(s)]

    def _decode(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.text[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; ids of no text, such as the end id, are dropped. Byte pieces must make up whole characters, as encode gives them."""
        s = self._decode(ids)
        return s[1:] if s.startswith(" ") else s

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text the number of ids with the end id, their decimal text, and the decoded text. Each segment goes through
        encode and decode once a cache."""
        if len(self.cache) + len(self.bare) > CACHE:
            self.cache.clear()
            self.bare.clear()
        cut = [self._keys(t) for t in texts]
        cache = self.cache
        values = [list(map(cache.get, k)) for k in cut]
        missing = {s for k, v in zip(cut, values) if None in v for s, x in zip(k, v) if x is None}
        extra = self._learn(missing) if missing else {}
        out = []
        for keys, vals in zip(cut, values):
            if None in vals:
                vals = [extra[s] if x is None else x for s, x in zip(keys, vals)]
            if vals:
                n, words, back = zip(*vals)
                out.append((sum(n) + 1, " ".join(words) + f" {self.eos}", "".join(back)[1:]))
            else:
                out.append((1, str(self.eos), ""))
        return out

    def _keys(self, text: str) -> list[str]:
        """Segments; one mark before a word is left out, and a line's first word has the line's end before it."""
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " " or "\n" in self.ids:
            return [s[1:] if s[1:2] not in ("", MARK, "\n") else s for s in SEGMENT.findall(MARK + text.replace(" ", MARK))]
        lines = text.split("\n")
        keys = lines[0].split(" ")
        for line in lines[1:]:
            words = line.split(" ")
            words[0] = "\n" + words[0]
            keys += words
        return keys

    def _value(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join(map(str, ids)), self._decode(ids)

    def _learn(self, missing: set[str]) -> dict[str, tuple[int, str, str]]:
        """Encodes and decodes new segments, and keeps the short ones. They are cut where no piece has the two characters side by side."""
        cache, bare, never, known = self.cache, self.bare, self.beside, self.chars
        whole, cut, out = [], [], {}
        for s in missing:
            if not s or s[0] in (MARK, "\n") or not known.issuperset(s):
                v = self._value(self.segment(s if s and s[0] in (MARK, "\n") else MARK + s))
                out[s] = v
                if len(s) <= CACHED_LENGTH:
                    cache[s] = v
            elif s.isalnum():
                whole.append(s)
            else:
                runs = RUNS.findall(s)
                parts = [runs[0]]
                for b in runs[1:]:
                    if parts[-1][-1] + b[0] in never:
                        parts[-1] += b
                    else:
                        parts.append(b)
                if len(parts) == 1:
                    whole.append(s)
                else:
                    cut.append((s, parts))
        whole.sort()
        fresh: dict[str, tuple[int, str, str]] = {}
        text = self.text
        for s, ids in zip(whole, self._known_sorted([MARK + s for s in whole])):
            out[s] = v = (len(ids), " ".join(map(str, ids)), "".join([text[i] for i in ids]))
            if len(s) <= CACHED_LENGTH:
                cache[s] = v
        heads = sorted({p[0] for _, p in cut if p[0] not in cache and p[0] not in out})
        for s, ids in zip(heads, self._known_sorted([MARK + s for s in heads])):
            fresh[s] = v = (len(ids), " ".join(map(str, ids)), "".join([text[i] for i in ids]))
            if len(s) <= CACHED_LENGTH:
                cache[s] = v
        tails = sorted({r for _, p in cut for r in p[1:] if r not in bare})
        for s, ids in zip(tails, self._known_sorted(tails)):
            bare[s] = (len(ids), " ".join(map(str, ids)), "".join([text[i] for i in ids]))
        for s, parts in cut:
            h = parts[0]
            n, words, back = cache.get(h) or out.get(h) or fresh[h]
            for r in parts[1:]:
                x = bare[r]
                n, words, back = n + x[0], words + " " + x[1], back + x[2]
            out[s] = v = (n, words, back)
            if len(s) <= CACHED_LENGTH:
                cache[s] = v
        return out


CODECS: dict[str, PrefixTableCodec] = {}


def codec(model_file: str) -> PrefixTableCodec:
    if model_file not in CODECS:
        CODECS[model_file] = PrefixTableCodec(model_file)
        gc.freeze()  # the tables are full of containers that the collector needn't visit
        gc.set_threshold(200_000, 50, 100)
    return CODECS[model_file]


def encode_column(df: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids (array of int, end id last) and decoded text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(model_file)
        ids = [c.encode(t) + [c.eos] for t in b.column(1).to_pylist()]
        return rows_batch(schema, [b.column(0), ids, [c.decode(x) for x in ids]])

    return map_batches(texts(df), run, "doc_id long, ids array<int>, decoded string")


def digests(df: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(model_file)
        n, x, y, chunk, size = [], [], [], [], 0
        for k, t in enumerate(b.column(1)):
            chunk.append(t.as_py())
            size += len(chunk[-1])
            if size > CHUNK or k + 1 == b.num_rows:
                for tokens, ids, back in c.digests(chunk):
                    n.append(tokens)
                    x.append(hashlib.sha256(ids.encode()).hexdigest())
                    y.append(hashlib.sha256(back.encode()).hexdigest())
                chunk, size = [], 0
        return rows_batch(schema, [b.column(0), n, x, y])

    return map_batches(texts(df), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
