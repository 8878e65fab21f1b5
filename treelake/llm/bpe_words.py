"""Byte-level BPE ids by the tokenizers library, words at a time.

A single space or line end between two other characters always begins a new pre-token, so texts whose white space is like that
are cut there and each distinct word goes through the library once a cache; all other texts go through it whole. Words of one or two
pre-tokens may take a leaner encoder of single pre-tokens, made from the same vocabulary.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array

import numpy as np

#: White space other than single spaces and line ends, or what might be a special token.
UNEVEN = ["  ", " \n", "\n ", "\n\n", "<|", "\0", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B))]
#: Letters, perhaps after a space, and ASCII punctuation: each is one pre-token.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
PLAIN = re.compile(f"( ?[{LETTERS}]+)([!-/:-@\\[-`{{-~]*)").fullmatch
#: Words kept by a worker before its cache is emptied; longer ones aren't kept. Only speed depends on these.
CACHE, CACHED_LENGTH, CHUNK = 500_000, 48, 3_000_000


class Words(dict):
    """Ids of words; a new word's are made when it is asked for. Of letters and punctuation after them both parts are pre-tokens."""

    def __init__(self, piece, ids):
        super().__init__({"": b""})
        self.piece, self.ids = piece, ids
        self.marks: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        m = PLAIN(word) if self.piece else None
        if m is None:
            out = self.ids([word])[0]
        else:
            a, b = m.groups()
            if b:
                if (y := self.marks.get(b)) is None:
                    y = array("I", self.piece(b.encode())).tobytes()
                    if len(b) <= CACHED_LENGTH and len(self.marks) < CACHE:
                        self.marks[b] = y
                out = self[a] + y
            else:
                out = array("I", self.piece(a.encode())).tobytes()
        if len(word) <= CACHED_LENGTH:
            self[word] = out
        return out


class WordTokenizer:
    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.size = self.tokenizer.get_vocab_size()
        self.cache = Words(self._pieces(file), self._ids)

    def _pieces(self, file: str):
        """A faster encoder of one pre-token, from the same file, where the file has plain byte-level BPE whose ids are in the order
        of its merges; None elsewhere."""
        try:
            import tiktoken
        except ImportError:
            return None
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or pre.get("use_regex") is False or model.get("dropout") or model.get("ignore_merges"):
            return None
        shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
        byte = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged) or len(merged) + 256 != len(vocab):
            return None
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items()}
        return tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        chunk, size = [], 0
        for k, t in enumerate(texts):
            chunk.append(k)
            size += len(t)
            if size > CHUNK or k + 1 == len(texts):
                self._chunk(texts, chunk, out)
                chunk, size = [], 0
        return out

    def _chunk(self, texts: list[str], chosen: list[int], out: list[bytes]) -> None:
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
            cache[""] = b""
        whole = [k for k in chosen if any([x in texts[k] for x in UNEVEN])]
        if whole:
            for k, ids in zip(whole, self._ids([texts[k] for k in whole])):
                out[k] = ids
            chosen = sorted({*chosen} - {*whole})
        get = cache.__getitem__
        for k in chosen:
            out[k] = b"".join(map(get, texts[k].replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")))


TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(file: str) -> WordTokenizer:
    if file not in TOKENIZERS:
        TOKENIZERS[file] = WordTokenizer(file)
        gc.freeze()
        gc.set_threshold(200_000, 50, 100)
    return TOKENIZERS[file]
