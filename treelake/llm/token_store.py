"""Token ids in files: each document compressed for itself with one shared zstandard dictionary.

A file holds documents of a range of ids in ascending order:
magic, u32 length of the header, header (JSON: id width, dictionary hash), compressed documents, index, u64 place of the index,
u32 number of documents, magic. The index has the arrays i64 doc_id, u8 doc_id known, u64 offset, u32 bytes, u64 ids. The
dictionary lies beside the files under its hash, and a reader refuses another.

Defined cases: a null or empty text is its end id alone; null ids come first; rows with equal ids lie in an order by hash of their
texts, over as many files as they fill; an empty table has no file; other columns are ignored. The dictionary is trained on at most
`sample` documents of at most SHORT characters (which only compression depends on); with too few to train on there is none.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.llm.bpe_words import tokenizer
from treelake.llm.common import cut, local_path, rows_batch, scratch, texts

MAGIC = b"TLTOKEN1"
MANIFEST = pa.schema([("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("part", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


SHORT = 20_000


def serialize(ids: bytes, width: int) -> bytes:
    """Ids of 32 bits as an array of 16 or 32."""
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids


def train(samples: list[bytes], size: int = 65536) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


class Writer:
    def __init__(self, path: str, width: int, dictionary: bytes, level: int = 3):
        self.path, self.width = path, width
        self.tmp = f"{path}.{os.getpid()}.tmp"
        self.file = open(self.tmp, "wb")
        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.zstd = zstandard.ZstdCompressor(level=level, dict_data=d)
        header = json.dumps({"width": width, "dictionary": hashlib.sha256(dictionary).hexdigest()}).encode()
        self.file.write(MAGIC + struct.pack("<I", len(header)) + header)
        self.at = len(MAGIC) + 4 + len(header)
        self.index: list[tuple[int, int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        c = self.zstd.compress(serialize(ids, self.width))
        self.file.write(c)
        self.index.append((doc_id or 0, doc_id is not None, self.at, len(c), len(ids) // 4))
        self.at += len(c)

    def close(self) -> int:
        """Number of ids; the file appears under its name only now."""
        cols = list(zip(*self.index)) if self.index else [()] * 5
        for c, kind in zip(cols, ("<i8", "u1", "<u8", "<u4", "<u8")):
            self.file.write(np.array(c, kind).tobytes())
        self.file.write(struct.pack("<QI", self.at, len(self.index)) + MAGIC)
        self.file.close()
        os.replace(self.tmp, self.path)
        return sum(cols[4])


class Reader:
    """Documents of one file, by position, or by id through the index without reading the rest."""

    def __init__(self, path: str):
        self.file = open(path, "rb")
        if self.file.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no token file")
        header = json.loads(self.file.read(struct.unpack("<I", self.file.read(4))[0]))
        self.width = header["width"]
        dictionary = b""
        if header["dictionary"] != hashlib.sha256(b"").hexdigest():
            with open(os.path.join(os.path.dirname(path), header["dictionary"] + ".dict"), "rb") as f:
                dictionary = f.read()
            if hashlib.sha256(dictionary).hexdigest() != header["dictionary"]:
                raise ValueError(f"{path}: another dictionary")
        self.zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        self.file.seek(-12 - len(MAGIC), 2)
        at, n = struct.unpack("<QI", self.file.read(12))
        if self.file.read() != MAGIC:
            raise ValueError(f"{path} isn't whole")
        self.file.seek(at)
        self.doc_ids, self.known, self.offsets, self.sizes, self.counts = (np.frombuffer(self.file.read(n * np.dtype(k).itemsize), k) for k in ("<i8", "u1", "<u8", "<u4", "<u8"))

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, k: int) -> np.ndarray:
        """Unsigned 32-bit ids of the document at position k."""
        self.file.seek(int(self.offsets[k]))
        raw = self.zstd.decompress(self.file.read(int(self.sizes[k])))
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def find(self, doc_id: int) -> np.ndarray | None:
        nulls = int((self.known == 0).sum())  # these come first
        k = nulls + int(np.searchsorted(self.doc_ids[nulls:], doc_id))
        return self.ids(k) if k < len(self) and self.doc_ids[k] == doc_id else None


def write(df: DataFrame, tokenizer_file: str, folder: str, end_id: int = 2, sample: int = 500) -> DataFrame:
    """Writes the files; a row for each, with its numbers of documents and ids, in parts ascending by doc_id."""
    from treelake.llm.bpe_words import tokenizer as load

    docs, at = texts(df), local_path(folder)
    os.makedirs(at, exist_ok=True)
    tok = load(tokenizer_file)
    width, end = 2 if max(tok.size, end_id + 1) <= 65536 else 4, end_id.to_bytes(4, "little")
    some = [r.text for r in docs.where((F.xxhash64("doc_id") % 8 == 0) & (F.length("text") <= SHORT)).select("text").limit(sample).collect()]
    dictionary = train([serialize(ids + end, width) for ids in tok.encode(some)])
    name = hashlib.sha256(dictionary).hexdigest()
    if dictionary:
        with open(f"{at}/{name}.dict", "wb") as f:
            f.write(dictionary)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, out, n = tokenizer(tokenizer_file), TaskContext.get().partitionId(), None, 0
        for b in it:
            if not b.num_rows:
                continue
            if out is None:
                path = f"{at}/part-{part:07d}.tok"
                shared = b""
                if dictionary_size:
                    with open(f"{at}/{name}.dict", "rb") as f:
                        shared = f.read()
                out = Writer(path, width, shared)
            for doc, ids in zip(b.column(0).to_pylist(), tok.encode(b.column(1).to_pylist())):
                out.add(doc, ids + end)
                n += 1
        if out is not None:
            tokens = out.close()
            yield rows_batch(MANIFEST, [[path], [n], [tokens], [part]])

    dictionary_size = len(dictionary)
    # equal rows of many partitions needn't meet in one
    ordered = docs.withColumns({"_hash": F.xxhash64("text"), "_from": F.spark_partition_id()}).repartitionByRange("doc_id", "_hash", "_from")
    ordered = ordered.sortWithinPartitions("doc_id", "_hash", "text").select("doc_id", "text")
    return cut(ordered.mapInArrow(run, "file string, docs long, tokens long, part long"), "token-manifest")


def read_back(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start among all ids, n_tokens and ids_crc32, read from the files. The manifest has one row a file."""
    files, start = [], 0
    for r in manifest.orderBy("part").collect():
        files.append((r.file, start))
        start += r.tokens

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = Reader(path)
                starts = at + np.concatenate([[0], np.cumsum(r.counts.astype(np.int64))])
                crc = [zlib.crc32(r.ids(k).tobytes()) for k in range(len(r))]
                ids = pa.array(r.doc_ids.astype(np.int64), mask=r.known == 0)
                yield rows_batch(READ, [ids, starts[:-1], r.counts.astype(np.int64), crc])

    table = spark.createDataFrame(files, "file string, start long")
    return table.repartition(max(1, len(files)), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_and_read(df: DataFrame, tokenizer_file: str, end_id: int = 2) -> DataFrame:
    spark = df.sparkSession
    return read_back(spark, write(df, tokenizer_file, scratch(spark, "token-files"), end_id))
