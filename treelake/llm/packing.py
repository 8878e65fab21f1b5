"""Bounded-space online packing of token ids into windows.

Each partition keeps at most `open_windows` unfinished windows. A document's ids, with an end id, are cut into whole windows and a
rest; the rest goes into the open window that it fills best, and when it fits into none, the fullest is emitted and a new one
opened. What is still open when partitions end is packed again, largest piece first, in groups of `merge_partitions` partitions.

Defined cases: a null or empty text is its end id alone; repeated rows are packed each for itself; equal fits take the window
opened first; an empty table has no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelake.llm.bpe_words import tokenizer
from treelake.llm.common import cut, rows_batch, texts

OUT = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
STAGE = pa.schema([(c, pa.int64()) for c in OUT] + [("part", pa.int64()), ("open", pa.bool_())])


class Packer:
    """Windows of one partition. place() gives the window's number and the offset there; closed windows take no more."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.count = size, most, 0
        self.room: list[tuple[int, int]] = []  # (free, window), sorted

    def new(self) -> int:
        self.count += 1
        return self.count - 1

    def place(self, n: int) -> tuple[int, int]:
        if n >= self.size:
            return self.new(), 0
        k = bisect_left(self.room, (n, -1))
        if k < len(self.room):
            free, w = self.room.pop(k)
        else:
            if len(self.room) >= self.most:
                self.room.pop(0)  # the fullest is emitted
            free, w = self.size, self.new()
        if free > n:
            insort(self.room, (free - n, w))
        return w, self.size - free

    def open(self) -> set[int]:
        return {w for _, w in self.room}


def pack(df: DataFrame, tokenizer_file: str, size: int = 1024, end_id: int = 0, open_windows: int = 64, merge_partitions: int = 64) -> DataFrame:
    """A row a piece: its document and place there, crc32 of its ids, its window and place there."""
    end = end_id.to_bytes(4, "little")

    def stage(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, packer, part = tokenizer(tokenizer_file), Packer(size, open_windows), TaskContext.get().partitionId()
        waiting: list[tuple] = []  # pieces in windows that may be open
        for b in it:
            ready: list[tuple] = waiting
            for doc, ids in zip(b.column(0).to_pylist(), tok.encode(b.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, size):
                    piece = ids[4 * at : 4 * (at + size)]
                    w, offset = packer.place(len(piece) // 4)
                    ready.append((doc, at, len(piece) // 4, zlib.crc32(piece), n, part << 32 | w, offset, part, False))
            still = {part << 32 | w for w in packer.open()}
            waiting = [r for r in ready if r[5] in still]
            if out := [r for r in ready if r[5] not in still]:
                yield rows_batch(STAGE, list(zip(*out)))
        if waiting:
            yield rows_batch(STAGE, list(zip(*[r[:8] + (True,) for r in waiting])))

    staged = cut(texts(df).mapInArrow(stage, SCHEMA + ", part long, open boolean"), "packing")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "sequence_id", "offset"], ascending=[False, True, True, True, True], ignore_index=True)
        packer, group = Packer(size, len(pdf)), int(pdf["part"].iloc[0]) // merge_partitions
        placed = [packer.place(int(n)) for n in pdf["length"]]
        pdf["sequence_id"] = [1 << 62 | group << 36 | w for w, _ in placed]
        pdf["offset"] = [o for _, o in placed]
        return pdf[list(OUT)]

    left = staged.where("open").groupBy(F.floor(F.col("part") / merge_partitions)).applyInPandas(merge, SCHEMA)
    return staged.where("not open").select(*OUT).unionByName(left)
