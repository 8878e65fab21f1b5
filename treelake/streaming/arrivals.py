"""Streams: packs as they arrive in a folder, and packet lines by connection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from treelake.functions.pktline import Decoder
from treelake.sources.pack import read_pack


def arriving_packs(spark: SparkSession, folder: str, table_path: str, checkpoint: str) -> StreamingQuery:
    """Appends the objects of each new pack to a Parquet table, each object once. A batch that is done again after a failure adds nothing."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.pack").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def run(it):
        for pdf in it:
            rows = [(o.type, o.sha, len(o.content), o.content) for raw in pdf["content"] for o in read_pack(bytes(raw))]
            yield pd.DataFrame(rows, columns=["type", "sha", "size", "content"])

    def add(batch: DataFrame, number: int) -> None:
        new = batch.select("content").mapInPandas(run, "type string, sha string, size long, content binary").dropDuplicates(["sha"])
        try:
            new = new.join(spark.read.parquet(table_path).select("sha"), "sha", "left_anti").select("type", "sha", "size", "content")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").parquet(table_path)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PACKETS = "connection string, seq long, kind string, payload binary"


def packets(portions: DataFrame, timeout_ms: int = 60_000) -> DataFrame:
    """connection, seq, kind, payload of streamed bytes (connection, seq, data). What isn't complete waits in state; a connection that is
    silent for too long while bytes wait gives a row of kind truncated."""

    def run(key, batches, state: GroupState):
        rest, count = state.get if state.exists else (b"", 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], count, "truncated", bytes(rest))] if rest else [], columns=["connection", "seq", "kind", "payload"])
            return
        pdf = pd.concat(list(batches)).sort_values("seq")
        d, rows = Decoder(bytes(rest)), []
        for data in pdf["data"]:
            for kind, payload in d.feed(bytes(data)):
                rows.append((key[0], count, kind, payload))
                count += 1
        state.update((d.rest, count))
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(rows, columns=["connection", "seq", "kind", "payload"])

    return portions.select(F.col("connection").cast("string"), "seq", "data").groupBy("connection").applyInPandasWithState(run, PACKETS, "rest binary, count long", "append", GroupStateTimeout.ProcessingTimeTimeout)
