"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone, so that the scan reads two columns; a null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with one output batch for each non-empty input batch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows and (out := fn(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken, name = {c.lower() for c in df.columns}, "_" + name
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Gives memory that isn't used any more back to the system; a worker lives on and would keep what its largest task had."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def rows_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def held_out(doc_id: Column) -> Column:
    """Rows that no model here learns labels from: crc32 of the id's decimal text is 2 modulo 4. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a folder of this machine for local runs; an error
    on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file:///tmp/treelake-shared"
    return at.rstrip("/")


SCRATCH: list[str] = []


def scratch(spark: SparkSession, what: str) -> str:
    SCRATCH.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return SCRATCH[-1]


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this driver wrote to the shared folder. Results that aren't written elsewhere yet can't be read afterwards."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(SCRATCH.pop())
        path.getFileSystem(conf).delete(path, True)


def cut(df: DataFrame, what: str) -> DataFrame:
    """The same rows from a table written to the shared folder: lineage ends there, and lost executors don't matter."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str:
    """The mounted path of a shared file: URI."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"the shared folder must be mounted on all executors, not {uri}")
    return os.path.abspath(uri)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, y and text of at most per_class documents of each class, none of them held out, the first by hash of the id; and the number
    of labelled documents of each class. Ids with two labels, none, or no document aren't used; of rows with one id only the smallest
    text is, so per_class bounds rows, too."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("y"), F.max(label).alias("_top"))
    known = known.where((F.col("y") == F.col("_top")) & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("y").cast("int").alias("y"))
    known = cut(known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi"), "labelled-ids")
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    ids = known.where("false")
    for y in (0, 1):
        ids = ids.unionByName(known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class))
    found = texts(docs).join(F.broadcast(ids), "doc_id")  # at most 2 * per_class ids
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y"), sizes
