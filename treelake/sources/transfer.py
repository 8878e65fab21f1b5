"""Copying between repositories in directories and tables: filters, cloning, fetching what is new, pushing."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.functions.objects import TreelakeError, decode_commit, decode_tag, decode_tree
from treelake.operators.graph import object_edges, reachable, shared_table
from treelake.operators.reports import traced
from treelake.sources.pack import write_packs
from treelake.sources.repository import commits, delete_ref, init, objects, read_refs, refs, tags, tree_entries, write_ref

PACK_BYTES = 256 << 20  # contents of a pack that is pushed, about; a task holds them
UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}


def filter_spec(spec: str | tuple) -> str:
    """The text of a partial-copy filter: "blob:none", ("blob:limit", n or "10k"), ("tree", depth), or any text as it is."""
    if isinstance(spec, str):
        return spec
    kind, value = spec
    if kind not in ("blob:limit", "tree") or (kind == "tree" and int(value) < 0):
        raise TreelakeError("invalid_filter", spec=spec)
    return f"{kind}:{value}"


def passes(spec: str) -> Column:
    """The filter as a predicate over objects (type, size), so that it reaches the scan."""
    if spec == "blob:none":
        return F.col("type") != "blob"
    if spec.startswith("tree:"):
        raise TreelakeError("filter_needs_trees", spec=spec)  # clone and filtered know the trees
    if m := re.fullmatch(r"blob:limit=?:?(\d+)([kmg]?)", spec.replace("limit=", "limit:")):
        return (F.col("type") != "blob") | (F.col("size") < int(m[1]) * UNITS[m[2]])
    raise TreelakeError("unknown_filter", spec=spec)


def edges_of(objs: DataFrame) -> DataFrame:
    return object_edges(commits(objs), tree_entries(objs), tags(objs))


def at_depth(objs: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """ids of trees and blobs less than `depth` steps below the root trees (roots: id)."""
    e = tree_entries(objs).select(F.col("tree").alias("src"), F.col("sha").alias("dst"))
    out = level = roots.where("false") if depth == 0 else roots
    for _ in range(depth - 1):
        level = e.join(level, F.col("src") == F.col("id")).select(F.col("dst").alias("id")).distinct()
        out = out.unionByName(level)
    return out.distinct()


def filtered(objs: DataFrame, spec: str) -> DataFrame:
    """Objects that a filter passes. tree:D keeps commits and tags, and trees and contents less than D steps below the commits' trees."""
    if m := re.fullmatch(r"tree:(\d+)", spec):
        near = at_depth(objs, commits(objs).select(F.col("tree").alias("id")).distinct(), int(m[1]))
        rest = objs.where("type in ('tree', 'blob')").join(near.select(F.col("id").alias("sha")), "sha", "left_semi")
        return objs.where("type in ('commit', 'tag')").unionByName(rest)
    return objs.where(passes(spec))


PROMISE = "source string, objects long"


@traced("transfer.clone")
def clone(spark: SparkSession, source: str, folder: str, spec: str | None = None, lazy: bool = False) -> None:
    """Objects that references reach, and the references, as Parquet in a folder; objects are sorted by id, so that lookups skip row groups.
    With a filter, or lazily (references alone), the folder remembers where the other objects are."""
    if lazy:
        refs(spark, source).write.mode("overwrite").parquet(f"{folder}/refs")
        objects(spark, source).where("false").write.mode("overwrite").parquet(f"{folder}/objects")
        spark.createDataFrame([(source, 0)], PROMISE).coalesce(1).write.mode("overwrite").json(f"{folder}/promise")
        return
    objs, found = objects(spark, source), refs(spark, source)
    wanted = reachable(edges_of(objs), found.where("sha is not null").select(F.col("sha").alias("id")))
    kept = objs.join(wanted.select(F.col("id").alias("sha")), "sha", "left_semi")
    if spec is not None:
        kept = filtered(kept, spec)
        spark.createDataFrame([(source, 0)], PROMISE).coalesce(1).write.mode("overwrite").json(f"{folder}/promise")
    kept.repartitionByRange("sha").sortWithinPartitions("sha").write.mode("overwrite").parquet(f"{folder}/objects")
    found.write.mode("overwrite").parquet(f"{folder}/refs")


def promised(spark: SparkSession, folder: str) -> DataFrame:
    """All objects of a lazy or filtered clone: those in the folder, and the others where they are, which aren't read until they are asked
    for and aren't kept; see ensure."""
    here = spark.read.parquet(f"{folder}/objects")
    there = objects(spark, spark.read.schema(PROMISE).json(f"{folder}/promise").first().source)
    return here.unionByName(there.join(here.select("sha"), "sha", "left_anti"))


def missing(spark: SparkSession, folder: str, ids: DataFrame) -> DataFrame:
    """Those of the ids (sha) that the folder lacks."""
    return ids.select("sha").distinct().join(spark.read.parquet(f"{folder}/objects").select("sha"), "sha", "left_anti")


def ensure(spark: SparkSession, folder: str, ids: DataFrame) -> int:
    """Keeps those of the ids (sha) that the folder lacks; how many these were."""
    there = objects(spark, spark.read.schema(PROMISE).json(f"{folder}/promise").first().source)
    new = shared_table(there.join(missing(spark, folder, ids), "sha", "left_semi"))
    new.write.mode("append").parquet(f"{folder}/objects")
    return new.count()


@traced("transfer.fetch")
def fetch(spark: SparkSession, source: str, folder: str, remote: str = "origin") -> int:
    """Appends objects that the tables don't have, and replaces the remote's references; the number of new objects."""
    objs, found = objects(spark, source), refs(spark, source).where("sha is not null")
    have = spark.read.parquet(f"{folder}/objects").select("sha")
    wanted = reachable(edges_of(objs), found.select(F.col("sha").alias("id")))
    new = objs.join(wanted.select(F.col("id").alias("sha")), "sha", "left_semi").join(have, "sha", "left_anti").persist()
    n = new.count()
    new.write.mode("append").parquet(f"{folder}/objects")
    new.unpersist()
    branch = F.col("name").startswith("refs/heads/")
    name = F.when(branch, F.concat(F.lit(f"refs/remotes/{remote}/"), F.substring("name", len("refs/heads/") + 1, 1 << 20))).otherwise(F.col("name"))
    theirs = found.where(branch | F.col("name").startswith("refs/tags/")).withColumn("name", name)
    ours = spark.read.parquet(f"{folder}/refs")
    ours.join(theirs.select("name"), "name", "left_anti").unionByName(theirs).write.mode("overwrite").parquet(f"{folder}/refs-next")
    _replace(spark, f"{folder}/refs-next", f"{folder}/refs")
    return n


def _replace(spark: SparkSession, new: str, old: str) -> None:
    """Puts a written table in the place of another, which lies beside it as -last until the new one is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(old).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path(old + "-last"), True)
    fs.rename(path(old), path(old + "-last"))
    fs.rename(path(new), path(old))
    fs.delete(path(old + "-last"), True)
    spark.catalog.refreshByPath(old)


@traced("transfer.push")
def push(spark: SparkSession, source: str, target: str, refspecs: list[str]) -> dict[str, str]:
    """Sends what the target lacks as packs, then sets its references by compare and swap. A refspec is name, from:to, or :name to delete.
    The result of each reference by name."""
    ours, out = {n: s for n, _, s, _ in read_refs(source)}, {}
    if not os.path.isdir(os.path.join(target, "objects")):
        init(target)
    theirs = {n: s for n, _, s, _ in read_refs(target)}
    plan = []
    for r in refspecs:
        a, _, b = r.partition(":")
        b = b or a
        if a and ours.get(a) is None:
            out[b] = "not_found"
        else:
            plan.append((ours[a] if a else None, b))
    wants = [(s,) for s, _ in plan if s]
    if wants:
        objs = objects(spark, source)
        e = edges_of(objs)
        send = reachable(e, spark.createDataFrame(wants, "id string"))
        known = [(s,) for s in theirs.values() if s]
        if known:
            send = send.join(reachable(e, spark.createDataFrame(known, "id string")), "id", "left_anti")
        new = objs.join(send.select(F.col("id").alias("sha")), "sha", "left_semi")
        size = new.agg(F.sum("size")).first()[0] or 0
        write_packs(new, os.path.join(target, "objects", "pack"), size // PACK_BYTES + 1)
    for sha, name in plan:
        try:
            if sha is None:
                delete_ref(target, name)
            else:
                write_ref(target, name, sha, expected=theirs.get(name))
            out[name] = "ok"
        except (TreelakeError, FileExistsError):
            out[name] = "conflict"
    return out


def decode(kind: str, content: bytes) -> object:
    """The value of an object of any kind."""
    return {"blob": bytes, "tree": decode_tree, "commit": decode_commit, "tag": decode_tag}[kind](content)
