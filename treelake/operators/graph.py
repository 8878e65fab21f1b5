"""Commit and object graphs.

What is reachable: graphs of at most LOCAL_EDGES edges (counted first) are walked by one task over arrays. Larger ones stay tables, which
are written once. Few seeds are first followed for NEAR_HOPS steps by broadcasts of what the last step found, so only hits are shuffled;
that ends where what they reach is at most NEAR_IDS ids and not deeper. Where it doesn't end, all is done over tables: the inner nodes of chains, which have one child and one parent, are taken out by pointer doubling, the rest is reached by frontier joins
against what is known, and chains come back by the child at their end. Lineage is cut in the shared checkpoint folder. Orders that
depend on a queue run for each repository in one task, over the ids and times that its start reaches."""

from __future__ import annotations

import heapq
import os
import re
import uuid
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

LOCAL_EDGES = 2_000_000  # edges that one task walks, some 100 MB
LOCAL_SEEDS = 64  # labelled seeds that it walks from
NEAR_HOPS = 32  # steps of broadcasts, each a scan of the edges
NEAR_IDS = 100_000  # ids that these find and the driver holds
HOPS = 4  # steps in one round, before it is compared with what is known
PARTS = 8  # tables of what is known, before they are written as one


def shared_table(df: DataFrame) -> DataFrame:
    """The same rows from a table written to spark.checkpoint.dir. Where that is unset, to a folder of this machine for local runs; an
    error on a cluster."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file:///tmp/treelake-shared"
    path = f"{at.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _walk(src: np.ndarray, dst: np.ndarray, nodes: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function that tells which nodes some nodes reach, themselves included."""
    order = np.argsort(src, kind="stable")
    to, begin = dst[order], np.searchsorted(src[order], np.arange(nodes + 1))

    def reach(frontier: np.ndarray) -> np.ndarray:
        seen = np.zeros(nodes, bool)
        seen[frontier] = True
        while len(frontier):
            count = begin[frontier + 1] - begin[frontier]
            at = np.repeat(begin[frontier] - np.cumsum(count) + count, count) + np.arange(count.sum())
            frontier = np.unique(to[at])
            frontier = frontier[~seen[frontier]]
            seen[frontier] = True
        return seen

    return reach


def _in_one_task(edges: DataFrame, extra: list, fn: Callable, schema: str) -> DataFrame:
    """fn(src, dst, nodes, reach, places of extra) over numbered nodes gives columns; places in nodes become ids."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in it if b.num_rows]
        src, dst = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, object) for k in (0, 1))
        number, nodes = pd.factorize(np.concatenate([src, dst, np.array(extra, dtype=src.dtype if len(src) else None)]))
        n = len(src)
        for columns in fn(number[:n], number[n : 2 * n], nodes, _walk(number[:n], number[n : 2 * n], len(nodes)), number[2 * n :]):
            frame = pd.DataFrame(dict(zip([c.split()[0] for c in schema.split(", ")], columns)))
            for s in range(0, len(frame), 100_000):
                yield pa.RecordBatch.from_pandas(frame.iloc[s : s + 100_000], preserve_index=False)

    return edges.select("src", "dst").dropna().repartition(1).mapInArrow(run, schema)


def _is_small(edges: DataFrame) -> bool:
    return edges.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES


def _expand(edges: DataFrame, frontier: DataFrame, keys: list[str]) -> DataFrame:
    """keys of what the frontier reaches in 1 to HOPS steps, each once."""
    level, out = frontier, None
    for _ in range(HOPS):
        level = edges.join(level, F.col("src") == F.col("id")).select(*[F.col("dst").alias("id") if k == "id" else k for k in keys]).distinct()
        out = level if out is None else out.unionByName(level)
    return out.distinct()


def _near(edges: DataFrame, seeds: list[tuple], keys: list[str], schema: str) -> DataFrame | None:
    """keys of all that some seeds reach, or None where that is more than NEAR_IDS rows or deeper than NEAR_HOPS steps."""
    if "binary" in schema:  # no keys of a set
        return None
    spark, known, frontier = edges.sparkSession, set(seeds), set(seeds)
    for _ in range(NEAR_HOPS):
        if len(known) > NEAR_IDS:
            return None
        level = F.broadcast(_local(spark, sorted(frontier), schema))
        found = edges.join(level, F.col("src") == F.col("id")).select(*[F.col("dst").alias("id") if k == "id" else k for k in keys]).distinct()
        frontier = {tuple(r) for r in found.limit(NEAR_IDS + 1).collect()} - known
        if not frontier:
            return _local(spark, sorted(known), schema)
        known |= frontier
    return None


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a table whose size is known to the planner."""
    kind = StructType.fromDDL(schema)
    columns = zip(*rows) if rows else [[] for _ in kind]
    return spark.createDataFrame(pa.table([pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, kind)], kind.names), kind)


def _written(edges: DataFrame) -> DataFrame:
    """src, dst written once, so that no later step computes them again."""
    return shared_table(edges.select("src", "dst").dropna())


def _contracted(edges: DataFrame, seeds: DataFrame, most: int = 64) -> tuple[DataFrame, DataFrame]:
    """Edges without the inner nodes of chains, and these (id) with the nearest node on their children's side that isn't one (top). A
    node has one parent and one child to be an inner one, and is no seed. Pointers double, so a chain of n takes log n rounds."""
    e = shared_table(edges.select("src", "dst").dropna().distinct())
    one_parent = e.groupBy(F.col("src").alias("id")).count().where("count = 1").select("id")
    inner = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min("src").alias("top")).where("n = 1").drop("n")
    inner = shared_table(inner.join(one_parent, "id", "left_semi").join(seeds.select("id"), "id", "left_anti"))
    for _ in range(most):
        further = inner.select(F.col("id").alias("top"), F.col("top").alias("further"))
        jumped = shared_table(inner.join(further, "top", "left").select("id", F.coalesce("further", "top").alias("top"), F.col("further").isNotNull().alias("moved")))
        inner = jumped.select("id", "top")
        if jumped.where("moved").isEmpty():
            break
    short = e.join(inner.select(F.col("id").alias("dst")), "dst", "left_anti").join(inner.select(F.col("id").alias("src"), "top"), "src", "left")
    return shared_table(short.select(F.coalesce("top", "src").alias("src"), "dst").distinct()), inner


def _closure(edges: DataFrame, seeds: DataFrame, keys: list[str], most: int) -> DataFrame:
    seeds = shared_table(seeds.select(*keys).distinct())
    short, inner = _contracted(edges, seeds)
    seen, frontier = [seeds], seeds
    for _ in range(most):
        known = seen[0]
        for t in seen[1:]:
            known = known.unionByName(t)
        frontier = shared_table(_expand(short, frontier, keys).join(known, keys, "left_anti"))
        if frontier.isEmpty():
            within = inner.join(known.withColumnRenamed("id", "top"), "top").select(*keys)
            return known.unionByName(within)
        seen = [shared_table(known), frontier] if len(seen) >= PARTS else [*seen, frontier]
    raise ValueError("more rounds than allowed")


def reachable(edges: DataFrame, seeds: DataFrame, most: int = 100_000) -> DataFrame:
    """id of all nodes that seeds (id) reach over edges (src, dst), seeds included, each once. Beyond LOCAL_EDGES a round for every HOPS
    steps between nodes that branch."""
    kind = dict(edges.dtypes)["src"]
    some = [r.id for r in seeds.select("id").where("id is not null").distinct().limit(max(LOCAL_EDGES // 20, NEAR_IDS) + 1).collect()]
    small = len(some) <= LOCAL_EDGES // 20 and _is_small(edges)
    if not small and len(some) <= NEAR_IDS:
        edges = _written(edges)
        if (near := _near(edges, [(i,) for i in some], ["id"], f"id {kind}")) is not None:
            return near
    if not small:
        return _closure(edges, seeds, ["id"], most)
    return _in_one_task(edges, some, lambda src, dst, nodes, reach, extra: [[nodes[reach(np.unique(extra))]]], f"id {kind}")


def labelled_reach(edges: DataFrame, seeds: DataFrame, most: int = 100_000) -> DataFrame:
    """seed, id: the same for several seeds (seed, id) at once."""
    some = [(r.seed, r.id) for r in seeds.select("seed", "id").distinct().limit(LOCAL_SEEDS + 1).collect()]
    schema = f"seed {dict(seeds.dtypes)['seed']}, id {dict(edges.dtypes)['src']}"
    small = len(some) <= LOCAL_SEEDS and _is_small(edges)
    if not small and len(some) <= LOCAL_SEEDS and all(None not in r for r in some):
        edges = _written(edges)
        if (near := _near(edges, some, ["seed", "id"], schema)) is not None:
            return near
    if not small:
        return _closure(edges, seeds, ["seed", "id"], most)
    labels = sorted({s for s, _ in some})

    def walk(src, dst, nodes, reach, extra):
        for label in labels:
            got = nodes[reach(np.array(sorted({int(k) for k, (s, _) in zip(extra, some) if s == label}), dtype=np.int64))]
            yield [[label] * len(got), got]

    return _in_one_task(edges, [i for _, i in some], walk, schema)


def object_edges(commits: DataFrame, tree_entries: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """src, dst: commit to tree and parents, tree to entries (not submodules), tag to object."""
    out = commits.select(F.col("sha").alias("src"), F.col("tree").alias("dst"))
    out = out.unionByName(commits.select(F.col("sha").alias("src"), F.explode("parents").alias("dst")))
    out = out.unionByName(tree_entries.where("mode <> '160000'").select(F.col("tree").alias("src"), F.col("sha").alias("dst")))
    return out if tags is None else out.unionByName(tags.select(F.col("sha").alias("src"), F.col("object").alias("dst")))


def to_send(edges: DataFrame, wants: DataFrame, haves: DataFrame) -> DataFrame:
    """id of what wants reach and haves don't."""
    return reachable(edges, wants).join(reachable(edges, haves), "id", "left_anti")


def merge_bases(edges: DataFrame, a, b) -> DataFrame:
    """id of the best common ancestors of two commits: common ancestors that are no parent of another. edges: child to parent."""
    spark, kind = edges.sparkSession, dict(edges.dtypes)["src"]
    if a == b:
        return spark.createDataFrame([(a,)], f"id {kind}")
    if _is_small(edges):

        def walk(src, dst, nodes, reach, extra):
            both = reach(extra[:1]) & reach(extra[1:])
            covered = np.zeros(len(nodes), bool)
            covered[dst[both[src]]] = True
            return [[nodes[both & ~covered]]]

        return _in_one_task(edges, [a, b], walk, f"id {kind}")
    seeds = spark.createDataFrame([(0, a), (1, b)], f"seed int, id {kind}")
    both = shared_table(labelled_reach(edges, seeds).groupBy("id").agg(F.count("*").alias("n")).where("n = 2").select("id"))
    covered = edges.join(both, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id"))
    return both.join(covered, "id", "left_anti")


def merge_base(edges: DataFrame, times: DataFrame, ids: list) -> object | None:
    """One base of any number of commits, folded from the left; of several the newest, then the smallest id. times: id, time."""
    if not ids:
        return None
    base = ids[0]
    for other in ids[1:]:
        best = merge_bases(edges, base, other).join(times, "id", "left").orderBy(F.desc_nulls_last("time"), "id").limit(1).collect()
        if not best:
            return None
        base = best[0].id
    return base


def indegree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_children"))


def date_ordered(ids: DataFrame, times: DataFrame, most: int | None = None) -> DataFrame:
    """Newest first, smaller ids first among equals. This is the best-first order wherever no commit is older than its parents."""
    out = ids.join(times, "id").orderBy(F.desc("time"), "id")
    return out if most is None else out.limit(most)


def numbered(df: DataFrame, by: list[Column], name: str = "ord") -> DataFrame:
    """df with the place of each row in an order, from 1 on: rows are split by range, numbered in their parts, and shifted by the sizes
    of the parts before, which are all that the driver sees."""
    t = df.repartitionByRange(*by).sortWithinPartitions(*by)
    t = shared_table(t.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    before, shift = 0, []
    for r in t.groupBy("_part").count().orderBy("_part").collect():
        shift.append((r["_part"], before))
        before += r["count"]
    parts = t.sparkSession.createDataFrame(shift, "_part int, _shift long")  # a row for each part
    return t.join(F.broadcast(parts), "_part").withColumn(name, F.col("_shift") + F.col("_at") + 1).drop("_part", "_at", "_shift")


def skewed_edges(edges: DataFrame, times: DataFrame) -> DataFrame:
    """Edges whose parent is newer than the child: there date_ordered isn't the best-first order, and ordered_walk must be used."""
    c, p = times.select(F.col("id").alias("src"), F.col("time").alias("child_time")), times.select(F.col("id").alias("dst"), F.col("time").alias("parent_time"))
    return edges.join(c, "src").join(p, "dst").where("parent_time > child_time")


def best_first(start: str, parents: dict[str, list[str]], time: dict[str, int]) -> list[str]:
    """A commit comes only after some child; of those that are open the newest, then the smallest id."""
    seen, heap, out = {start}, [(-time[start], start)] if start in time else [], []
    while heap:
        _, c = heapq.heappop(heap)
        out.append(c)
        for p in parents.get(c, []):
            if p not in seen and p in time:
                seen.add(p)
                heapq.heappush(heap, (-time[p], p))
    return out


def topological(start: str, parents: dict[str, list[str]], present) -> list[str]:
    """Children before parents: first in, first out among those that are ready, in the order of parent lists. Missing parents are skipped."""
    inside, stack = {start} if start in present else set(), [start] if start in present else []
    waiting: dict[str, int] = {}
    while stack:
        for p in parents.get(stack.pop(), []):
            if p in present:
                waiting[p] = waiting.get(p, 0) + 1
                if p not in inside:
                    inside.add(p)
                    stack.append(p)
    ready, out = deque([start] if start in present else []), []
    while ready:
        c = ready.popleft()
        out.append(c)
        for p in parents.get(c, []):
            if p in present:
                waiting[p] -= 1
                if not waiting[p]:
                    ready.append(p)
    return out


def ordered_walk(commits: DataFrame, starts: DataFrame, order: str = "date", most: int | None = None) -> DataFrame:
    """repo, ord, sha from each repository's start. commits: repo, sha, parents, time; starts: repo, start. Of one repository the commits
    that its start reaches (ids, parents and times) are held by one task."""
    choose = {"date": lambda s, p, t: best_first(s, p, t), "topo": lambda s, p, t: topological(s, p, t)}[order]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parents = {s: list(p) for s, p in zip(pdf["sha"], pdf["parents"])}
        out = choose(pdf["start"].iloc[0], parents, dict(zip(pdf["sha"], map(int, pdf["time"]))))[:most]
        return pd.DataFrame({"repo": [key[0]] * len(out), "ord": range(len(out)), "sha": out})

    few = starts.limit(NEAR_IDS + 1).count() <= NEAR_IDS  # a repository's commits aren't shuffled to one task
    name = lambda sha: F.concat_ws("\n", "repo", sha)
    mine = shared_table(commits.join(F.broadcast(starts) if few else starts, "repo").select("repo", "sha", "parents", "time", "start"))
    edges = mine.select(name("sha").alias("src"), F.explode("parents").alias("_p"), "repo").select("src", name("_p").alias("dst"))
    inside = reachable(edges, starts.select(name("start").alias("id")))
    mine = mine.withColumn("id", name("sha")).join(inside, "id", "left_semi").drop("id")
    return mine.groupBy("repo").applyInPandas(run, "repo string, ord long, sha string")


def first_parents(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """id on the first-parent chains. edges: src, dst, parent_ix."""
    return reachable(edges.where("parent_ix = 0").select("src", "dst"), seeds)


def resolve(refs: DataFrame, most: int = 10) -> DataFrame:
    """name, sha of all references, symbolic ones followed at most `most` times; those that lead nowhere or in circles are left out."""
    r = refs.select("name", "sha", F.coalesce("target", F.lit(None).cast("string")).alias("target"))
    t = refs.select(F.col("name").alias("_name"), F.col("sha").alias("_sha"), F.col("target").alias("_target"))
    out = r
    for _ in range(most):
        if out.where("sha is null and target is not null").isEmpty():
            break
        out = out.join(t, out.target == t._name, "left").select("name", F.coalesce("sha", "_sha").alias("sha"), F.when(F.col("sha").isNull(), F.col("_target")).alias("target"))
    return out.where("sha is not null").select("name", "sha")


def default_branch(refs: DataFrame) -> DataFrame:
    """The one branch that HEAD names, or main, master, else the first."""
    head = refs.where("name = 'HEAD'").select(F.col("target").alias("_head"))
    b = refs.where(F.col("name").startswith("refs/heads/")).join(head, F.col("name") == F.col("_head"), "left")
    rank = F.when(F.col("_head").isNotNull(), 0).when(F.col("name") == "refs/heads/main", 1).when(F.col("name") == "refs/heads/master", 2).otherwise(3)
    return b.select(F.min_by("name", F.struct(rank, F.col("name"))).alias("name"))


def list_refs(refs: DataFrame, prefixes: list[str] | None = None) -> DataFrame:
    out = refs
    if prefixes:
        some = F.lit(False)
        for p in prefixes:
            some = some | F.col("name").startswith(p)
        out = out.where(some)
    return out.dropDuplicates(["name"]).orderBy("name")


def newest(candidates: DataFrame, by: str) -> DataFrame:
    """Of each group the newest, then the smallest id."""
    w = Window.partitionBy(by).orderBy(F.desc("time"), "id")
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def clear_shared(spark: SparkSession) -> None:
    """Removes a shared folder of our own."""
    import shutil

    if not spark.conf.get("spark.checkpoint.dir", None) and os.path.isdir("/tmp/treelake-shared"):
        shutil.rmtree("/tmp/treelake-shared")
