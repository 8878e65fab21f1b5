"""A repository over the driver's tables: views that both Spark and SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.functions.expressions import blob_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path():
    return F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, mode, data, doc_id: each document is a file."""
    return table(spark, sf_dir, "documents").select(_path().alias("path"), F.when(F.col("doc_id") % 13 == 0, "100755").otherwise("100644").alias("mode"), F.col("text").alias("data"), "doc_id")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where("doc_id % 10 <> 0").select("path", "mode", blob_id(F.col("data")).alias("sha"))


def head(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).where("doc_id % 7 <> 0")
    mode = F.when(F.col("doc_id") % 17 != 0, F.col("mode")).when(F.col("mode") == "100644", "100755").otherwise("100644")
    data = F.when(F.col("doc_id") % 11 == 0, F.replace("data", F.lit("e"), F.lit("E"))).otherwise(F.col("data"))
    return f.select("path", mode.alias("mode"), blob_id(data).alias("sha"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, parent_ix: an event's parents are its id halved and divided by three."""
    e = table(spark, sf_dir, "events").where("event_id >= 2")
    parents = F.filter(F.array(F.struct(F.expr("event_id div 2").alias("dst"), F.lit(0).alias("parent_ix")), F.struct(F.expr("event_id div 3").alias("dst"), F.lit(1).alias("parent_ix"))), lambda p: p.dst >= 1)
    return e.select(F.col("event_id").alias("src"), F.explode(parents).alias("p")).select("src", "p.dst", "p.parent_ix")


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_id >= 1").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").cast("long").alias("time"))


def history(spark: SparkSession, sf_dir: str, tagged: bool = False) -> DataFrame:
    """file, version, text: a conversation's file holds the texts of its last three turns; tagged: each line begins with its turn."""
    c = table(spark, sf_dir, "conversations")
    if tagged:
        mark = F.concat(F.col("turn").cast("string"), F.lit(":"))
        c = c.withColumn("text", F.concat(mark, F.replace("text", F.lit("\n"), F.concat(F.lit("\n"), mark))))
    later = F.explode(F.sequence(F.col("turn"), F.col("turn") + 2)).alias("version")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    rows = c.select("conv_id", "turn", "text", later).join(last, "conv_id").where("version <= _last")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text), "\n")
    return rows.groupBy(F.col("conv_id").cast("string").alias("file"), "version").agg(text.alias("text"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, kind, sha, target: a branch for each conversation, and HEAD."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    b = c.select(F.concat(F.lit("refs/heads/conv-"), F.col("conv_id").cast("string")).alias("name"), F.lit("direct").alias("kind"), F.sha1(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("sha"), F.lit(None).cast("string").alias("target"))
    return b.unionByName(spark.createDataFrame([("HEAD", "symbolic", None, "refs/heads/conv-0")], "name string, kind string, sha string, target string"))


def geo_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree, mode, name, sha: regions, nations in them, customers in these."""
    r = table(spark, sf_dir, "region").select(F.lit("root").alias("tree"), F.lit("40000").alias("mode"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("name"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("sha"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.lit("40000"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.lit("100644"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    return r.union(n).union(c)


def geo_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another version from the tree root2 on: in four of five nations some customers are gone, changed, or have another mode, and some are new."""
    r, n, c = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer").where("c_nationkey % 5 <> 0")
    text = lambda p, col, s="": F.concat(F.lit(p), F.col(col).cast("string"), F.lit(s))
    tree = F.lit("40000")
    out = r.select(F.lit("root2").alias("tree"), tree.alias("mode"), text("r", "r_regionkey").alias("name"), text("r", "r_regionkey", "b").alias("sha"))
    out = out.union(n.select(text("r", "n_regionkey", "b"), tree, text("n", "n_nationkey"), F.when(F.expr("n_nationkey % 5 = 0"), text("n", "n_nationkey")).otherwise(text("n", "n_nationkey", "b"))))
    kept = c.where("c_custkey % 7 <> 0")
    out = out.union(kept.select(text("n", "c_nationkey", "b"), F.when(F.expr("c_custkey % 13 = 0"), "100755").otherwise("100644"), text("c", "c_custkey"), F.when(F.expr("c_custkey % 11 = 0"), text("c", "c_custkey", "b")).otherwise(text("c", "c_custkey"))))
    return out.union(c.where("c_custkey % 17 = 0").select(text("n", "c_nationkey", "b"), F.lit("100644"), text("d", "c_custkey"), text("d", "c_custkey")))


def repo(spark: SparkSession, sf_dir: str):
    """A repository with one commit, whose tree has all files: contents, trees and the commit as objects, and HEAD on main."""
    from treelake.functions.objects import Commit, encode_commit, object_id
    from treelake.operators.graph import shared_table
    from treelake.operators.workspace import trees
    from treelake.repo import Repo

    f = files(spark, sf_dir).select("path", "mode", F.encode("data", "UTF-8").alias("content")).withColumn("sha", blob_id(F.decode("content", "UTF-8")))
    dirs = shared_table(trees(f.select("path", "mode", "sha")))
    root = dirs.where("dir = ''").first().sha
    content = encode_commit(Commit([("tree", root), ("author", "u <u> 1 +0000"), ("committer", "u <u> 1 +0000")], "all\n"))
    sized = lambda t, kind: t.select(F.lit(kind).alias("type"), "sha", F.octet_length("content").cast("long").alias("size"), "content")
    one = spark.createDataFrame([("commit", object_id("commit", content), len(content), content)], "type string, sha string, size long, content binary")
    objects = sized(f.dropDuplicates(["sha"]), "blob").unionByName(sized(dirs.dropDuplicates(["sha"]), "tree")).unionByName(one)
    refs = spark.createDataFrame([("HEAD", "symbolic", None, "refs/heads/main"), ("refs/heads/main", "direct", object_id("commit", content), None)], "name string, kind string, sha string, target string")
    return Repo(objects, refs)


def profile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("event"), F.expr("cast(value * 1000 as bigint)").alias("duration_us"))


SHA = "sha1(encode('blob ' || octet_length(encode({0}))) || '\\x00'::BLOB || encode({0}))"
FILES = "files AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, CASE WHEN doc_id % 13 = 0 THEN '100755' ELSE '100644' END AS mode, text AS data, doc_id FROM documents)"
LINES = FILES + ", _l AS (SELECT path, string_split(data, chr(10)) AS l FROM files), _k AS (SELECT path, CASE WHEN l[len(l)] = '' THEN l[1:len(l)-1] ELSE l END AS l FROM _l), lines AS (SELECT path, unnest(range(1, len(l) + 1)) AS line_number, unnest(l) AS line FROM _k)"
_HEAD = "CASE WHEN doc_id % 11 = 0 THEN replace(data, 'e', 'E') ELSE data END"
BASE = FILES + f", base AS (SELECT path, mode, {SHA.format('data')} AS sha FROM files WHERE doc_id % 10 <> 0), head AS (SELECT path, CASE WHEN doc_id % 17 <> 0 THEN mode WHEN mode = '100644' THEN '100755' ELSE '100644' END AS mode, {SHA.format(_HEAD)} AS sha FROM files WHERE doc_id % 7 <> 0), changes AS (SELECT coalesce(b.path, h.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN h.path IS NULL THEN 'removed' WHEN b.sha <> h.sha THEN 'modified' WHEN b.mode <> h.mode THEN 'mode_changed' END AS op, b.mode AS old_mode, h.mode AS new_mode, b.sha AS old_sha, h.sha AS new_sha FROM base b FULL JOIN head h ON b.path = h.path)"
_GEO = "'r' || n_regionkey || '/n' || c_nationkey || '/"
GEO_DIFF = (
    f"WITH c AS (SELECT c_custkey AS k, {_GEO}c' || c_custkey AS path, {_GEO}d' || c_custkey AS new FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey % 5 <> 0) "
    "SELECT path, CASE WHEN k % 7 = 0 THEN 'removed' WHEN k % 11 = 0 THEN 'modified' ELSE 'mode_changed' END AS op, '100644' AS old_mode, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 13 = 0 THEN '100755' ELSE '100644' END AS new_mode, 'c' || k AS old_sha, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 0 THEN 'c' || k || 'b' ELSE 'c' || k END AS new_sha FROM c WHERE k % 7 = 0 OR k % 11 = 0 OR k % 13 = 0 "
    "UNION ALL SELECT new, 'added', NULL, '100644', NULL, 'd' || k FROM c WHERE k % 17 = 0"
)
EDGES = "edges AS (SELECT event_id AS src, event_id // 2 AS dst, 0 AS parent_ix FROM events WHERE event_id >= 2 UNION ALL SELECT event_id, event_id // 3, 1 FROM events WHERE event_id >= 3)"
