"""Differences of trees, of working copies, and of texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake.functions.lines import additions, lines, matched_pairs
from treelake.functions.objects import TreelakeError
from treelake.operators.graph import shared_table

SIDES = ("mode", "sha")


def _operation(a: Column, b: Column, same: Column) -> Column:
    tree, link = "40000", "160000"
    kind = lambda m: F.when(m == tree, "t").when(m == link, "s").otherwise("b")
    return (
        F.when(a.isNull(), "added").when(b.isNull(), "removed").when(kind(a) != kind(b), "type_changed")
        .when((a == link) & ~same, "submodule_change").when(~same, "modified").when(a != b, "mode_changed")
    )


def diff_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, op, old_mode, new_mode, old_sha, new_sha of paths that differ. old, new: path, mode, sha."""
    a = old.select("path", F.col("mode").alias("old_mode"), F.col("sha").alias("old_sha"))
    b = new.select("path", F.col("mode").alias("new_mode"), F.col("sha").alias("new_sha"))
    same = F.col("old_sha") == F.col("new_sha")
    out = a.join(b, "path", "full_outer").withColumn("op", _operation(F.col("old_mode"), F.col("new_mode"), same))
    return out.where("op is not null").select("path", "op", "old_mode", "new_mode", "old_sha", "new_sha")


def in_order(changes: DataFrame) -> DataFrame:
    """By names within each directory, children in place."""
    return changes.orderBy(F.split("path", "/"))


def limited(changes: DataFrame, most: int) -> DataFrame:
    if changes.limit(most + 1).count() > most:
        raise TreelakeError("too_many_changes", most=most)
    return changes


def diff_trees(entries: DataFrame, old: str | None, new: str | None, most: int = 256) -> DataFrame:
    """Changes between two trees by a table of entries (tree, mode, name, sha). Level by level, only pairs of different subtrees are
    entered, so equal ones are never read; an entry that changes its type isn't expanded. Each level is one join and one aggregation,
    and is written before the next."""
    spark = entries.sparkSession
    e = entries.select(F.col("tree").alias("_tree"), "name", "mode", "sha")
    old_side, new_side = F.col("side") == 0, F.col("side") == 1
    level = spark.createDataFrame([("", old, new)], "dir string, a string, b string").where("not (a <=> b)")
    out = None
    for _ in range(most):
        sides = level.select("dir", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("_tree")), F.struct(F.lit(1).alias("side"), F.col("b").alias("_tree")))).alias("s")).select("dir", "s.*").where("_tree is not null")
        sums = [F.max(F.when(on, F.col(c))).alias(f"{when}_{c}") for when, on in (("old", old_side), ("new", new_side)) for c in ("mode", "sha")]
        both = sides.join(e, "_tree").groupBy("dir", "name").agg(*sums).where("not (old_sha <=> new_sha and old_mode <=> new_mode)")
        both = both.withColumn("path", F.when(F.col("dir") == "", F.col("name")).otherwise(F.concat_ws("/", "dir", "name")))
        tree_a, tree_b = F.col("old_mode").eqNullSafe("40000"), F.col("new_mode").eqNullSafe("40000")
        enter = (tree_a & tree_b) | (tree_a & F.col("new_mode").isNull()) | (tree_b & F.col("old_mode").isNull())
        op = _operation(F.col("old_mode"), F.col("new_mode"), F.col("old_sha") == F.col("new_sha"))
        both = shared_table(both)
        rows = both.where(~enter).select("path", op.alias("op"), "old_mode", "new_mode", "old_sha", "new_sha")
        out = rows if out is None else out.unionByName(rows)
        level = both.where(enter).select(F.col("path").alias("dir"), F.when(tree_a, F.col("old_sha")).alias("a"), F.when(tree_b, F.col("new_sha")).alias("b"))
        if level.isEmpty():
            return out
    raise TreelakeError("too_deep", most=most)


def workspace_changes(changes: DataFrame) -> DataFrame:
    """path and status: added, modified or deleted."""
    return changes.select("path", F.when(F.col("op") == "added", "added").when(F.col("op") == "removed", "deleted").otherwise("modified").alias("status"))


def line_diff(pairs: DataFrame) -> DataFrame:
    """key, kept, added, removed: numbers of lines of each pair (key, old, new)."""

    def run(it):
        for pdf in it:
            rows = []
            for key, a, b in zip(pdf["key"], pdf["old"], pdf["new"]):
                x, y = lines(a or ""), lines(b or "")
                kept = len(matched_pairs(x, y))
                rows.append((key, kept, len(y) - kept, len(x) - kept))
            yield pd.DataFrame(rows, columns=["key", "kept", "added", "removed"])

    return pairs.select(F.col("key").cast("string"), "old", "new").mapInPandas(run, "key string, kept long, added long, removed long")


def added_lines(pairs: DataFrame) -> DataFrame:
    """key, line_number, line: lines of new that an edit script from old adds."""

    def run(it):
        for pdf in it:
            rows = []
            for key, a, b in zip(pdf["key"], pdf["old"], pdf["new"]):
                x, y = lines(a or ""), lines(b or "")
                rows += [(key, j + 1, y[j]) for j in additions(matched_pairs(x, y), len(y))]
            yield pd.DataFrame(rows, columns=["key", "line_number", "line"])

    return pairs.select(F.col("key").cast("string"), "old", "new").mapInPandas(run, "key string, line_number long, line string")
