"""Which version of a file each of its lines comes from, along first parents, without renames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treelake.functions.lines import carryovers, lines, matched_pairs

OUT = "file string, line_number long, line string, version long"


def attribute(versions: list[tuple[int, str]]) -> list[tuple[int, str, int]]:
    """(line_number, line, version) of the last of a file's versions, which are oldest first. Versions with equal contents are passed over."""
    if not versions:
        return []
    version, text = versions[-1]
    now = lines(text)
    pending = {k: k for k in range(len(now))}  # line of the last version: its place in the current one
    found: dict[int, int] = {}
    for older, before in reversed(versions[:-1]):
        if not pending:
            break
        if before != text:
            old = lines(before)
            kept = carryovers(matched_pairs(old, lines(text)))
            found |= {k: version for k, at in pending.items() if at not in kept}
            pending = {k: kept[at] for k, at in pending.items() if at in kept}
            text = before
        version = older
    found |= dict.fromkeys(pending, version)
    return [(k + 1, line, found[k]) for k, line in enumerate(now)]


def blame(history: DataFrame) -> DataFrame:
    """file, line_number, line, version. history: file, version, text of each file on its first-parent chain. Contents that equal the
    version before are dropped first; the versions of one file that differ are held by one task."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("version")
        rows = attribute(list(zip(map(int, pdf["version"]), pdf["text"].fillna(""))))
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["file", "line_number", "line", "version"])

    h = history.select(F.col("file").cast("string").alias("file"), F.col("version").cast("long").alias("version"), "text")
    h = h.withColumn("_before", F.lag(F.sha1(F.encode("text", "UTF-8"))).over(Window.partitionBy("file").orderBy("version")))
    h = h.where(~F.col("_before").eqNullSafe(F.sha1(F.encode("text", "UTF-8"))) | F.col("_before").isNull()).drop("_before")
    return h.groupBy("file").applyInPandas(run, OUT)


def with_commits(blamed: DataFrame, commits: DataFrame) -> DataFrame:
    """Adds author_name, author_email, author_time and summary; empty or 0 where the commit is missing. commits: version and these."""
    out = blamed.join(commits, "version", "left")
    return out.fillna("", ["author_name", "author_email", "summary"]).fillna(0, ["author_time"])


def path_history(history: DataFrame) -> DataFrame:
    """file, sha, first_version of the distinct contents of each file."""
    return history.groupBy("file", "sha").agg(F.min("version").alias("first_version"))
