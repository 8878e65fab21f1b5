"""Search in files. Patterns that can't span lines run in the JVM: contents without a match are dropped before lines are made. Others run
over whole contents in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelake.functions.expressions import lines, literal, matches_glob
from treelake.functions.objects import TreelakeError


def pattern_regex(pattern: str, regex: bool = False, ignore_case: bool = False) -> str:
    """A string is literal unless regex says otherwise. Case is folded for ASCII alone."""
    if not pattern:
        raise TreelakeError("empty_pattern")
    return ("(?i)" if ignore_case else "") + (pattern if regex else literal(pattern))


def _files(files: DataFrame, path_glob: str | None) -> DataFrame:
    out = files if path_glob is None else files.where(matches_glob(F.col("path"), path_glob))
    return out.where(~F.col("data").contains("\0") | (F.locate("\0", F.substring("data", 1, 8192)) == 0))


def _hit(data: Column, pattern: str, regex: bool, ignore_case: bool) -> Column:
    return data.contains(pattern) if not regex and not ignore_case else data.rlike(pattern_regex(pattern, regex, ignore_case))


def grep_lines(files: DataFrame, pattern: str, regex: bool = False, ignore_case: bool = False, path_glob: str | None = None, before: int = 0, after: int = 0) -> DataFrame:
    """path, line_number, line, n_matches of lines that match (and context_before, context_after as arrays). files: path, data (string)."""
    e = pattern_regex(pattern, regex, ignore_case)
    found = _files(files, path_glob).where(_hit(F.col("data"), pattern, regex, ignore_case))
    all_lines = lines(F.col("data"))
    columns = ["path", (F.col("pos") + 1).cast("long").alias("line_number"), "line", F.regexp_count("line", F.lit(e)).cast("long").alias("n_matches")]
    keep = [F.col("_all")] if before or after else []
    out = found.select("path", *([all_lines.alias("_all")] if keep else []), F.posexplode(all_lines).alias("pos", "line")).where(_hit(F.col("line"), pattern, regex, ignore_case))
    if not keep:
        return out.select(*columns)
    lo = F.greatest(F.col("pos") - before, F.lit(0))
    return out.select(*columns, F.slice("_all", lo + 1, F.col("pos") - lo).alias("context_before"), F.slice("_all", F.col("pos") + 2, F.lit(after)).alias("context_after"))


def grep_top(found: DataFrame, most: int) -> DataFrame:
    """The first matching lines by path and place."""
    return found.orderBy("path", "line_number").limit(most)


Patterns = dict[str, tuple[str, bool, bool]]  # tag: pattern, regex, ignore_case


def _context(before: int, after: int) -> list[Column]:
    """Lines around the one at _pos of _all."""
    lo = F.greatest(F.col("_pos") - before, F.lit(0))
    return [F.slice("_all", lo + 1, F.col("_pos") - lo).alias("context_before"), F.slice("_all", F.col("_pos") + 2, F.lit(after)).alias("context_after")] if before or after else []


def _tagged(files: DataFrame, patterns: Patterns, path_glob: str | None, context: bool) -> DataFrame:
    """path, _pos, line, (_all,) t of lines with a match: t is the tag and the texts of all its matches. One scan for all patterns."""
    some = None
    for p, r, i in patterns.values():
        hit = _hit(F.col("data"), p, r, i)
        some = hit if some is None else some | hit
    found = _files(files, path_glob).where(some).select("path", lines(F.col("data")).alias("_all"))
    rows = found.select("path", *(["_all"] if context else []), F.posexplode("_all").alias("_pos", "line"))
    each = [F.when(_hit(F.col("line"), p, r, i), F.struct(F.lit(t).alias("tag"), F.regexp_extract_all("line", F.lit(pattern_regex(p, r, i)), F.lit(0)).alias("found"))) for t, (p, r, i) in patterns.items()]
    return rows.select("*", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("t"))


def multi_grep(files: DataFrame, patterns: Patterns, path_glob: str | None = None, before: int = 0, after: int = 0, most: int | None = None) -> DataFrame:
    """tag, path, line_number, line, n_matches (and context_before, context_after) of each pattern's matching lines; most: only the first by
    path, place and tag."""
    rows = _tagged(files, patterns, path_glob, bool(before or after))
    out = rows.select("t.tag", "path", (F.col("_pos") + 1).cast("long").alias("line_number"), "line", F.size("t.found").cast("long").alias("n_matches"), *_context(before, after))
    return out if most is None else out.orderBy("path", "line_number", "tag").limit(most)


def multi_grep_matches(files: DataFrame, patterns: Patterns, path_glob: str | None = None, before: int = 0, after: int = 0, most: int | None = None) -> DataFrame:
    """tag, path, line_number, match_number, match, line (and the context): a row for each match of each pattern, from left to right."""
    rows = _tagged(files, patterns, path_glob, bool(before or after))
    rows = rows.select("*", F.posexplode("t.found").alias("_ix", "match"))
    out = rows.select("t.tag", "path", (F.col("_pos") + 1).cast("long").alias("line_number"), (F.col("_ix") + 1).cast("long").alias("match_number"), "match", "line", *_context(before, after))
    return out if most is None else out.orderBy("path", "line_number", "match_number", "tag").limit(most)


def grep_matches(files: DataFrame, pattern: str, regex: bool = False, ignore_case: bool = False, path_glob: str | None = None, before: int = 0, after: int = 0, most: int | None = None) -> DataFrame:
    """path, line_number, match_number, match, line (and the context): a row for each match."""
    return multi_grep_matches(files, {"": (pattern, regex, ignore_case)}, path_glob, before, after, most).drop("tag")


def totals(files: DataFrame, found: DataFrame) -> DataFrame:
    """match_count, files_matched, files_scanned, bytes_scanned."""
    a = found.agg(F.coalesce(F.sum("n_matches"), F.lit(0)).cast("long").alias("match_count"), F.count_distinct("path").alias("files_matched"))
    b = files.agg(F.count("*").alias("files_scanned"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).cast("long").alias("bytes_scanned"))
    return a.join(b)  # one row each


HELD = 4 << 20  # bytes of rows that a search of whole contents holds before it gives them on
WHOLE = "path string, line_number long, offset long, match string, line string"


def grep_whole(files: DataFrame, pattern: str, flags: int = 0, path_glob: str | None = None, before: int = 0, after: int = 0, most: int | None = None) -> DataFrame:
    """Each match of a regular expression in whole contents, from left to right without overlaps, reported on the line where it begins
    (and context_before, context_after around that line); it may span lines, and ^ and $ are the contents' ends unless flags say
    otherwise. Places count bytes. most: only the first by path and place."""
    around = bool(before or after)
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()) + (pa.list_(pa.string()),) * 2 * around
    names = [c.split()[0] for c in WHOLE.split(", ")] + ["context_before", "context_after"] * around

    def text(x: bytes) -> str:
        return x.decode("utf-8", "replace")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = re.compile(pattern.encode(), flags)
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        for b in it:
            rows, held = [], 0
            contents = b.column(1).cast(pa.binary())  # the same buffers; one content at a time becomes an object
            for k in range(b.num_rows):
                path, raw = b.column(0)[k].as_py(), contents[k].as_py()
                if raw is None or b"\0" in raw[:8192]:
                    continue
                number, done, every = 1, 0, None  # line feeds are counted once, forward
                for m in e.finditer(raw):
                    number, done = number + raw.count(b"\n", done, m.start()), m.start()
                    start = raw.rfind(b"\n", 0, m.start()) + 1
                    end = raw.find(b"\n", m.start())
                    row = (path, number, m.start(), text(m.group()), text(raw[start : end if end >= 0 else None]))
                    if around:
                        every = every or [text(x) for x in raw.removesuffix(b"\n").split(b"\n")]
                        row += (every[max(0, number - 1 - before) : number - 1], every[number : number + after])
                    rows.append(row)
                    held += 500 + len(row[3]) + len(row[4]) + sum(len(x) + 50 for c in row[5:] for x in c)
                    if held > HELD:
                        yield give(rows)
                        rows, held = [], 0
            if rows:
                yield give(rows)

    some = files if path_glob is None else files.where(matches_glob(F.col("path"), path_glob))
    out = some.select("path", "data").mapInArrow(run, WHOLE + ", context_before array<string>, context_after array<string>" * around)
    return out if most is None else out.orderBy("path", "offset").limit(most)


def grep_blobs(paths: DataFrame, blobs: DataFrame, pattern: str, **options) -> DataFrame:
    """The same over a repository: each distinct content is searched once, then joined to its paths. paths: path, sha; blobs: sha, data."""
    wanted = blobs.join(paths.select("sha").distinct(), "sha", "left_semi").select(F.col("sha").alias("path"), "data")
    found = grep_lines(wanted, pattern, **options).withColumnRenamed("path", "sha")
    return paths.select("path", "sha").join(found, "sha").drop("sha")


def context_frame(rows: DataFrame, before: int) -> DataFrame:
    """The lines before each line as one string, by a window frame. rows: path, line_number, line."""
    w = Window.partitionBy("path").orderBy("line_number").rowsBetween(-before, -1)
    return rows.withColumn("context", F.array_join(F.collect_list("line").over(w), "|"))
