"""Path operators: recursive walk, listing, stat, reading, line slices, globs. Trees are tables of entries, paths are expanded a level at
a time, and a filter on a directory prefix prunes the expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake.functions.expressions import ancestors, glob_prefix, lines, matches_glob
from treelake.functions.objects import TreelakeError
from treelake.operators.graph import shared_table


def walk(tree_entries: DataFrame, roots: DataFrame, under: str = "", most: int = 256) -> DataFrame:
    """root, path, mode, sha, depth of every entry that isn't a tree, links and submodules included. tree_entries: tree, mode, name, sha;
    roots: root. under: only what lies in this directory; other subtrees aren't entered. Missing trees are skipped. The driver runs one
    join for each level, whose result is written before the next, and no level is larger than the trees themselves."""
    e = tree_entries.select(F.col("tree").alias("_tree"), "mode", "name", F.col("sha").alias("_sha"))
    level = roots.select("root", F.lit("").alias("dir"), F.col("root").alias("at"))
    out = None
    for depth in range(1, most + 1):
        here = level.join(e, F.col("at") == F.col("_tree")).withColumn("path", F.when(F.col("dir") == "", F.col("name")).otherwise(F.concat_ws("/", "dir", "name")))
        if under:
            here = here.where(F.lit(under).startswith(F.concat("path", F.lit("/"))) | F.concat("path", F.lit("/")).startswith(under) | F.col("path").startswith(under))
        here = shared_table(here.select("root", "path", "mode", "_sha"))
        files = here.where("mode <> '40000'").select("root", "path", "mode", F.col("_sha").alias("sha"), F.lit(depth).alias("depth"))
        if under:
            files = files.where(F.col("path").startswith(under))
        out = files if out is None else out.unionByName(files)
        level = here.where("mode = '40000'").select("root", F.col("path").alias("dir"), F.col("_sha").alias("at"))
        if level.isEmpty():
            return out
    raise TreelakeError("too_deep", most=most)


def glob(paths: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """Paths of a glob, in byte order."""
    return paths.where(matches_glob(F.col(path), pattern)).orderBy(path)


def walk_glob(tree_entries: DataFrame, roots: DataFrame, pattern: str) -> DataFrame:
    return glob(walk(tree_entries, roots, glob_prefix(pattern)), pattern)


def under(path: Column, directory: str) -> Column:
    directory = directory.strip("/")
    return path.startswith(directory + "/") if directory else F.lit(True)


def ls(files: DataFrame, directory: str = "") -> DataFrame:
    """name, mode, sha of a directory's entries in tree order. files: path, mode, sha. A directory's sha is null here."""
    directory = directory.strip("/")
    rest = F.substring(F.col("path"), len(directory) + 2 if directory else 1, 1 << 30)
    name, deeper = F.substring_index(rest, "/", 1), rest.contains("/")
    found = files.where(under(F.col("path"), directory)).select(name.alias("name"), F.when(deeper, "40000").otherwise(F.col("mode")).alias("mode"), F.when(~deeper, F.col("sha")).alias("sha"))
    return found.distinct().orderBy(F.when(F.col("mode") == "40000", F.concat("name", F.lit("/"))).otherwise(F.col("name")))


def directories(files: DataFrame) -> DataFrame:
    """path and number of files below of each directory."""
    return files.select(F.explode(ancestors(F.col("path"))).alias("path")).groupBy("path").agg(F.count("*").alias("n_files"))


def stat(files: DataFrame) -> DataFrame:
    """path, type, mode, size: of files and of directories (whose size is null)."""
    f = files.select("path", F.when(F.col("mode") == "160000", "submodule").when(F.col("mode") == "120000", "symlink").otherwise("blob").alias("type"), "mode", F.octet_length("data").cast("long").alias("size"))
    d = files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().select("path", F.lit("tree").alias("type"), F.lit("40000").alias("mode"), F.lit(None).cast("long").alias("size"))
    return f.unionByName(d)


def read_path(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") == path.strip("/"))


def exists(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of wanted whose path is a file."""
    return wanted.join(files.select("path"), "path", "left_semi")


def read_lines(files: DataFrame, first: int = 1, last: int | None = None, chosen: list[int] | None = None) -> DataFrame:
    """path, line_number, line of a range or of chosen lines; what lies beyond the end isn't there."""
    if chosen is not None and any(n < 1 for n in chosen) or first < 1:
        raise TreelakeError("invalid_line_range")
    every = lines(F.col("data"))
    if chosen is not None:
        wanted = F.filter(F.array(*map(F.lit, sorted(set(chosen)))), lambda n: n <= F.size("_all")) if chosen else F.array().cast("array<int>")
        return files.select("path", every.alias("_all")).select("path", F.explode(wanted).alias("n"), "_all").select("path", F.col("n").cast("long").alias("line_number"), F.get("_all", F.col("n") - 1).alias("line"))
    n = F.greatest(F.size("_all") - (first - 1), F.lit(0))
    n = n if last is None else F.least(n, F.lit(max(last - first + 1, 0)))
    some = files.select("path", every.alias("_all")).select("path", F.posexplode(F.slice("_all", F.lit(first), n)).alias("pos", "line"))  # lines outside never become rows
    return some.select("path", (F.col("pos") + first).cast("long").alias("line_number"), "line")


def stream_read(files: DataFrame, path: str, byte_range: tuple[int, int | None] | None = None, line_range: tuple[int, int | None] | None = None, size: int = 65536) -> DataFrame:
    """chunk, data of one file (data: binary): its bytes from the first place up to before the second, of these the lines (from 1, both
    included; None is the end), in pieces."""
    one = files.where(F.col("path") == path.strip("/")).select("path", F.col("data").cast("binary").alias("data"))
    if byte_range is not None:
        a, b = byte_range
        if a < 0 or b is not None and b < a:
            raise TreelakeError("invalid_byte_range", range=byte_range)
        one = one.withColumn("data", F.expr(f"substring(data, {a + 1}, {(1 << 30) if b is None else b - a})"))
    if line_range is not None:
        a, b = line_range
        if a < 1 or b is not None and b < a:
            raise TreelakeError("invalid_line_range", range=line_range)
        one = one.mapInArrow(_line_slice(a, b), "path string, data binary")
    return chunks(one, size).drop("path")


def _line_slice(first: int, last: int | None):
    import pyarrow as pa

    def run(it):
        for b in it:
            cut = []
            for data in b.column(1).to_pylist():
                parts = data.split(b"\n")
                whole = [p + b"\n" for p in parts[:-1]] + [p for p in parts[-1:] if p]
                cut.append(b"".join(whole[first - 1 : last]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cut, pa.binary())], ["path", "data"])

    return run


def chunks(files: DataFrame, size: int = 65536) -> DataFrame:
    """path, chunk, data: binary contents in pieces."""
    n = F.greatest(F.ceil(F.octet_length("data") / size), F.lit(1)).cast("int")
    return files.select("path", "data", F.posexplode(F.sequence(F.lit(0), n - 1)).alias("chunk", "_k")).select("path", "chunk", F.expr(f"substring(data, _k * {size} + 1, {size})").alias("data"))


def vfs_walk(files: DataFrame, directory: str = "", max_depth: int | None = None, include_dirs: bool = False) -> DataFrame:
    """path, type, depth below a directory; each directory once."""
    base = len([p for p in directory.split("/") if p])
    out = files.where(under(F.col("path"), directory)).select("path", F.lit("file").alias("type"))
    if include_dirs:
        d = files.where(under(F.col("path"), directory)).select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().where(under(F.col("path"), directory))
        out = out.unionByName(d.select("path", F.lit("directory").alias("type")))
    out = out.withColumn("depth", F.size(F.split("path", "/")) - base)
    return out if max_depth is None else out.where(F.col("depth") <= max_depth)
