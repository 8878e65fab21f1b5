"""Copy-on-write workspaces over a table of files: an overlay of writes and removals, snapshots that are tree ids, and commits."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelake.functions.expressions import object_id as id_of
from treelake.functions.objects import Commit, Entry, TreelakeError, decode_commit, encode_commit, encode_tree, entry_name_error, new_tree, object_id
from treelake.operators.diff import diff_files, workspace_changes
from treelake.operators.paths import ls, under
from treelake.operators.reports import traced

FILES = "path string, mode string, sha string, data binary"


def parts(path: str) -> list[str]:
    out = [p for p in path.split("/") if p]
    if not out or any(entry_name_error(p.encode()) for p in out):
        raise TreelakeError("invalid_path", path=path)
    return out


@dataclass
class Workspace:
    """base: path, mode, sha, data (binary). Edits stay on the driver until they are read; `tree()` is the id of what is visible."""

    base: DataFrame
    edits: dict[str, tuple[str, bytes] | None] = field(default_factory=dict)
    removed_dirs: tuple[str, ...] = ()
    snapshots: dict[str, Workspace] = field(default_factory=dict, repr=False)  # by tree, shared by all that came of one
    restorable: Callable[[str], DataFrame] | None = field(default=None, repr=False)  # files of a tree that is no snapshot

    def files(self) -> DataFrame:
        spark = self.base.sparkSession
        out = self.base
        if self.edits:
            touched = spark.createDataFrame([(p,) for p in self.edits], "path string")
            out = out.join(F.broadcast(touched), "path", "left_anti")  # a user's edits, which the driver holds
        for d in self.removed_dirs:
            out = out.where(~F.col("path").startswith(d + "/"))
        written = [(p, e[0], object_id("blob", e[1]), e[1]) for p, e in self.edits.items() if e is not None]
        return out.unionByName(spark.createDataFrame(written, FILES)) if written else out

    def _is_dir(self, path: str) -> bool:
        return not self.files().where(F.col("path").startswith(path + "/")).isEmpty()

    def exists(self, path: str) -> bool:
        p = "/".join(parts(path))
        return not self.files().where((F.col("path") == p) | F.col("path").startswith(p + "/")).isEmpty()

    def read(self, path: str) -> bytes:
        got = self.files().where(F.col("path") == "/".join(parts(path))).select("data").collect()
        if not got:
            raise TreelakeError("not_found", path=path)
        return bytes(got[0].data)

    def write(self, path: str, data: bytes, mode: str = "100644") -> Workspace:
        p = "/".join(parts(path))
        if self._is_dir(p):
            raise TreelakeError("is_directory", path=path)
        return replace(self, edits={**self.edits, p: (mode, data)})

    def rm(self, path: str, recursive: bool = False) -> Workspace:
        p = "/".join(parts(path))
        if not self.exists(p):
            raise TreelakeError("not_found", path=path)
        if not self._is_dir(p):
            return replace(self, edits={**self.edits, p: None})
        if not recursive:
            raise TreelakeError("is_directory", path=path)
        return replace(self, edits={k: e for k, e in self.edits.items() if not k.startswith(p + "/")}, removed_dirs=(*self.removed_dirs, p))

    def walk(self, directory: str = "") -> DataFrame:
        """path, mode, sha of files, in byte order."""
        return self.files().where(under(F.col("path"), directory)).select("path", "mode", "sha").orderBy("path")

    def ls(self, directory: str = "") -> DataFrame:
        out = ls(self.files(), directory)
        if directory.strip("/") and out.isEmpty():
            raise TreelakeError("not_a_tree" if self.exists(directory) else "not_found", path=directory)
        return out

    def stat(self, path: str) -> dict[str, object]:
        """type, mode and size."""
        p = "/".join(parts(path))
        got = self.files().where(F.col("path") == p).select("mode", F.octet_length("data").alias("size")).collect()
        if got:
            return {"type": {"160000": "submodule", "120000": "symlink"}.get(got[0].mode, "blob"), "mode": got[0].mode, "size": got[0].size}
        if self._is_dir(p):
            return {"type": "tree", "mode": "40000", "size": None}
        raise TreelakeError("not_found", path=path)

    def snapshot(self) -> str:
        """The tree's id, or "pristine" where nothing was changed; restore takes it."""
        if not self.edits and not self.removed_dirs:
            return "pristine"
        sha = self.tree()
        self.snapshots[sha] = replace(self)
        return sha

    def restore(self, snapshot: str) -> Workspace:
        """The workspace as it was, or with the files of any tree of the repository."""
        if snapshot == "pristine":
            return replace(self, edits={}, removed_dirs=())
        if snapshot in self.snapshots:
            return self.snapshots[snapshot]
        if self.restorable is None:
            raise TreelakeError("not_found", snapshot=snapshot)
        now = self.restorable(snapshot)
        gone = self.base.select("path").join(now.select("path"), "path", "left_anti")
        new = now.join(self.base.select("path", "sha", "mode"), ["path", "sha", "mode"], "left_anti")
        edits: dict[str, tuple[str, bytes] | None] = {r.path: None for r in gone.collect()}  # a workspace's edits lie on the driver
        return replace(self, edits=edits | {r.path: (r.mode, bytes(r.data)) for r in new.collect()}, removed_dirs=())

    @traced("workspace.checkout")
    def checkout(self, folder: str) -> int:
        """Writes all files under a folder that all executors share; links as links. The number of files."""
        return checkout(self.files(), folder)

    def diff(self) -> DataFrame:
        return workspace_changes(diff_files(self.base, self.files()))

    def tree(self) -> str:
        return root_id(self.files())

    def commit(self, parents: list[str], base_tree: str | None, author: str, message: str) -> tuple[str, bytes]:
        """Id and bytes; the message ends with a line feed."""
        tree = self.tree()
        if tree == base_tree:
            raise TreelakeError("nothing_to_commit")
        headers = [("tree", tree), *[("parent", p) for p in parents], ("author", author), ("committer", author)]
        content = encode_commit(Commit(headers, message if message.endswith("\n") else message + "\n"))
        return object_id("commit", content), content


    @traced("workspace.commit")
    def commit_to(self, path: str, ref: str, author: str, message: str) -> str:
        """Writes the commit with its trees and new contents into a repository's directory, and moves a reference by compare and swap. The
        reference's commit is the parent; one that isn't there yet is made without."""
        from treelake.sources.repository import put_object, read_object, read_refs, write_ref

        now = next((s for n, _, s, _ in read_refs(path) if n == ref), None)
        base_tree = None
        if now is not None:
            kind, content = read_object(path, now)
            base_tree = decode_commit(content).tree if kind == "commit" else None
        sha, content = self.commit([now] if base_tree is not None else [], base_tree, author, message)
        for e in self.edits.values():
            if e is not None:
                put_object(path, "blob", e[1])
        files = self.files()
        if base_tree is None:  # nothing is there that the trees could refer to
            _put_all(files.select(F.lit("blob").alias("type"), F.col("data").alias("content")), path)
        _put_all(trees(files.select("path", "mode", "sha")).select(F.lit("tree").alias("type"), "content"), path)
        put_object(path, "commit", content)
        write_ref(path, ref, sha, expected=now)
        return sha


def _put_all(objects: DataFrame, path: str) -> int:
    from treelake.sources.repository import put_object

    def run(it):
        for pdf in it:
            yield pd.DataFrame({"sha": [put_object(path, k, bytes(c)) for k, c in zip(pdf["type"], pdf["content"])]})

    return objects.distinct().mapInPandas(run, "sha string").count()


def checkout(files: DataFrame, folder: str) -> int:
    """Each file is written by a task, under its name only when it is whole, so that a task may run again. files: path, mode, data."""

    def run(it):
        for pdf in it:
            for path, mode, data in zip(pdf["path"], pdf["mode"], pdf["data"]):
                at = os.path.join(folder, *parts(path))
                if mode == "160000":
                    os.makedirs(at, exist_ok=True)
                    continue
                os.makedirs(os.path.dirname(at), exist_ok=True)
                if mode == "120000":
                    os.symlink(bytes(data), at.encode() + b".new")
                else:
                    with open(at + ".new", "wb") as f:
                        f.write(bytes(data))
                    os.chmod(at + ".new", 0o755 if mode == "100755" else 0o644)
                os.replace(at + ".new", at)
            yield pd.DataFrame({"n": [len(pdf)]})

    return files.select("path", "mode", "data").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _directory(pdf: pd.DataFrame) -> tuple[str, bytes]:
    content = encode_tree(new_tree([Entry(m, n.encode(), s) for m, n, s in zip(pdf["mode"], pdf["name"], pdf["sha"])]))
    return object_id("tree", content), content


def trees(files: DataFrame) -> DataFrame:
    """dir, sha, content of the tree of each directory, from the bottom up: one grouped job for each level of depth. files: path, mode, sha."""
    spark, schema = files.sparkSession, "dir string, sha string, content binary"

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *_directory(pdf))], columns=["dir", "sha", "content"])

    split = F.split("path", "/")
    base = files.select(F.array_join(F.slice(split, F.lit(1), F.size(split) - 1), "/").alias("dir"), F.element_at(split, -1).alias("name"), "mode", "sha", (F.size(split) - 1).alias("depth"))
    deepest = base.agg(F.max("depth")).first()[0]
    out = above = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        here = base.where(F.col("depth") == depth).select("dir", "name", "mode", "sha")
        if above is not None:
            d = F.split("dir", "/")
            here = here.unionByName(above.select(F.array_join(F.slice(d, F.lit(1), F.size(d) - 1), "/").alias("dir"), F.element_at(d, -1).alias("name"), F.lit("40000").alias("mode"), "sha"))
        above = here.groupBy("dir").applyInPandas(build, schema)
        out = above if out is None else out.unionByName(above)
    return out if out is not None else spark.createDataFrame([("", object_id("tree", b""), b"")], schema)


def root_id(files: DataFrame) -> str:
    return trees(files).where("dir = ''").select("sha").first().sha


def blob_table(files: DataFrame) -> DataFrame:
    """files with the id of their data (binary)."""
    return files.withColumn("sha", id_of("blob", F.col("data")))
