"""A repository's tables, and the questions one asks of it by reference and path."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.functions.expressions import lfs_pointer
from treelake.functions.objects import HEX40, TreelakeError
from treelake.operators import blame, diff, graph, grep, paths, reports
from treelake.operators.reports import traced
from treelake.operators.workspace import Workspace
from treelake.sources import repository


@dataclass(frozen=True)
class Pointer:
    """A file that lies in large-file storage: its id there and its size, and the text that says so."""

    oid: str
    size: int
    raw: bytes


@dataclass
class Repo:
    objects: DataFrame  # type, sha, size, content
    refs: DataFrame  # name, kind, sha, target

    @staticmethod
    def open(spark: SparkSession, path: str) -> Repo:
        """A directory with HEAD and objects."""
        import os

        if not os.path.isfile(os.path.join(path, "HEAD")) or not os.path.isdir(os.path.join(path, "objects")):
            raise TreelakeError("not_a_repository", path=path)
        return Repo(repository.objects(spark, path), repository.refs(spark, path))

    @staticmethod
    def tables(spark: SparkSession, folder: str) -> Repo:
        return Repo(spark.read.parquet(f"{folder}/objects"), spark.read.parquet(f"{folder}/refs"))

    @staticmethod
    def promised(spark: SparkSession, folder: str) -> Repo:
        """A lazy or filtered clone, with the objects that it left where they were."""
        from treelake.sources.transfer import promised

        return Repo(promised(spark, folder), spark.read.parquet(f"{folder}/refs"))

    @property
    def spark(self) -> SparkSession:
        return self.objects.sparkSession

    @cached_property
    def commits(self) -> DataFrame:
        return repository.commits(self.objects)

    @cached_property
    def tree_entries(self) -> DataFrame:
        return repository.tree_entries(self.objects)

    @cached_property
    def edges(self) -> DataFrame:
        """src, dst, parent_ix of commits and their parents."""
        return self.commits.select(F.col("sha").alias("src"), F.posexplode("parents").alias("parent_ix", "dst"))

    @cached_property
    def times(self) -> DataFrame:
        return self.commits.select(F.col("sha").alias("id"), F.col("author.time").alias("time"))

    def materialize(self) -> Repo:
        """The same with its tables in memory and on disk of the executors."""
        out = Repo(self.objects.persist(), self.refs.persist())
        out.objects.count()
        return out

    @traced("fs.prefetch")
    def prefetch(self, blobs: bool = True) -> Repo:
        """Trees and commits, and contents if blobs."""
        return Repo((self.objects if blobs else self.objects.where("type <> 'blob'")).persist(), self.refs)

    @traced("fs.prefetch")
    def prefetch_history(self) -> Repo:
        """Commits, trees and tags."""
        return Repo(self.objects.where("type in ('commit', 'tree', 'tag')").persist(), self.refs)

    def resolve(self, ref: str, peel: bool = False) -> str:
        """A commit's, tree's or tag's id by id, name, or short branch or tag name. peel follows tags to what they are of."""
        if HEX40.fullmatch(ref):
            sha = ref
        else:
            names = [ref, f"refs/heads/{ref}", f"refs/tags/{ref}"]
            got = {r.name: r.sha for r in graph.resolve(self.refs).where(F.col("name").isin(names)).collect()}
            sha = next((got[n] for n in names if n in got), None)
            if sha is None:
                raise TreelakeError("not_found", ref=ref)
        while peel:
            tag = repository.tags(self.objects.where(F.col("sha") == sha)).first()
            if tag is None:
                break
            sha = tag.object
        return sha

    def tree(self, ref: str, peel: bool = False) -> str:
        sha = self.resolve(ref, peel)
        kind = self.objects.where(F.col("sha") == sha).select("type").first()
        if kind is None:
            raise TreelakeError("not_found", sha=sha)
        if kind.type == "tree":
            return sha
        if kind.type != "commit":
            raise TreelakeError("not_a_commit_or_tree", sha=sha)
        return self._commit(sha).tree

    def _object(self, sha: str) -> DataFrame:
        """The object of an id; nothing else is decoded."""
        return self.objects.where(F.col("sha") == sha)

    def _commit(self, sha: str):
        return repository.commits(self._object(sha)).first()

    def entries(self, tree: str) -> DataFrame:
        """pos, mode, name, sha of one tree."""
        return repository.tree_entries(self._object(tree)).drop("tree")

    @traced("fs.walk")
    def walk(self, ref: str = "HEAD", under: str = "") -> DataFrame:
        return paths.walk(self.tree_entries, self.spark.createDataFrame([(self.tree(ref),)], "root string"), under).drop("root")

    @traced("fs.glob")
    def glob(self, ref: str, pattern: str) -> DataFrame:
        from treelake.functions.expressions import glob_prefix

        return paths.glob(self.walk(ref, glob_prefix(pattern)), pattern)

    def files(self, ref: str = "HEAD", text: bool = True) -> DataFrame:
        """path, mode, sha, data; each content is read once and joined to its paths."""
        blobs = self.objects.where("type = 'blob'").select("sha", (F.decode("content", "UTF-8") if text else F.col("content")).alias("data"))
        return self.walk(ref).join(blobs, "sha").select("path", "mode", "sha", "data")

    @traced("fs.ls")
    def ls(self, ref: str = "HEAD", directory: str = "") -> DataFrame:
        """Entries of one directory, by following one tree for each name."""
        at = self.tree(ref)
        for name in [p for p in directory.split("/") if p]:
            e = self.entries(at).where(F.col("name") == name).orderBy("pos").first()
            if e is None:
                raise TreelakeError("not_found", path=directory)
            if e.mode != "40000":
                raise TreelakeError("not_a_tree", path=directory)
            at = e.sha
        return self.entries(at).orderBy("pos").select("name", "mode", "sha")

    def _entry(self, ref: str, path: str):
        parts = [p for p in path.split("/") if p]
        return self.ls(ref, "/".join(parts[:-1])).where(F.col("name") == parts[-1]).first() if parts else None

    @traced("fs.stat")
    def stat(self, ref: str, path: str) -> dict[str, object]:
        """type, mode, sha, and size (of what has contents here)."""
        if not [p for p in path.split("/") if p]:
            return {"type": "tree", "mode": "40000", "sha": self.tree(ref), "size": None}
        e = self._entry(ref, path)
        if e is None:
            raise TreelakeError("not_found", path=path)
        kind = {"40000": "tree", "160000": "submodule", "120000": "symlink"}.get(e.mode, "blob")
        size = self._object(e.sha).select("size").first() if kind in ("blob", "symlink") else None
        return {"type": kind, "mode": e.mode, "sha": e.sha, "size": size.size if size else None}

    def exists(self, ref: str, path: str) -> bool:
        try:
            return bool(self.stat(ref, path))
        except TreelakeError as e:
            if e.code not in ("not_found", "not_a_tree"):
                raise
            return False

    @traced("fs.read_lines")
    def read_lines(self, ref: str, path: str, first: int = 1, last: int | None = None, chosen: list[int] | None = None) -> list[tuple[int, str]]:
        data = self.read(ref, path)[1].decode("utf-8", "replace")
        one = self.spark.createDataFrame([(path, data)], "path string, data string")
        return [(r.line_number, r.line) for r in paths.read_lines(one, first, last, chosen).orderBy("line_number").collect()]

    @traced("fs.read_path")
    def read(self, ref: str, path: str, resolve_lfs_pointers: bool = False) -> tuple[str, bytes | Pointer]:
        """mode and content; or, if asked for, the pointer that the content is."""
        e = self._entry(ref, path)
        if e is None:
            raise TreelakeError("not_found", path=path)
        if e.mode in ("40000", "160000"):
            raise TreelakeError("not_a_blob", path=path)
        content = bytes(self._object(e.sha).first().content)
        if resolve_lfs_pointers and len(content) <= 1024:
            p = self.spark.createDataFrame([(content.decode("latin-1"),)], "t string").select(lfs_pointer(F.col("t")).alias("p")).first().p
            if p is not None:
                return e.mode, Pointer(p.oid, p.size, content)
        return e.mode, content

    @traced("fs.grep")
    def grep(self, ref: str, pattern: str, **options) -> DataFrame:
        """Matching lines; of each content once, whatever the number of its paths."""
        return grep.grep_blobs(*self._searched(ref), pattern, **options)

    @traced("fs.multi_grep")
    def multi_grep(self, ref: str, patterns: grep.Patterns, **options) -> DataFrame:
        """A row for each match of each pattern."""
        found, blobs = self._searched(ref)
        hits = grep.multi_grep_matches(blobs.withColumnRenamed("sha", "path"), patterns, **options).withColumnRenamed("path", "sha")
        return found.join(hits, "sha").drop("sha")

    def _searched(self, ref: str) -> tuple[DataFrame, DataFrame]:
        found = self.walk(ref).where("mode <> '160000'").select("path", "sha")
        return found, self.objects.where("type = 'blob'").join(found.select("sha").distinct(), "sha", "left_semi").select("sha", F.decode("content", "UTF-8").alias("data"))

    @traced("walk.ancestors")
    def ancestors(self, ref: str = "HEAD", order: str = "date", most: int | None = None) -> DataFrame:
        """ord, sha."""
        start = self.resolve(ref)
        c = self.commits.select(F.lit("r").alias("repo"), "sha", "parents", F.col("author.time").alias("time"))
        return graph.ordered_walk(c, self.spark.createDataFrame([("r", start)], "repo string, start string"), order, most).drop("repo")

    @traced("walk.merge_base")
    def merge_base(self, *refs: str) -> str | None:
        return graph.merge_base(self.edges.select("src", "dst"), self.times, [self.resolve(r) for r in refs])

    @traced("diff.trees")
    def diff(self, old: str, new: str) -> DataFrame:
        return diff.diff_trees(self.tree_entries, self.tree(old), self.tree(new))

    @traced("blame.lines")
    def blame(self, ref: str, path: str) -> DataFrame:
        """line_number, line, commit, author_name, author_email, author_time, summary."""
        chain = graph.first_parents(self.edges, self.spark.createDataFrame([(self.resolve(ref),)], "id string"))
        trees = self.commits.join(chain, F.col("sha") == F.col("id")).select("sha", F.col("tree").alias("at"))
        parts = [p for p in path.split("/") if p]
        e = self.tree_entries.select(F.col("tree").alias("_tree"), "name", F.col("sha").alias("_sha"))
        for name in parts:
            trees = trees.join(e.where(F.col("name") == name), F.col("at") == F.col("_tree")).select("sha", F.col("_sha").alias("at"))
        blobs = self.objects.where("type = 'blob'").select(F.col("sha").alias("_blob"), F.decode("content", "UTF-8").alias("text"))
        # the chain's order is its own: the first parent of each is the next older one
        first = self.commits.select(F.lit("r").alias("repo"), "sha", F.slice("parents", 1, 1).alias("parents"), F.col("author.time").alias("time"))
        order = graph.ordered_walk(first, self.spark.createDataFrame([("r", self.resolve(ref))], "repo string, start string"), "topo")
        number = order.select("sha", (-F.col("ord")).alias("version"))
        history = trees.join(blobs, F.col("at") == F.col("_blob")).join(number, "sha").select(F.lit(path).alias("file"), "version", "text")
        meta = self.commits.join(number, "sha").select("version", F.col("sha").alias("commit"), F.col("author.name").alias("author_name"), F.col("author.email").alias("author_email"), F.col("author.time").alias("author_time"), F.substring_index("message", "\n", 1).alias("summary"))
        return blame.with_commits(blame.blame(history), meta).drop("file", "version")

    def workspace(self, ref: str = "HEAD") -> Workspace:
        return Workspace(self.files(ref, text=False), restorable=lambda sha: self.files(sha, text=False))

    def memory_report(self) -> DataFrame:
        return reports.memory_report(self.objects)

    def store_report(self, mode: str = "eager", backend: str = "tables") -> DataFrame:
        return reports.store_report(self.objects, mode, backend)

    def prefetch_async(self, blobs: bool = True) -> Prefetch:
        """Trees and commits, then contents, in a thread; what is there already can be used meanwhile."""
        return Prefetch(self, blobs)


class Prefetch:
    """A prefetch that runs: await it, or cancel its jobs."""

    def __init__(self, repo: Repo, blobs: bool):
        self.repo, self.tag, self.error = repo, f"prefetch-{uuid.uuid4().hex}", None
        self.result: Repo | None = None
        self.cancelled = threading.Event()
        self.thread = InheritableThread(target=self._run, args=(blobs,))
        self.thread.start()

    def _run(self, blobs: bool) -> None:
        spark = self.repo.spark
        spark.addTag(self.tag)
        try:
            for stage in (False, True)[: 1 + blobs]:
                if self.cancelled.is_set():
                    return
                now = self.repo.prefetch(stage)
                now.objects.count()
                self.result = now
        except Exception as e:  # told to who awaits it
            self.error = e
        finally:
            spark.removeTag(self.tag)

    def wait(self, timeout: float | None = None) -> Repo:
        self.thread.join(timeout)
        if self.thread.is_alive():
            raise TreelakeError("timeout")
        if self.cancelled.is_set():
            raise TreelakeError("cancelled")
        if self.error is not None:
            raise self.error
        return self.result

    def cancel(self) -> None:
        self.cancelled.set()
        self.repo.spark.interruptTag(self.tag)
        self.thread.join()


class Handle:
    """A repository that several threads of a driver share: reads take what is there, updates come one after the other, and a value that
    several want is made once."""

    def __init__(self, repo: Repo):
        self._repo, self._lock, self._values, self._making = repo, threading.RLock(), {}, {}

    def get(self) -> Repo:
        return self._repo

    def update(self, change: Callable[[Repo], Repo]) -> Repo:
        with self._lock:
            self._repo = change(self._repo)
            return self._repo

    def fetch_once(self, key: str, make: Callable[[Repo], object]) -> object:
        """The value of a key; a failure isn't kept."""
        with self._lock:
            one = self._making.setdefault(key, threading.Lock())
        with one:
            if key not in self._values:
                self._values[key] = make(self._repo)
            return self._values[key]


class Registry:
    """Handles by address."""

    def __init__(self):
        self._handles, self._lock, self._opening = {}, threading.Lock(), {}

    def get_or_start(self, url: str, start: Callable[[str], Repo]) -> Handle:
        with self._lock:
            one = self._opening.setdefault(url, threading.Lock())
        with one:
            if url not in self._handles:
                self._handles[url] = Handle(start(url))
            return self._handles[url]

    def lookup(self, url: str) -> Handle:
        if url not in self._handles:
            raise TreelakeError("not_found", url=url)
        return self._handles[url]

    def stop(self, url: str) -> bool:
        with self._lock:
            return self._handles.pop(url, None) is not None

    def count(self) -> int:
        return len(self._handles)

    def list(self) -> list[str]:
        return sorted(self._handles)
