"""A workspace as a file system with absolute paths and the usual error names. Nothing is changed in place: writing and removing give
another file system."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelake.functions.objects import TreelakeError
from treelake.operators import grep, paths
from treelake.operators.workspace import Workspace

NAMES = {"not_found": "enoent", "is_directory": "eisdir", "not_a_blob": "eisdir", "not_a_tree": "enotdir", "not_directory": "enotdir", "invalid_path": "einval"}
CAPABILITIES = frozenset(("read", "write", "lazy"))


def clean(path: str) -> str:
    """Without empty parts and dots; .. doesn't lead above the root."""
    out: list[str] = []
    for p in path.split("/"):
        if p == "..":
            out = out[:-1]
        elif p not in ("", "."):
            out.append(p)
    return "/".join(out)


@dataclass(frozen=True)
class FileSystem:
    workspace: Workspace

    def _try(self, path: str, f: Callable):
        try:
            return f(clean(path))
        except TreelakeError as e:
            raise TreelakeError(NAMES.get(e.code, "eio"), path="/" + clean(path), why=e.code) from e

    def capabilities(self) -> frozenset[str]:
        return CAPABILITIES

    def exists(self, path: str) -> bool:
        return self._try(path, lambda p: p == "" or self.workspace.exists(p))

    def stat(self, path: str) -> dict[str, object]:
        """type (regular, directory, symlink or submodule), size and mtime, which trees don't have: 0."""
        if not clean(path):
            return {"type": "directory", "size": 0, "mtime": 0}
        got = self._try(path, self.workspace.stat)
        return {"type": {"blob": "regular", "tree": "directory"}.get(got["type"], got["type"]), "size": got["size"] or 0, "mtime": 0}

    def readdir(self, path: str = "/") -> list[str]:
        return [r.name for r in self._try(path, self.workspace.ls).collect()]

    def read_file(self, path: str) -> bytes:
        return self._try(path, self._read)

    def _read(self, path: str) -> bytes:
        if self.stat(path)["type"] == "directory":
            raise TreelakeError("is_directory", path=path)
        return self.workspace.read(path)

    def stream_read(self, path: str, byte_range: tuple[int, int | None] | None = None, line_range: tuple[int, int | None] | None = None, size: int = 65536) -> DataFrame:
        """chunk, data."""
        if self.stat(path)["type"] == "directory":
            raise TreelakeError("eisdir", path="/" + clean(path))
        return self._try(path, lambda p: paths.stream_read(self.workspace.files(), p, byte_range, line_range, size))

    def walk(self, path: str = "/", max_depth: int | None = None, include_dirs: bool = False) -> DataFrame:
        return paths.vfs_walk(self.workspace.files(), clean(path), max_depth, include_dirs)

    def grep(self, pattern: str, path_glob: str | None = None, **options) -> DataFrame:
        """A row for each match."""
        text = self.workspace.files().where("mode <> '160000'").select("path", F.decode("data", "UTF-8").alias("data"))
        return grep.grep_matches(text, pattern, path_glob=path_glob, **options)

    def write_file(self, path: str, data: bytes) -> FileSystem:
        return self._try(path, lambda p: FileSystem(self.workspace.write(p, data)))

    def rm(self, path: str, recursive: bool = False) -> FileSystem:
        if not clean(path):
            raise TreelakeError("einval", path="/", why="the root stays")
        return self._try(path, lambda p: FileSystem(self.workspace.rm(p, recursive)))

    def mkdir(self, path: str) -> FileSystem:
        raise TreelakeError("enotsup", path="/" + clean(path), why="trees hold no empty directories")

    def materialize(self, folder: str) -> int:
        return self._try("/", lambda _: self.workspace.checkout(folder))
