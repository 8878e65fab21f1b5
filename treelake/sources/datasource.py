"""A Spark data source over repository directories: spark.dataSource.register(RepositorySource), then
spark.read.format("treelake").option("table", "objects").load(path). Tables: objects, refs, index. A folder's packs and its 256 parts of
loose objects are partitions of their own. STORES takes openers of other addresses by scheme, which `load` knows; Spark makes readers in
processes of their own, where what was added to STORES isn't there."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from treelake.functions.objects import HEX40, TreelakeError, object_id
from treelake.sources.pack import OBJECTS, read_pack
from treelake.sources.repository import REFS, decode_loose, parse_index, read_refs

INDEX = "pos int, name string, sha string, mode int, stage int, size long"
SCHEMAS = {"objects": OBJECTS, "refs": REFS, "index": INDEX}
#: scheme: a function from an address to a directory that all executors can read
STORES: dict[str, Callable[[str], str]] = {"file": lambda url: "/" + url.removeprefix("file:").lstrip("/")}


def open_store(address: str) -> str:
    scheme, sep, _ = address.partition(":")
    if not sep or "/" in scheme:
        return address
    if scheme not in STORES:
        raise TreelakeError("unknown_scheme", scheme=scheme)
    return STORES[scheme](address)


def load(spark: SparkSession, table: str, address: str) -> DataFrame:
    """A table of a repository at an address, which the driver resolves."""
    spark.dataSource.register(RepositorySource)
    return spark.read.format("treelake").option("table", table).load(open_store(address))


@dataclass
class Part(InputPartition):
    kind: str
    path: str


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "treelake"

    def _table(self) -> str:
        table = self.options.get("table", "objects")
        if table not in SCHEMAS:
            raise TreelakeError("unknown_table", table=table)
        return table

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema) -> RepositoryReader:
        return RepositoryReader(self._table(), open_store(self.options["path"]))


class RepositoryReader(DataSourceReader):
    def __init__(self, table: str, path: str):
        self.table, self.path = table, path

    def partitions(self) -> list[Part]:
        if self.table != "objects":
            return [Part(self.table, self.path)]
        objects = os.path.join(self.path, "objects")
        packs = os.path.join(objects, "pack")
        out = [Part("pack", os.path.join(packs, f)) for f in (sorted(os.listdir(packs)) if os.path.isdir(packs) else []) if f.endswith(".pack")]
        return out + [Part("loose", os.path.join(objects, d)) for d in sorted(os.listdir(objects)) if len(d) == 2]

    def read(self, part: Part) -> Iterator[tuple]:
        if part.kind == "refs":
            yield from read_refs(part.path)
        elif part.kind == "index":
            with open(os.path.join(part.path, "index"), "rb") as f:
                for k, e in enumerate(parse_index(f.read())):
                    yield k, e.name.decode("utf-8", "replace"), e.sha, e.mode, e.stage, e.size
        elif part.kind == "pack":
            with open(part.path, "rb") as f:
                for o in read_pack(f.read()):
                    yield o.type, o.sha, len(o.content), o.content
        else:
            for name in sorted(os.listdir(part.path)):
                sha = os.path.basename(part.path) + name
                if HEX40.fullmatch(sha):
                    with open(os.path.join(part.path, name), "rb") as f:
                        kind, content = decode_loose(f.read())
                    if object_id(kind, content) != sha:
                        raise TreelakeError("id_mismatch", name=sha)
                    yield kind, sha, len(content), content
