"""Reports: what a store holds, profiles of events, index fan-out, what a bounded cache keeps."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import ExitStack, contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field
from functools import wraps
from time import perf_counter, time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treelake.functions.objects import TreelakeError
from treelake.operators.graph import shared_table


def memory_report(objects: DataFrame) -> DataFrame:
    """type, object_count, total_bytes of a table with type and size."""
    return objects.groupBy("type").agg(F.count("*").alias("object_count"), F.sum("size").alias("total_bytes"))


def store_report(objects: DataFrame, mode: str, backend: str, most_bytes: int | None = None) -> DataFrame:
    """One row: object_count, cache_bytes, commits, trees, blobs, tags, max_cache_bytes, mode, backend."""
    kinds = [F.count_if(F.col("type") == k).alias(k + "s") for k in ("commit", "tree", "blob", "tag")]
    fixed = [F.lit(most_bytes).cast("long").alias("max_cache_bytes"), F.lit(mode).alias("mode"), F.lit(backend).alias("backend")]
    return objects.agg(F.count("*").alias("object_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("cache_bytes"), *kinds).select("*", *fixed)


def profile_totals(events: DataFrame) -> DataFrame:
    """event, n, total_us, and where events have cache_bytes their greatest value as peak_cache_bytes. events: event, duration_us."""
    peak = [F.max("cache_bytes").alias("peak_cache_bytes")] if "cache_bytes" in events.columns else []
    return events.groupBy("event").agg(F.count("*").alias("n"), F.sum("duration_us").alias("total_us"), *peak)


def percentiles(events: DataFrame, at: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Exact percentiles of duration_us by event, with least and most."""
    p = [F.percentile("duration_us", F.lit(x)).alias(f"p{round(100 * x)}") for x in at]
    return events.groupBy("event").agg(*p, F.min("duration_us").alias("least"), F.max("duration_us").alias("most"))


def near_percentiles(events: DataFrame, at: tuple[float, ...] = (0.5, 0.95), accuracy: int = 10_000) -> DataFrame:
    """The same with values whose rank is off by at most 1 / accuracy of the rows, from sketches that are merged; memory doesn't grow with
    the number of distinct values."""
    p = [F.percentile_approx("duration_us", F.lit(x), F.lit(accuracy)).alias(f"p{round(100 * x)}") for x in at]
    return events.groupBy("event").agg(*p, F.min("duration_us").alias("least"), F.max("duration_us").alias("most"))


def fanout(ids: DataFrame) -> DataFrame:
    """first_byte, n, running: numbers of ids (sha, hex) by first byte. At most 256 rows are in the window."""
    n = ids.groupBy(F.conv(F.substring("sha", 1, 2), 16, 10).cast("int").alias("first_byte")).agg(F.count("*").alias("n"))
    return n.withColumn("running", F.sum("n").over(Window.orderBy("first_byte").rowsBetween(Window.unboundedPreceding, 0)))


def cache_keeps(entries: DataFrame, most_bytes: int, by: str = "cache") -> DataFrame:
    """Entries (cache, at, size) that a cache of so many bytes holds when the oldest leave first: the longest run of newest ones that fits.
    Sums run in ranges of (cache, at), and are shifted by those of the newer ranges of the cache, so that no task has a whole cache. Of
    ranges that the cache can't reach only the sum is read."""
    t = entries.repartitionByRange(F.col(by), F.desc("at"))
    t = shared_table(t.withColumn("_part", F.spark_partition_id()))
    sums = t.groupBy(by, "_part").agg(F.sum("size").alias("_sum"))
    newer = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    shift = sums.select(by, "_part", F.coalesce(F.sum("_sum").over(newer), F.lit(0)).alias("_shift")).where(F.col("_shift") <= most_bytes)
    w = Window.partitionBy(by, "_part").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    out = t.join(shift, [by, "_part"]).withColumn("kept_bytes", F.sum("size").over(w) + F.col("_shift"))
    return out.select(*entries.columns, "kept_bytes").where(F.col("kept_bytes") <= most_bytes)


POLICIES = ("evict", "error")


def bounded(entries: DataFrame, most_bytes: int, policy: str | Callable[[int, int], None] = "evict", by: str = "cache") -> DataFrame:
    """What caches of so many bytes hold by policy: the oldest leave; or it is an error if any has more; or a function is told how many
    caches have more and by how many bytes in all, and nothing leaves."""
    if policy == "evict":
        return cache_keeps(entries, most_bytes, by).drop("kept_bytes")
    over = entries.groupBy(by).agg((F.sum("size") - most_bytes).alias("over")).where("over > 0").agg(F.count("*").alias("n"), F.sum("over").alias("bytes")).first()
    if over.n and policy == "error":
        raise TreelakeError("cache_full", caches=over.n, over=over.bytes)
    if over.n and callable(policy):
        policy(over.n, over.bytes)
    return entries


ACTIVE: ContextVar[tuple["Profiler", ...]] = ContextVar("profilers", default=())
EVENTS = (
    "fs.read_path", "fs.ls", "fs.stat", "fs.walk", "fs.glob", "fs.grep", "fs.multi_grep", "fs.read_lines", "fs.prefetch", "walk.ancestors", "walk.merge_base", "diff.trees", "blame.lines",
    "workspace.commit", "workspace.checkout", "transfer.clone", "transfer.fetch", "transfer.push",
)


def traced(event: str):
    """A function whose calls are spans of the attached profilers. A span is the time on the driver, until the answer or its plan is there."""

    def wrap(f):
        @wraps(f)
        def call(*args, **options):
            with ExitStack() as spans:
                for p in ACTIVE.get():
                    spans.enter_context(p.span(event, **{k: v for k, v in options.items() if isinstance(v, (str, int))}))
                return f(*args, **options)

        return call

    return wrap


@dataclass
class Profiler:
    """Spans of the driver's operations: `with profiler.span("walk", path=p)`. Handlers see each event as it ends."""

    rows: list[tuple[str, int, dict[str, str], float]] = field(default_factory=list)
    handlers: list[Callable[[str, int, dict[str, str]], None]] = field(default_factory=list)

    @contextmanager
    def span(self, event: str, **metadata: object):
        began, start = time(), perf_counter()
        meta = {k: str(v) for k, v in metadata.items()}
        try:
            yield meta
        finally:
            took = int(1e6 * (perf_counter() - start))
            self.rows.append((event, took, meta, began))
            for h in self.handlers:
                h(event, took, meta)

    def attach(self) -> Profiler:
        """Sees the calls of this thread (and of what it starts with its context) until it is detached."""
        ACTIVE.set((*ACTIVE.get(), self))
        return self

    def detach(self) -> list[tuple[str, int, dict[str, str], float]]:
        """Events in the order of their beginnings."""
        ACTIVE.set(tuple(p for p in ACTIVE.get() if p is not self))
        return sorted(self.rows, key=lambda r: r[3])

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "event string, duration_us long, metadata map<string,string>, started_at double")
