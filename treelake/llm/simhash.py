"""Near duplicates by SimHash, with generalised pigeonhole candidates.

Fingerprints that differ in at most `distance` bits are linked. Rows are first reduced to distinct fingerprints. The 64 bits are
grouped into m partitions of correlated bits, and thresholds t_i >= -1 with sum distance - m + 1 are allocated: two fingerprints
within `distance` agree on some partition up to t_i bits. A dynamic program chooses them, for each m, by estimated candidates and
probes. Every fingerprint is indexed by its bits of each partition and probes with all values within t_i; candidates are verified in
the join, and a pair counts only in the first partition that finds it. Where a value of a partition is shared by more than `hot`
fingerprints, these are split once more by the other bits: fingerprints that differ in at most `distance` of them agree on one of
distance + 1 parts. Components come from alternating large-star and small-star rounds. No copies are expanded into pairs. Keys with over
a hundredth of all rows (a common text, the centre of a star), of which there are at most a hundred, are joined by broadcast.

Defined cases: a null text is empty; a text without words has fingerprint 0, linked like any other; repeated rows count as documents
of their own in near_duplicates, and keep_one keeps one of rows with equal id and text; a group's representative is its smallest doc_id;
an empty table gives an empty result; other columns, whatever their names, are kept by keep_one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake.llm.common import cut, map_batches, rows_batch, texts, unused

BITS = 64


def fingerprint(text: str | None, span: int = 3) -> int:
    """Unsigned SimHash of the text's word shingles, repeats included."""
    words = (text or "").encode("utf-8").lower().split()
    n = len(words)
    if n <= span:
        return xxhash.xxh64_intdigest(b" ".join(words), 42) if n else 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[: n - span] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[span - 1 :].tolist())], "<u8")
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 4096):
        ones += np.unpackbits(h[k : k + 4096].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame) -> DataFrame:
    """doc_id and its fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return rows_batch(schema, [b.column(0), np.array([fingerprint(t.as_py()) for t in b.column(1)], "<u8").view("<i8")])

    return map_batches(texts(df), run, "doc_id long, fp long")


def _groups(bits: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near equal size that keep correlated bits together."""
    sure = bits.std(axis=0) > 0 if len(bits) > 2 else np.zeros(BITS, bool)
    c = np.zeros((BITS, BITS))
    if len(bits) > 2 and sure.any():
        c[np.ix_(sure, sure)] = np.abs(np.corrcoef(bits[:, sure], rowvar=False)).reshape(sure.sum(), sure.sum())
    free, out = set(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        seed = max(sorted(free), key=lambda b: c[b, sorted(free)].sum())
        group = [seed]
        free.remove(seed)
        while len(group) < size:
            best = max(sorted(free), key=lambda b: c[b, group].sum())
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def _within(differ: np.ndarray, most: int) -> list[float]:
    """P(at most t of independent bits differ), t from 0 to most."""
    p = np.zeros(len(differ) + 1)
    p[0] = 1
    for q in differ:
        p[1:] = p[1:] * (1 - q) + p[:-1] * q
        p[0] *= 1 - q
    return np.cumsum(p)[: most + 1].tolist()


def allocate(bits: np.ndarray, n: int, distance: int = 3, probe_cost: float = 30.0) -> list[tuple[list[int], int]]:
    """Partitions and thresholds of least estimated cost for n fingerprints, from a sample's bits (a row each, 0 or 1)."""
    p = bits.mean(axis=0) if len(bits) else np.full(BITS, 0.5)
    differ = np.maximum(2 * p * (1 - p), 1e-6)
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for m in range(1, 2 * (distance + 1)):
        groups, total = _groups(bits, m), distance - m + 1
        # least cost of the first groups by the sum of their thresholds
        costs: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for g in groups:
            near = _within(differ[g], distance)
            nxt: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (cost, ts) in costs.items():
                for t in range(-1, distance + 1):
                    balls = sum(comb(len(g), k) for k in range(t + 1))
                    if balls > 3000:
                        break
                    mine = 0.0 if t < 0 else n * n / 2 * near[t] + probe_cost * n * (balls + 1)
                    if cost + mine < nxt.get(s + t, (float("inf"),))[0]:
                        nxt[s + t] = (cost + mine, (*ts, t))
            costs = nxt
        if total in costs and costs[total][0] < best[0]:
            best = (costs[total][0], [(g, t) for g, t in zip(groups, costs[total][1]) if t >= 0])
    return best[1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(bits: list[int] | tuple[int, ...]) -> int:
    return _signed(sum(1 << b for b in bits))


def _probe(own: Column, part: Column):
    return lambda flip: F.struct(part.alias("part"), own.bitwiseXOR(flip).alias("sig"))


def _other_parts(g: list[int], distance: int) -> list[int]:
    """Masks of distance + 1 parts of the bits that aren't in g."""
    rest = [b for b in range(BITS) if b not in g]
    return [_mask(rest[i :: distance + 1]) for i in range(distance + 1)]


def links(distinct: DataFrame, distance: int = 3, sample: int = 5000, hot: int = 2000) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) that differ in at most `distance` bits, each once. The sample only decides
    how candidates are found, and hot how they are spread."""
    rows = distinct.where(F.xxhash64("fp") % 4 == 0).select("fp").limit(sample).collect()
    bits = np.unpackbits(np.array([r.fp for r in rows], "<i8").view(np.uint8), bitorder="little").reshape(-1, BITS)
    parts = allocate(bits, distinct.count(), distance)
    at = lambda col, g: col.bitwiseAND(F.lit(_mask(g)))
    index = distinct.select(F.explode(F.array(*[F.struct(F.lit(i).alias("part"), at(F.col("fp"), g).alias("sig")) for i, (g, _) in enumerate(parts)])).alias("x"), F.col("fp").alias("b")).select("x.part", "x.sig", "b")
    probes = []
    for i, (g, t) in enumerate(parts):
        flips = [_mask(c) for k in range(t + 1) for c in combinations(g, k)]
        own, part = at(F.col("fp"), g), F.lit(i)
        probes.append(F.transform(F.array(*map(F.lit, flips)), _probe(own, part)))
    probe = distinct.select(F.explode(F.concat(*probes)).alias("x"), F.col("fp").alias("a")).select("x.part", "x.sig", "a")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first: Column = F.lit(len(parts))
    for i, (g, t) in reversed(list(enumerate(parts))):
        first = F.when(F.bit_count(at(differ, g)) <= t, i).otherwise(first)
    good = (F.col("a") < F.col("b")) & (F.bit_count(differ) <= distance) & (first == F.col("part"))
    crowded = cut(index.groupBy("part", "sig").count().where(F.col("count") > hot).select("part", "sig"), "crowded")
    keys = ["part", "sig"]
    if crowded.isEmpty():
        return probe.join(index, keys).where(good).select("a", "b")
    plain = probe.join(crowded, keys, "left_anti").join(index.join(crowded, keys, "left_anti"), keys).where(good)
    masks = F.array(*[F.array(*map(F.lit, _other_parts(g, distance))) for g, _ in parts])

    def split(rows: DataFrame, col: str) -> DataFrame:
        own = rows.join(crowded, keys, "left_semi").select(*keys, col, F.posexplode(F.get(masks, F.col("part"))).alias("sub", "mask"))
        return own.select(*keys, "sub", F.col(col).bitwiseAND(F.col("mask")).alias("subsig"), col)

    agree = F.transform(F.get(masks, F.col("part")), lambda m: differ.bitwiseAND(m) == 0)
    fine = split(probe, "a").join(split(index, "b"), [*keys, "sub", "subsig"]).where(good & (F.array_position(agree, F.lit(True)) == F.col("sub") + 1))
    return plain.select("a", "b").unionByName(fine.select("a", "b"))


MANY = 1_000_000  # rows that one task may well have of one key


def join_each(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """left joined to right, which has each key once and in n its number of rows in left, of which there are `total`. Keys with more than
    a hundredth of all rows are at most a hundred; their rows in right are broadcast, so that no task gets all rows of such a key."""
    if total <= MANY:
        return left.join(right, key).drop(n)
    right = cut(right, "keys")
    many = F.broadcast(right.where(F.col(n) > max(total // 100, MANY)))
    return left.join(many.select(key), key, "left_anti").join(right, key).unionByName(left.join(many, key)).drop(n)


def components(pairs: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of the pairs (a, b) can reach; by large-star and small-star rounds."""
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    before = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while True:
        total = 2 * before[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_each(both, least, "u", "n", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_each(large, least, "u", "n", total).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        edges = cut(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(df: DataFrame, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint, n_near and component_id of every document."""
    prints = cut(fingerprints(df), "fingerprints")
    distinct = cut(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep")), "distinct-fingerprints")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    pairs = cut(links(distinct, distance), "links")
    sides = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = sides.join(distinct.select(F.col("fp").alias("b"), "n"), "b").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("others"))
    roots = components(pairs)
    least = roots.join(distinct.select(F.col("fp").alias("node"), "rep"), "node").groupBy("root").agg(F.min("rep").alias("component"))
    of = roots.join(least, "root").select(F.col("node").alias("fp"), "component")
    known = distinct.join(near, "fp", "left").join(of, "fp", "left").select("fp", "n", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"), F.coalesce("component", "rep").alias("component_id"))
    return join_each(prints, known, "fp", "n", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


def keep_one(docs: DataFrame, distance: int = 3) -> DataFrame:
    """The rows of docs whose doc_id is their component's smallest, with all columns; those without an id stay if some component has no
    other. Of rows with equal id and text one stays; rows with one id and other texts stay or go together. Texts are shuffled once, at
    any size: the ids that stay grow with the documents, so they are never broadcast."""
    id_ = unused(docs, "stay")
    groups = near_duplicates(docs, distance)
    stay = cut(groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias(id_)).agg(F.count("*").alias("rows")), "stay")
    mine = docs["doc_id"].cast("long").eqNullSafe(F.col(id_))
    stay = stay.hint("merge")
    again = stay.where("rows > 1").select(id_)
    if again.isEmpty():
        return docs.join(stay.select(id_), mine, "left_semi")
    return docs.join(stay.where("rows = 1").select(id_), mine, "left_semi").unionByName(docs.join(again, mine, "left_semi").dropDuplicates(["doc_id", "text"]))
