"""Quality rules with risk-controlled thresholds.

Counts of words, symbols, repeated lines and repeated 5-word windows give three rates. For each stratum (language) and rate, cutoffs
are tried from the most lenient on: the rate's false rejections among labelled good documents that pass the base rule are counted,
and a cutoff holds if an exact binomial test rejects that more than `risk / number of rates` of the good documents would go. The
first cutoff that fails ends the sequence (fixed-sequence testing), and the level is divided by the number of sequences (Bonferroni),
so with probability 1 - `level` no stratum loses more than `risk` of its good documents. Copies aren't independent trials: of labelled
documents with one text in a stratum only one is counted.

A stratum with too few labels for that, even if none of them were rejected, isn't tested by rate but by one fixed sequence of joint
cutoffs at the full risk and a stratum's whole level. Which of both depends on the number of labels alone, so the promise holds. With
four strata and the default risk and level, tests by rate need 1,642 good labels and the joint one 437; with fewer there is no cutoff.

Defined cases: null or empty texts have no words and fail the base rule; a null language is a stratum of its own; a document labelled
both good and bad counts as not good; without labels only the base rule rejects; repeated rows are judged each for itself; an empty
table gives an empty result. Filtering keeps all columns of its input, whatever their names. Strata with so few labels that no cutoff
could be held have none and don't share the level, so a dirty language column costs neither power nor memory of the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from treelake.llm.common import cut, rows_batch, unused

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Cutoffs by rate, most lenient first; a document goes if its rate is above the cutoff.
CUTOFFS = {
    "symbols_per_word": (4.0, 3.0, 2.5, 2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2),
    "dup_lines_per_line": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "repeat_words_per_word": (0.18, 0.16, 0.14, 0.12, 0.1, 0.08),
}


def _joint() -> list[tuple[float, ...]]:
    """The sequence of joint cutoffs: symbols and repeated lines at an even pace, then repeated words, which the base rule bounds already."""
    symbols, lines, words = CUTOFFS.values()
    steps = sorted([(k / len(g), rule, x) for rule, g in enumerate((symbols, lines)) for k, x in enumerate(g, 1)]) + [(1, 2, x) for x in words]
    now, out = [math.inf] * len(CUTOFFS), []
    for _, rule, x in steps:
        now[rule] = x
        out.append(tuple(now))
    return out


JOINT = _joint()


def repeat_words(words: list[bytes], span: int = 5) -> int:
    """Words in windows of `span` words that are found twice or more."""
    n = len(words) - span + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(span):
        key = (key * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]) ^ (key >> np.uint64(29))
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    seen: dict[tuple, list[int]] = {}
    for at in np.flatnonzero(np.isin(key, twice)).tolist():  # equal keys are compared as words
        seen.setdefault(tuple(words[at : at + span]), []).append(at)
    edges = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            edges[places] += 1
            edges[[p + span for p in places]] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """COUNTS of a text."""
    text = text or ""
    words = text.encode("utf-8").split()  # bytes are split at the six ASCII white-space characters alone
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeat_words(words), lines


def base_failed(c: tuple[int, ...]) -> bool:
    return c[0] < 10 or 100 * c[4] > 20 * c[0]


def rates(c: tuple[int, ...]) -> tuple[float, float, float]:
    return c[2] / max(c[0], 1), c[3] / max(c[5], 1), c[4] / max(c[0], 1)


def kept(c: tuple[int, ...], limits: tuple[float, ...] | None) -> bool:
    return not base_failed(c) and (limits is None or all(r <= x for r, x in zip(rates(c), limits)))


def too_risky(errors: int, n: int, risk: float, level: float) -> bool:
    """False if errors among n are so few that P(Binomial(n, risk) <= errors) <= level, that is, the exact upper bound is at most risk.
    Terms are summed from the largest down until they don't count any more, which are about as many as sqrt(n)."""
    if n == 0 or errors >= n or level < 0.5 and errors >= n * risk:  # the median is at most the mean rounded up
        return True
    odds = (1 - risk) / risk
    at = min(errors, int((n + 1) * risk))
    term = math.exp(math.lgamma(n + 1) - math.lgamma(at + 1) - math.lgamma(n - at + 1) + at * math.log(risk) + (n - at) * math.log1p(-risk))
    total, down, k = term, term, at
    while k and down > 1e-18 * total:
        down *= k / (n - k + 1) * odds
        total, k = total + down, k - 1
    for k in range(at, errors):
        term *= (n - k) / (k + 1) / odds
        total += term
    return total > level


@dataclass(frozen=True)
class Limits:
    by_stratum: dict[str | None, tuple[float, ...]]

    def of(self, lang: str | None) -> tuple[float, ...] | None:
        return self.by_stratum.get(lang)

    def table(self, spark: SparkSession) -> DataFrame:
        """_lang, _limits: a row for each stratum with a cutoff, to be broadcast if these are few, as they are unless thousands of strata have
        hundreds of labels each."""
        rows = [(lang, list(x)) for lang, x in self.by_stratum.items() if min(x) < math.inf]
        table = spark.createDataFrame(rows, "_lang string, _limits array<double>")
        return F.broadcast(table) if len(rows) <= BROADCAST else table


BROADCAST = 10_000  # strata
COUNTED = "key long, " + ", ".join(f"{c} long" for c in COUNTS)


def counted(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column of that name, which has a key of the text and COUNTS."""
    text = docs.columns.index("text")
    kind = pa.struct([pa.field(c.split()[0], pa.int64()) for c in COUNTED.split(", ")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(xxhash.xxh64_intdigest((t.as_py() or "").encode("utf-8")) - (1 << 63), *counts(t.as_py())) for t in b.column(text)]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * kind.num_fields
            del rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays(columns, fields=list(kind))], schema=b.schema.append(pa.field(name, kind)))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, docs.sparkSession.createDataFrame([], COUNTED).schema)]))


def _lang(docs: DataFrame):
    return F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, a key of the text, and COUNTS; one row for each of docs."""
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _lang(docs).alias("lang"), "text")
    return counted(few, "_c").select("doc_id", "lang", "_c.*")


def _rates() -> list:
    c = {x: F.col(x) for x in COUNTS}
    n = F.greatest(c["n_words"], F.lit(1))
    return [c["n_symbols"] / n, c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1)), c["n_repeat_words"] / n]


BASE = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def fit(stats: DataFrame, labels: DataFrame, risk: float = 0.01, level: float = 0.05) -> Limits:
    """Cutoffs from all labelled good documents that pass the base rule. What comes to the driver is a count for each stratum that could
    have a cutoff, rate (or joint sequence) and number of cutoffs exceeded."""
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1")
    each = cut(stats.where(f"not ({BASE})").join(good, "doc_id", "left_semi").drop("doc_id").distinct(), "labelled-statistics")
    above = [sum((r > x).cast("int") for x in grid) for r, grid in zip(_rates(), CUTOFFS.values())]
    joint = sum(reduce(or_, [r > x for r, x in zip(_rates(), step) if x < math.inf]).cast("int") for step in JOINT)
    least = math.ceil(math.log(level) / math.log1p(-risk))  # labels that one stratum alone would need
    some = each.groupBy(F.col("lang").alias("_lang")).count().where(F.col("count") >= least).select("_lang")
    each = each.join(some, F.col("lang").eqNullSafe(F.col("_lang")), "left_semi")
    rows = each.select("lang", F.posexplode(F.array(*above, joint)).alias("rule", "above")).groupBy("lang", "rule", "above").count().collect()
    found: dict[str | None, tuple[float, ...]] = {}
    langs = {r.lang for r in rows}

    def held(lang: str | None, rule: int, steps: Sequence, risk: float, level: float):
        """The last step before the first that fails, or None."""
        by, last = {r.above: r["count"] for r in rows if r.lang == lang and r.rule == rule}, None
        for k, step in enumerate(steps):  # what is above step k is above all that are more aggressive
            if too_risky(sum(m for above, m in by.items() if above >= len(steps) - k), sum(by.values()), risk, level):
                break
            last = step
        return last

    for lang in langs:
        n = sum(r["count"] for r in rows if r.lang == lang and r.rule == 0)
        by_rate = risk / len(CUTOFFS), level / (len(langs) * len(CUTOFFS))
        if too_risky(0, n, *by_rate):
            found[lang] = held(lang, len(CUTOFFS), JOINT, risk, level / len(langs)) or (math.inf,) * len(CUTOFFS)
        else:
            limits = [held(lang, rule, grid, *by_rate) for rule, grid in enumerate(CUTOFFS.values())]
            found[lang] = tuple(math.inf if x is None else x for x in limits)
    return Limits(found)


def _kept():
    """Whether a row of COUNTS and _limits (null: none) is kept."""
    fits = [F.coalesce(r <= F.col("_limits")[k], F.lit(True)) for k, r in enumerate(_rates())]
    return ~F.expr(BASE) & fits[0] & fits[1] & fits[2]


def verdicts(docs: DataFrame, labels: DataFrame, risk: float = 0.01, level: float = 0.05) -> DataFrame:
    """doc_id, counts, base_failed and kept of each document."""
    stats = cut(statistics(docs), "quality-statistics")
    limits = fit(stats, labels, risk, level).table(docs.sparkSession)
    return stats.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left").select("doc_id", *COUNTS[:5], F.expr(BASE).alias("base_failed"), _kept().alias("kept"), "n_lines")


def filter_documents(docs: DataFrame, labels: DataFrame, risk: float = 0.01, level: float = 0.05) -> DataFrame:
    """The rows of docs that are kept, with all their columns. Documents are counted once and written with their counts, so that no text
    is shuffled."""
    name = unused(docs, "counts")
    rows = cut(counted(docs, name), "counted-documents")
    limits = fit(rows.select(F.col("doc_id").cast("long").alias("doc_id"), _lang(docs).alias("lang"), f"{name}.*"), labels, risk, level).table(docs.sparkSession)
    limit = unused(docs, "limits")
    one = limits.withColumnsRenamed({"_lang": unused(docs, "stratum"), "_limits": limit})
    x = F.col(name)
    rate = [x["n_symbols"] / F.greatest(x["n_words"], F.lit(1)), x["n_dup_lines"] / F.greatest(x["n_lines"], F.lit(1)), x["n_repeat_words"] / F.greatest(x["n_words"], F.lit(1))]
    ok = (x["n_words"] >= 10) & (100 * x["n_repeat_words"] <= 20 * x["n_words"])
    for k, r in enumerate(rate):
        ok = ok & F.coalesce(r <= F.col(limit)[k], F.lit(True))
    return rows.join(one, _lang(docs).eqNullSafe(F.col(one.columns[0])), "left").where(ok).select(*[F.col(f"`{c}`") for c in docs.columns])
