"""Configuration entries as a table: section, subsection, sec_pos, key, value, pos."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.functions.config import Config

ENTRIES = "section string, subsection string, sec_pos int, key string, value string, pos int"


def entries(spark: SparkSession, config: Config) -> DataFrame:
    rows = [(s, sub, i, k, v, j) for i, (s, sub, pairs) in enumerate(config.sections) for j, (k, v) in enumerate(pairs)]
    return spark.createDataFrame(rows, ENTRIES)


def parse_table(texts: DataFrame) -> DataFrame:
    """name and ENTRIES of configuration texts (name, text), parsed in tasks."""

    def run(it):
        for pdf in it:
            rows = [(n, s, sub, i, k, v, j) for n, t in zip(pdf["name"], pdf["text"]) for i, (s, sub, pairs) in enumerate(Config.parse(t or "").sections) for j, (k, v) in enumerate(pairs)]
            yield pd.DataFrame(rows, columns=["name", "section", "subsection", "sec_pos", "key", "value", "pos"])

    return texts.select(F.col("name").cast("string"), "text").mapInPandas(run, "name string, " + ENTRIES)


def get_all(table: DataFrame, section: str, key: str, subsection: str | None = None) -> DataFrame:
    """All values in order; section and key without case, subsection exactly."""
    hit = (F.lower("section") == section.lower()) & (F.lower("key") == key.lower()) & F.col("subsection").eqNullSafe(F.lit(subsection))
    return table.where(hit).orderBy("sec_pos", "pos").select("value")


def first_values(table: DataFrame) -> DataFrame:
    """section, subsection, key, value: the first value of each key, in the first section that has it."""
    return table.groupBy(F.lower("section").alias("section"), "subsection", F.lower("key").alias("key")).agg(F.min_by("value", F.struct("sec_pos", "pos")).alias("value"))
