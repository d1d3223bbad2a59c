"""Lexicons: one file of words for each language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.http import get


def parsed(lines: DataFrame) -> DataFrame:
    """(lang, word) from (name of the file, value): trimmed, lower-cased, distinct; blank and # lines and .md files are left out."""
    rows = lines.select("name", F.lower(F.trim("value")).alias("word"))
    rows = rows.filter(~F.col("name").endswith(".md") & (F.col("word") != "") & ~F.col("word").startswith("#"))
    return rows.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("lang"), "word").distinct()


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path).select(F.col("_metadata.file_name").alias("name"), "value"))


def as_map(lexicon: DataFrame) -> dict[str, list[str]]:
    """For the driver: a lexicon is a parameter of a few thousand words."""
    out: dict[str, list[str]] = {}
    for r in lexicon.orderBy("lang", "word").collect():
        out.setdefault(r["lang"], []).append(r["word"])
    return out


def fetch(spark: SparkSession, base: str, revision: str, languages: list[str], get=get) -> DataFrame:
    """(lang, word) of the lists of one revision below base, fetched by the driver: a few small files. A list that is not there is left out."""
    texts = [(lang, get(f"{base.rstrip('/')}/{revision}/{lang}")) for lang in languages]
    lines = [(lang, line) for lang, body in texts if body for line in body.decode("utf-8", "replace").splitlines()]
    return parsed(spark.createDataFrame(lines, "name string, value string"))
