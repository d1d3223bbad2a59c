"""What the query modules share: the register, the tables, parameters and pieces of SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from siltstone.functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Parameter lexicon: words that the tables hold.
LEXICON = {"en": ["idiot", "moron", "scum", "loser", "stupid", "trash", "pathetic", "this"], "es": ["que", "para"], "fr": ["pour", "sur"], "de": ["nicht", "auch"]}
NOW = datetime(2024, 1, 2)

TOKEN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'']*[\p{L}\p{N}_])?"
LEX_CTE = "lex(lang, word) AS (VALUES " + ", ".join(f"('{k}', '{w}')" for k, v in LEXICON.items() for w in v) + ")"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by key where the scan gives fewer tasks than there are cores, as small tables of one row group do, and
    costly expressions over them would wait for one core; a scan of many tasks is left as it is."""
    want = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(want, key) if rows.rdd.getNumPartitions() < want else rows


def quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{TOKEN}')"


def word_set_sql(x: str) -> str:
    return f"list_distinct(list_concat({tokens_sql(x)}, regexp_extract_all(translate(lower({x}), '{T.LEET_FROM}', '{T.LEET_TO}'), '{TOKEN}')))"


def hits_sql(x: str, lang: str) -> str:
    """The sorted words of x that the parameter lexicon lists for lang or English."""
    words = " ".join(f"WHEN '{k}' THEN {quoted(sorted({*LEXICON['en'], *v}))}" for k, v in LEXICON.items() if k != "en")
    return f"list_sort(list_intersect({word_set_sql(x)}, CASE {lang} {words} ELSE {quoted(sorted(LEXICON['en']))} END))"


def language_sql(x: str) -> str:
    """The language rule for a column x."""
    found = f"list_distinct({tokens_sql(x)})"
    codes = sorted(T.COMMON_WORDS)
    score = {k: f"len(list_intersect(f, {quoted(T.COMMON_WORDS[k])}))" for k in codes}
    alias = lambda k: T.LANGUAGE_ALIASES.get(k, k)
    best = f"CASE WHEN list_max(s) = 0 OR s[{codes.index('en') + 1}] = list_max(s) THEN 'en' " + " ".join(f"WHEN s[{i + 1}] = list_max(s) THEN '{alias(k)}'" for i, k in enumerate(codes)) + " END"
    held = lambda k: f"(length({x}) - length(regexp_replace({x}, '[{T.SCRIPTS[k]}]', '', 'g'))) * {T.SCRIPT_SHARE.get(k, 4)} >= length({x})"
    scripts = " ".join(f"WHEN {held(k)} THEN '{k}'" for k in T.SCRIPTS)
    return f"(SELECT CASE WHEN coalesce(length({x}), 0) < {T.MIN_DETECT_CHARS} THEN 'en' {scripts} ELSE {best} END FROM (SELECT [{', '.join(score.values())}] AS s FROM (SELECT {found} AS f)))"


def emoji_sql(x: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all({x}, '{T.EMOJI}'), lambda g: regexp_replace(g, '[\x{{1F3FB}}-\x{{1F3FF}}\x{{FE0F}}]', '', 'g')), lambda g: g <> '')"


def p_value_sql(u: str, n1: str, n2: str, ties: str) -> str:
    """The two-sided normal p of U: the complementary error function by its series up to 4, 0 beyond (below 2e-8)."""
    n = f"({n1} + {n2})"
    z = f"((greatest({u}, {n1} * {n2} - {u}) - {n1} * {n2} / 2.0::DOUBLE - 0.5) / sqrt({n1} * {n2} / 12.0::DOUBLE * (({n} + 1) - {ties} / ({n} * ({n} - 1)::DOUBLE))))"
    x = f"({z} / sqrt(2.0::DOUBLE))"
    series = f"list_sum(list_transform(range(0, 90), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + 1) * ln({x}) - lgamma(k + 1) - ln(2 * k + 1))))"
    return f"CASE WHEN {x} <= 0 THEN 1.0::DOUBLE WHEN {x} > 4 THEN 0.0::DOUBLE ELSE 1 - 2 / sqrt(pi()) * {series} END"
