"""Reporting aggregations: status totals, pivots, coverage, missingness, failures, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
LINTED = {"ruff_bandit": ("Python",), "eslint": ("JavaScript", "TypeScript")}
COMPLEXITY = ("Python", "JavaScript", "TypeScript", "Java", "C", "C++", "C#", "Objective-C", "Ruby", "PHP", "Scala", "Go", "Lua", "Rust", "Swift", "Fortran", "Kotlin")
PARSED = (*COMPLEXITY, "Shell", "R", "Perl", "Haskell", "OCaml", "Elixir", "Erlang", "Dart", "Julia", "Groovy", "Clojure")


def status_totals(rows: DataFrame, status: str, sums: list[str]) -> DataFrame:
    """n and sums by status, and a row <total>."""
    out = rows.rollup(status).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums], F.grouping(status).alias("__all"))
    return out.withColumn(status, F.when(F.col("__all") == 1, "<total>").otherwise(F.col(status))).drop("__all")


def language_label(language: F.Column, probed: F.Column | None = None, missing: F.Column | None = None) -> F.Column:
    """The language, <null> without one; where no metadata is there, <missing> if the probe found no repository, else <not-probed>."""
    out = F.when(language.isNull() | (language == ""), "<null>").otherwise(language)
    if probed is None:
        return out
    gone = F.lit(False) if missing is None else F.coalesce(missing, F.lit(False))
    return F.when(probed, out).when(gone, "<missing>").otherwise("<not-probed>")


def pivot_counts(rows: DataFrame, by: str, over: str, values: list[str], grand: bool = False) -> DataFrame:
    """by, a count for each value of over, and their total; with grand, also a row <total>."""
    counts = [F.count_if(F.col(over) == v).alias(v) for v in values]
    if grand:
        out = rows.rollup(by).agg(*counts, F.grouping(by).alias("__all"))
        out = out.withColumn(by, F.when(F.col("__all") == 1, "<total>").otherwise(F.col(by))).drop("__all")
    else:
        out = rows.groupBy(by).agg(*counts)
    return out.withColumn("total", sum((F.col(v) for v in values), F.lit(0)))


def reindexed(counts: DataFrame, by: str, order: list[str]) -> DataFrame:
    """One row for each value of order, in that order (place), whether counts has it or not; numbers that it lacks are null."""
    wanted = counts.sparkSession.createDataFrame(list(enumerate(order)), f"place int, {by} string")
    return wanted.join(counts, by, "left").orderBy("place")


def funnel(repos: DataFrame, cohorts: tuple[str, ...] = ("profane", "clean"), order: tuple[str, ...] = ("done", "failed", "missing")) -> DataFrame:
    """Cohort rows by status, in the order given: place, status and a count for each cohort, null where there is none."""
    counts = repos.filter(F.col("cohort").isin(*cohorts)).groupBy("status").pivot("cohort", list(cohorts)).count()
    return reindexed(counts, "status", list(order))


#: The sets of languages that the tools' coverage is reported for.
TOOLS = {**LINTED, "python_js": (*LINTED["ruff_bandit"], *LINTED["eslint"]), "lizard": COMPLEXITY, "source_scan": PARSED, "null_language": ("<null>",), "not_probed": ("<not-probed>",), "missing": ("<missing>",)}


def coverage(rows: DataFrame, language: str, sets: dict[str, tuple[str, ...]] = TOOLS) -> DataFrame:
    """(tool, n, pct) for each set of languages."""
    one = rows.agg(F.count("*").alias("total"), *[F.count_if(F.col(language).isin(*v)).alias(k) for k, v in sets.items()])
    long = one.unpivot(["total"], list(sets), "tool", "n")
    return long.select("tool", "n", F.try_divide(100.0 * F.col("n"), F.col("total").cast("double")).alias("pct"))


def missingness(rows: DataFrame, cohort: str, metrics: list[str], first: str, second: str) -> DataFrame:
    """Per metric: values in each cohort and the share of rows without one, in percent."""
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).isNotNull().alias("has")) for m in metrics])).alias("m")
    out = rows.select(F.col(cohort).alias("c"), stack).groupBy("m.metric").agg(
        F.count_if(F.col("m.has") & (F.col("c") == first)).alias("n_first"), F.count_if(F.col("m.has") & (F.col("c") == second)).alias("n_second"), (100.0 * F.count_if(~F.col("m.has")) / F.count("*")).alias("pct_missing"),
    )
    return out


def failures(rows: DataFrame, reason: str) -> DataFrame:
    return rows.filter(F.col(reason).isNotNull()).groupBy(F.split_part(F.col(reason), F.lit(":"), F.lit(1)).alias("kind")).agg(F.count("*").alias("n"))


#: The study's frame: column -> where it lies in a repository row.
STUDY = {
    "full_name": "full_name", "cohort": "cohort", "primary_language": "primary_language",
    **{c: f"code_analysis.{c}" for c in ("loc_total", "files_scanned", "ruff_issues_per_kloc")},
    "ruff_bug_per_kloc": "code_analysis.ruff_bug_issues_per_kloc", "eslint_issues_per_kloc": "code_analysis.eslint_issues_per_kloc", "bandit_per_kloc": "code_analysis.bandit_issues_per_kloc",
    **{c: f"code_analysis.{c}" for c in ("lizard_avg_ccn", "lizard_max_ccn", "lizard_ccn_p90", "lizard_ccn_p99", "jscpd_duplicate_rate", "comment_to_code_ratio", "comment_profanity_hits")},
    "id_profanity_hits": "code_analysis.identifier_profanity_hits", "comment_emoji_hits": "code_analysis.comment_emoji_hits", "id_emoji_hits": "code_analysis.identifier_emoji_hits",
    "tech_debt_markers": "code_analysis.tech_debt_markers",
}


def study_frame(repos: DataFrame) -> DataFrame:
    """Finished cohort rows with the columns that the statistics read."""
    done = repos.filter(F.col("cohort").isin("profane", "clean") & (F.col("status") == "done"))
    return done.select(*[F.col(path).alias(name) for name, path in STUDY.items()])


def database_guard(name: str, word: str = "test") -> None:
    """The end-to-end checks write nothing, yet run against a store whose name says that it is for tests only."""
    if word not in name.lower():
        raise ValueError(f"the checks are for a store whose name holds {word!r}, not {name!r}")


def results_json(frames: dict[str, DataFrame], path: str, **facts) -> None:
    """The report as one JSON document at path: a list of rows for each frame, and facts. A report's frames hold a few rows
    each: they are put together by Spark, one string a row, and nothing comes to the driver."""
    spark = next(iter(frames.values())).sparkSession
    one = spark.range(1).select(*[F.lit(v).alias(k) for k, v in facts.items()])
    for name, frame in frames.items():
        rows = frame.select(F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false"}).alias("row"))
        one = one.crossJoin(F.broadcast(rows.agg(F.array_sort(F.collect_list("row")).alias(name))))  # one row
    parts = [F.concat(F.lit(f'"{k}": '), F.to_json(F.array(F.col(k))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(k)))) - 2)) for k in facts]
    parts += [F.concat(F.lit(f'"{k}": ['), F.array_join(k, ", "), F.lit("]")) for k in frames]
    one.select(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def checks(repos: DataFrame, least_repos: int = 100, least_done: int = 3) -> DataFrame:
    """The end-to-end checks as rows (check, ok, detail)."""
    live = F.col("status").isin("pending", "claimed", "done", "failed")
    one = repos.agg(
        F.count("*").alias("repos"), F.count_if(F.col("hits") > 0).alias("with_hits"), F.count_if(F.col("emoji_hits") > 0).alias("with_emoji"), F.count_if(F.col("status") == "done").alias("done"),
        F.count_if((F.col("status") == "done") & ~(F.coalesce(F.col("loc_total"), F.lit(0)) > 0)).alias("done_without_loc"), F.count_if(live & ~F.coalesce(F.col("cohort").isin("profane", "clean"), F.lit(False))).alias("live_without_cohort"),
    )
    row = lambda name, ok, n: F.struct(F.lit(name).alias("check"), ok.alias("ok"), F.col(n).cast("bigint").alias("detail"))
    return one.select(F.explode(F.array(
        row("enough repos", F.col("repos") >= least_repos, "repos"), row("a lexicon hit", F.col("with_hits") >= 1, "with_hits"), row("an emoji hit", F.col("with_emoji") >= 1, "with_emoji"),
        row("enough done", F.col("done") >= least_done, "done"), row("done rows have lines", F.col("done_without_loc") == 0, "done_without_loc"), row("live rows have a cohort", F.col("live_without_cohort") == 0, "live_without_cohort"),
    )).alias("c")).select("c.*")
