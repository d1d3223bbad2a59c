"""Runs that take what they need from the settings: the ingest of a window of hours, the drawing of the cohorts, and the
rounds of the repository study, which join claims, skip rules, trees, reports and outcomes."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.config import Settings
from siltstone.operators import analyze, lifecycle, sampling
from siltstone.session import written
from siltstone.sources import metadata, reports, tree, tree_source
from siltstone.streaming import ingest

MOST_CLAIMS = 1000  #: of a round: their names are one filter, which reaches the walk
ALWAYS = ("jscpd", "lizard")  #: tools that run whatever the language


def ingest_window(spark: SparkSession, settings: Settings, source: str, out: str, checkpoint: str, lexicon: dict[str, list[str]], now: datetime, timeout: float | None = None) -> DataFrame | None:
    """Repositories of the files below source that lie in the settings' window, as ingest.run makes them: other hours' files
    are left alone, bots are told by the settings' pattern, samples and maps are as long as they say."""
    hours = (settings.first_hour, settings.last_hour)
    return ingest.run(spark, source, out, checkpoint, lexicon, now, timeout, top=settings.emoji_top, hours=hours, bots=settings.bots.pattern, samples=settings.samples)


def draw(repos: DataFrame, settings: Settings, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(repositories after promotion, report by bin) for cohorts of the settings' sizes, bins and least commits."""
    return sampling.run(repos, settings.profane_cohort, settings.clean_cohort, settings.sampling(seed))


def claim(repos: DataFrame, settings: Settings, worker: str, now: Column) -> DataFrame:
    """repos after stale claims went back to pending and worker took the settings' number of pending ones."""
    ttl = f"{int(settings.claim_ttl / timedelta(seconds=1))} SECONDS"
    rows = lifecycle.reclaim(repos, now, ttl)
    taken = lifecycle.claim_next(rows, worker, settings.workers).select(F.col("id").alias("__id"))
    hit = F.col("__id").isNotNull()
    out = rows.join(taken, F.col("id") == F.col("__id"), "left")
    new = {"status": F.lit("claimed"), "claimed_by": F.lit(worker), "claimed_at": now}
    return out.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()}).withColumn("__mine", hit).drop("__id")


def analysed(trees: DataFrame, listed: DataFrame, tool_reports: DataFrame, lexicon: dict[str, list[str]], top: int) -> DataFrame:
    """The composed row of every repository in trees (repo, path, length, content), with its primary_language, which listed
    (repo, path) gives; of tools that do not run on that language the reports are not read."""
    of = lambda rows, *more: rows.select("repo", tree.language_of(F.col("path")).alias("language"), *more)
    primary = tree.primary_language(of(listed), ["repo"])
    runs = lambda tool: F.lit(True) if tool in ALWAYS else F.array_contains(reports.tool_families(F.coalesce("primary_language", F.lit(""))), tool)
    told = tool_reports.join(primary, "repo").select("repo", *[F.when(runs(t), F.col(t)).alias(t) for t in (*analyze.FAMILIES, "lizard")])
    scan = tree.scan(of(trees, "content"), ["repo"], lexicon, top)
    return analyze.compose(scan, told, "repo").join(primary, "repo", "left")


def removed(spark: SparkSession, where: str, repos: DataFrame) -> int:
    """Delete the folders of repos (repo) below where, in the tasks; the number that were there."""

    def run(batches):
        fs, base = tree_source.folder(where)
        for b in batches:
            names = [n for n in b.column(0).to_pylist() if n and "/" not in n and n not in (".", "..")]
            there = [i for i in fs.get_file_info([f"{base}/{n}" for n in names]) if i.type == pafs.FileType.Directory]
            for i in there:
                fs.delete_dir(i.path)
            yield pa.RecordBatch.from_arrays([pa.array([len(there)], pa.int64())], ["n"])

    return repos.select("repo").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint"))).first()[0]


def study_round(repos: DataFrame, where: str, tool_reports: DataFrame, settings: Settings, worker: str, now: Column, lexicon: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """One round over the stored repositories: (repositories after it, the composed rows of those that were analysed).

    repos: id, repo (the folder's name below where), rate, status, claimed_by, claimed_at, archived, disabled, size_kb,
    failure_reason, processing_time_sec; null metadata skips none. The worker claims the settings' number of repositories,
    stale claims first becoming free. Those that are archived, disabled or too large fail as skipped before any folder is
    listed; those without files fail as git errors; the others are walked, scanned, composed with their reports (repo and
    a column for each tool) and done. Outcomes apply only where the claim still holds, so a round that is run again
    after a lost driver changes nothing that another worker has taken. Folders are removed if the settings say so. An
    empty table gives two empty tables.
    """
    if settings.workers > MOST_CLAIMS:
        raise ValueError(f"a round claims at most {MOST_CLAIMS} repositories")
    spark, began = repos.sparkSession, time.monotonic()
    rows = written(claim(repos, settings, worker, now), "claims")
    why = metadata.skip_reason(F.col("archived"), F.col("disabled"), F.col("size_kb"), settings.max_repo_mb)
    mine = written(rows.filter("__mine").select("id", "repo", "claimed_by", why.alias("why")), "claimed")
    names = [r["repo"] for r in mine.filter("why IS NULL").select("repo").collect()]  # no more than the settings' claims
    walk = lambda **o: tree_source.read_trees(spark, where, **o).filter(F.col("repo").isin(names))
    found = written(analysed(walk(), walk(contents="false"), tool_reports.filter(F.col("repo").isin(names)), lexicon, settings.emoji_top), "analysis")
    there = found.select(F.col("repo").alias("__repo"))
    judged = mine.join(there, F.col("repo") == F.col("__repo"), "left")
    ok = F.col("why").isNull() & F.col("__repo").isNotNull()
    reason = F.when(F.col("why").isNotNull(), metadata.failure(F.lit("skip"), F.col("why"))).when(F.col("__repo").isNull(), metadata.failure(F.lit("git"), F.lit("no files")))
    outcome = judged.select("id", "claimed_by", ok.alias("ok"), reason.alias("reason"), F.lit(time.monotonic() - began).alias("elapsed"))
    after = written(lifecycle.settle(rows.drop("__mine"), outcome), "settled")
    if settings.clean_up:
        removed(spark, where, mine)
    return after, found
