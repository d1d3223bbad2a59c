"""Bin-matched cohorts: eligibility, bins, quotas, seeded draws, promotion, shortfalls and top-up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ELIGIBLE = ("seen", "skipped")


@dataclass(frozen=True)
class Sampling:
    bins: tuple[int, ...] = (20, 50, 200, 1000)
    min_commits: int = 20
    seed: int = 42

    def __post_init__(self):
        if not self.bins or list(self.bins) != sorted(set(self.bins)):
            raise ValueError("bins must ascend")

    def bin_of(self, commits: Column) -> Column:
        """The lower edge of the bin; null below the first."""
        out = F.lit(None).cast("bigint")
        for lo in self.bins:
            out = F.when(commits >= lo, F.lit(lo).cast("bigint")).otherwise(out)
        return out

    def bounds(self, lo: int) -> tuple[int, int | None]:
        """The half-open range of commits of the bin that begins at lo; the last has no end."""
        if lo not in self.bins:
            raise ValueError(f"no bin begins at {lo}")
        at = self.bins.index(lo) + 1
        return lo, self.bins[at] if at < len(self.bins) else None

    def order(self, id_col: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(self.seed)), id_col.cast("string")))


def profane(repos: DataFrame, n: int, conf: Sampling = Sampling()) -> DataFrame:
    """The n eligible repositories of highest rate with a hit; 0 draws none."""
    ok = repos.filter(F.col("status").isin(*ELIGIBLE) & (F.col("commits") >= conf.min_commits) & (F.col("hits") >= 1))
    return ok.orderBy(F.col("rate").desc(), "id").limit(n).select("id", "commits", conf.bin_of(F.col("commits")).alias("bin"))


def bin_bounds(spark: SparkSession, conf: Sampling = Sampling()) -> DataFrame:
    """(bin, low, high) of every bin, high null for the last. One row for each bin, so the window's one task is small."""
    edges = spark.createDataFrame([(b,) for b in conf.bins], "bin bigint")
    return edges.select("bin", F.col("bin").alias("low"), F.lead("bin").over(Window.partitionBy(F.lit(0)).orderBy("bin")).alias("high"))


def in_bins(rows: DataFrame, bounds: DataFrame, commits: str = "commits") -> DataFrame:
    """rows with the bin whose range holds their commits, by a range join with the few bounds; the rest are dropped."""
    c = F.col(commits)
    return rows.join(F.broadcast(bounds), (c >= F.col("low")) & (F.col("high").isNull() | (c < F.col("high")))).drop("low", "high")


def bin_counts(cohort: DataFrame, conf: Sampling = Sampling()) -> DataFrame:
    """(bin, n) for every bin, zeros too."""
    edges = cohort.sparkSession.createDataFrame([(b,) for b in conf.bins], "bin bigint")
    return edges.join(cohort.filter("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n")), "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def quotas(counts: DataFrame, clean_n: int) -> DataFrame:
    """(bin, quota): the bins' shape scaled to clean_n, half to even, the difference in the largest bin (the first of ties). One row for each bin."""
    one = Window.partitionBy(F.lit(0))
    total = F.sum("n").over(one)
    scaled = counts.withColumn("q", F.coalesce(F.bround(F.try_divide(F.col("n") * F.lit(float(clean_n)), total.cast("double"))).cast("bigint"), F.lit(0).cast("bigint"))).withColumn("total", total)
    largest = F.row_number().over(one.orderBy(F.col("n").desc(), "bin")) == 1
    drift = F.when(F.col("total") > 0, F.lit(clean_n) - F.sum("q").over(one)).otherwise(0)
    return scaled.select("bin", (F.col("q") + F.when(largest, drift).otherwise(0)).cast("bigint").alias("quota"))


def clean(repos: DataFrame, quota: DataFrame, conf: Sampling = Sampling()) -> DataFrame:
    """Of the eligible without hits, a seeded draw of each bin's quota without replacement (a top-k by hash, kept per task first)."""
    ok = repos.filter(F.col("status").isin(*ELIGIBLE) & (F.col("hits") == 0)).select("id", "commits", conf.bin_of(F.col("commits")).alias("bin"), conf.order(F.col("id")).alias("key")).filter("bin IS NOT NULL")
    most = max([r["quota"] for r in quota.collect()], default=0)  # one row for each bin
    w = Window.partitionBy("bin").orderBy("key", "id")
    return ok.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).join(F.broadcast(quota), "bin").filter(F.col("rank") <= F.col("quota")).select("id", "commits", "bin")


def promote(repos: DataFrame, profane_rows: DataFrame, clean_rows: DataFrame) -> DataFrame:
    """Stamp pending and the cohort on drawn rows; what was merely seen becomes skipped."""
    drawn = profane_rows.select("id", F.lit("profane").alias("__cohort")).unionByName(clean_rows.select("id", F.lit("clean").alias("__cohort")))
    out = repos.join(drawn, "id", "left")
    status = F.when(F.col("__cohort").isNotNull(), "pending").when(F.col("status") == "seen", "skipped").otherwise(F.col("status"))
    return out.withColumns({"status": status, "cohort": F.coalesce("__cohort", "cohort")}).drop("__cohort")


def run(repos: DataFrame, profane_n: int, clean_n: int, conf: Sampling = Sampling()) -> tuple[DataFrame, DataFrame]:
    """(repositories after promotion, report by bin: target, drawn, shortfall)."""
    p = profane(repos, profane_n, conf)
    q = quotas(bin_counts(p, conf), clean_n)
    c = clean(repos, q, conf)
    return promote(repos, p, c), shortfall(q, c, conf)


def shortfall(quota: DataFrame, drawn: DataFrame, conf: Sampling = Sampling()) -> DataFrame:
    got = bin_counts(drawn, conf)
    return quota.join(got, "bin").select("bin", F.col("quota").alias("target"), F.col("n").alias("drawn"), F.greatest(F.col("quota") - F.col("n"), F.lit(0)).alias("shortfall"))


def demote_missing(repos: DataFrame, missing: Column) -> DataFrame:
    """Cohort rows found missing leave the queue: pending, claimed and failed ones become missing and lose their claim.
    A null predicate is no finding."""
    hit = F.coalesce(missing, F.lit(False)) & F.col("cohort").isNotNull() & F.col("status").isin("pending", "claimed", "failed")
    claim = {c: F.when(~hit, F.col(c)) for c in ("claimed_by", "claimed_at") if c in repos.columns}
    return repos.withColumns({"status": F.when(hit, "missing").otherwise(F.col("status")), **claim})


LIVE = ("pending", "claimed", "done", "failed")


def live(repos: DataFrame) -> DataFrame:
    return repos.agg(*[F.count_if((F.col("cohort") == c) & F.col("status").isin(*LIVE)).alias(f"live_{c}") for c in ("profane", "clean")])


def top_up(repos: DataFrame, target_profane: int, target_clean: int, conf: Sampling = Sampling()) -> tuple[DataFrame, dict[str, int]]:
    """Draw what is missing to the targets. A gap of zero draws none; with no new profane rows the live ones give the shape."""
    now = live(repos).first()
    gap_p, gap_c = max(0, target_profane - now[0]), max(0, target_clean - now[1])
    if not gap_p and not gap_c:
        return repos, {"profane": 0, "clean": 0}
    p = profane(repos, gap_p, conf)
    shape = p if gap_p else repos.filter((F.col("cohort") == "profane") & F.col("status").isin(*LIVE)).select("id", "commits", conf.bin_of(F.col("commits")).alias("bin"))
    c = clean(repos, quotas(bin_counts(shape, conf), gap_c), conf)
    return promote(repos, p, c), {"profane": gap_p, "clean": gap_c}
