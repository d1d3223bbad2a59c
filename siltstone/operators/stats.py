"""Rank tests, effect sizes, bootstrap intervals, distributions."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from siltstone.operators import ranks


def unpivot(rows: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """(ids, metric, x) without nulls."""
    return rows.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(ids, metrics, "metric", "x").filter("x IS NOT NULL")


EXACT_SIDE = 8  #: a side of at most so many values, and no ties: the exact distribution of U


def exact_two_sided(u: float, n1: int, n2: int) -> float:
    """P of a U at least as far out, by counting the orders of n1 and n2 values: the coefficients of a Gaussian binomial."""
    small, large = sorted((n1, n2))
    ways = np.zeros(n1 * n2 + 1)
    ways[0] = 1.0
    for k in range(1, small + 1):  # times (1 - q^(large+k)) / (1 - q^k)
        top = large + k
        if top < len(ways):
            ways[top:] = ways[top:] - ways[:-top]
        for at in range(k, len(ways)):
            ways[at] += ways[at - k]
    far = int(round(max(u, n1 * n2 - u)))
    return min(1.0, 2.0 * float(ways[far:].sum() / ways.sum()))


@F.pandas_udf(DoubleType())
def two_sided_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    """Two-sided p of U: exact for a small side without ties, else the normal approximation, corrected for ties and continuity."""
    out = []
    for a, p, q, t in zip(u, n1, n2, ties):
        if a is None or math.isnan(a):
            out.append(None)
        elif min(p, q) <= EXACT_SIDE and not t:
            out.append(exact_two_sided(a, int(p), int(q)))
        else:
            n = p + q
            var = p * q / 12 * ((n + 1) - t / (n * (n - 1))) if n > 1 else 0
            z = (max(a, p * q - a) - p * q / 2 - 0.5) / math.sqrt(var) if var > 0 else float("nan")
            out.append(None if math.isnan(z) else min(1.0, math.erfc(z / math.sqrt(2))))
    return pd.Series(out, dtype="float64")


def by_value(long: DataFrame, first: str, second: str) -> DataFrame:
    """(metric, x, a, b) with ranges and running sums: how often both cohorts have each value of a metric."""
    counted = long.groupBy("metric", "x").agg(F.count_if(F.col("cohort") == first).alias("a"), F.count_if(F.col("cohort") == second).alias("b")).filter("a + b > 0")
    return ranks.cumulated(counted, ["metric"], "x", ["a", "b"])


def tested(values: DataFrame, least: int = 5, alpha: float = 0.05) -> DataFrame:
    """The rank test of each metric of by_value rows."""
    t = F.col("a") + F.col("b")
    ranked = values.withColumns({"t": t, "rank": F.col("a_before") + F.col("b_before") + (t + 1) / 2.0})
    sums = ranked.groupBy("metric").agg(
        F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("rank") * F.col("a")).alias("r1"), F.sum((F.pow(F.col("t").cast("double"), 3) - F.col("t")).cast("double")).alias("ties"),
        ranks.median_of("x", "a").alias("median_1"), ranks.median_of("x", "b").alias("median_2"),
    )
    enough = F.least("n1", "n2") >= least
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    out = sums.withColumn("u", F.when(enough, u))
    out = out.withColumn("r_rb", F.when(enough, 1 - 2 * F.col("u") / (F.col("n1") * F.col("n2"))))
    out = out.withColumn("p", F.when(enough, two_sided_p("u", F.col("n1").cast("double"), F.col("n2").cast("double"), "ties")))
    m = F.count("*").over(Window.partitionBy(F.lit(0)))  # one row for each metric
    return out.withColumn("significant", F.col("p") < F.lit(alpha) / m).drop("r1", "ties")


def mann_whitney(long: DataFrame, first: str = "clean", second: str = "profane", least: int = 5, alpha: float = 0.05) -> DataFrame:
    """One row for each metric of long (metric, cohort, x): n1, n2, medians, U of the first sample, r_rb, p, significant.

    Ranks and medians come from counts by value in ranges, so a metric is not one task's. Where a side has fewer than least
    values, U, r_rb and p are null. Significance is at alpha over the number of metrics.
    """
    return tested(by_value(long, first, second), least, alpha)


def in_subsets(long: DataFrame, column: str, subsets: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows of long once for each subset that they belong to, with its name as subset; an empty tuple takes every row."""
    held = [F.when(F.lit(True) if not v else F.col(column).isin(*v), F.lit(k)) for k, v in subsets.items()]
    return long.withColumn("subset", F.explode(F.array_compact(F.array(*held))))


def mwu_tables(long: DataFrame, metrics: dict[str, tuple[str, ...]], family: int, alpha: float = 0.05, **options) -> DataFrame:
    """Rank tests by subset: long has subset, metric, cohort, x; metrics names the metrics of each subset. One job for all
    tables. significant: p below alpha over the size of the a-priori family, whatever the subset. Best read by subset and p."""
    listed = reduce(lambda a, b: a | b, [(F.col("subset") == k) & F.col("metric").isin(*v) for k, v in metrics.items()])
    keyed = long.filter(listed).select(F.concat_ws("\x1f", "subset", "metric").alias("metric"), "cohort", "x")
    out = mann_whitney(keyed, alpha=alpha, **options).withColumn("significant", F.col("p") < alpha / family)
    parts = F.split("metric", "\x1f")
    return out.withColumn("subset", parts[0]).withColumn("metric", parts[1]).orderBy("subset", F.col("p").asc_nulls_last(), "metric")


def forest(long: DataFrame, alpha: float = 0.05, first: str = "clean", second: str = "profane", **options) -> DataFrame:
    """Rank test and interval of each metric, by effect."""
    values = by_value(long, first, second)
    return tested(values, alpha=alpha).join(effect_intervals(values, **options), "metric").orderBy(F.col("r_rb").asc_nulls_last(), "metric")


def median_rows(long: DataFrame, family: int, alpha: float = 0.05, **options) -> DataFrame:
    """The per-language panel: a row for each subset and metric with both cohorts' counts, medians and intervals, p and significance."""
    tests = mann_whitney(long.withColumn("metric", F.concat_ws("\x1f", "subset", "metric")), alpha=alpha)
    parts = F.split("metric", "\x1f")
    tests = tests.select(parts[0].alias("subset"), parts[1].alias("metric"), F.col("n1").alias("n_clean"), F.col("n2").alias("n_profane"), "p", (F.col("p") < alpha / family).alias("significant"))
    spans = bootstrap_median(long, by=("subset", "metric", "cohort"), **options)
    of = lambda c: spans.filter(F.col("cohort") == c).select("subset", "metric", *[F.col(x).alias(f"{x}_{c}") for x in ("median", "low", "high")])
    return tests.join(of("clean"), ["subset", "metric"], "left").join(of("profane"), ["subset", "metric"], "left")


def effect_intervals(values: DataFrame, resamples: int = 1000, seed: int = 42, least: int = 5) -> DataFrame:
    """(metric, low, high) of by_value rows: the 2.5 and 97.5 % quantiles of r_rb over resamples; null where a side has fewer
    than least values. What is shuffled grows with the distinct values and with resamples times ranges."""
    found = ranks.interval(ranks.effect_resamples(values, ["metric"], resamples, seed, least), ["metric"], "r_rb")
    return values.select("metric").distinct().join(found, "metric", "left")


def bootstrap_effect(long: DataFrame, first: str = "clean", second: str = "profane", **options) -> DataFrame:
    """effect_intervals of long (metric, cohort, x)."""
    return effect_intervals(by_value(long, first, second), **options)


def bootstrap_median(long: DataFrame, resamples: int = 2000, seed: int = 42, least: int = 5, by: tuple[str, ...] = ("metric", "cohort")) -> DataFrame:
    """(by, median, low, high); all three null where a group has fewer than least values. by: columns of strings, not null."""
    keys = list(by)
    values = ranks.cumulated(long.groupBy(*keys, "x").agg(F.count("*").alias("n")), keys, "x", ["n"])
    spans = ranks.interval(ranks.median_resamples(values, keys, resamples, seed, least), keys, "median")
    known = values.groupBy(*keys).agg(ranks.median_of("x", "n").alias("median"), F.max("n_total").alias("n"))
    return known.join(spans, keys, "left").select(*keys, F.when(F.col("n") >= least, F.col("median")).alias("median"), "low", "high")


def ecdf(rows: DataFrame, group: str, x: str) -> DataFrame:
    """(group, x, n, share): one row for each distinct value, share of values up to it."""
    n = rows.filter(F.col(x).isNotNull()).groupBy(group, x).agg(F.count("*").alias("n"))
    upto = (F.col("n_before") + F.col("n")) / F.col("n_total").cast("double")
    return ranks.cumulated(n, [group], x, ["n"]).select(group, x, "n", upto.alias("share"))


def log_bin(x: Column, low: float = 2.0, high: float = 7.5, bins: int = 49) -> Column:
    """The number, from 1, of the bin of log10 x; the top edge belongs to the last; null outside."""
    b = F.width_bucket(F.log10(F.when(x > 0, x)), F.lit(low), F.lit(high), F.lit(bins))
    return F.when(F.log10(F.when(x > 0, x)) == high, bins).when((b >= 1) & (b <= bins), b)
