"""Order statistics and bootstraps in ranges: no task sees all values of a key, and results do not depend on the ranges."""

import numpy as np
import pytest

from siltstone.operators import ranks, stats


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    rows = [("wide", c, float(x)) for c, shift in (("clean", 0), ("profane", 30)) for x in rng.integers(shift, shift + 900, 1500)]
    rows += [("flat", c, 7.0) for c in ("clean", "profane") for _ in range(40)] + [("hot", c, float(x)) for c in ("clean", "profane") for x in [5] * 900 + list(range(100))]
    return rows + [("few", "clean", 1.0), ("one side", "clean", 1.0), ("one side", "clean", 2.0), (None, "clean", 4.0), ("wide", "other", 1.0)]


@pytest.fixture(scope="module")
def long(spark, sample):
    return spark.createDataFrame(sample, "metric string, cohort string, x double")


def of(sample, metric, cohort):
    return np.array([x for m, c, x in sample if m == metric and c == cohort])


@pytest.mark.parametrize("ranges", ["1", "3", "16"])
def test_ranks_and_medians_in_any_number_of_ranges(spark, sample, long, ranges):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = {r["metric"]: r for r in stats.mann_whitney(long).collect()}
        shares = {(r["metric"], r["x"]): (r["n"], r["share"]) for r in stats.ecdf(long, "metric", "x").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert set(got) == {"wide", "flat", "hot", "few", "one side", None}
    for metric in ("wide", "flat", "hot"):
        a, b = of(sample, metric, "clean"), of(sample, metric, "profane")
        u = float(sum((x > b).sum() + 0.5 * (x == b).sum() for x in a))
        assert (got[metric]["u"], got[metric]["median_1"], got[metric]["median_2"]) == (u, np.median(a), np.median(b))
    assert got["few"]["u"] is None and got["few"]["median_1"] == 1.0 and got["few"]["median_2"] is None and got["one side"]["median_1"] == 1.5
    for (metric, x), (n, share) in shares.items():
        xs = np.array([v for m, _, v in sample if m == metric])
        assert n == (xs == x).sum() and abs(share - (xs <= x).mean()) < 1e-12


def test_no_window_takes_a_metric_alone(long):
    values = stats.by_value(long, "clean", "profane")
    plan = values._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Window")]
    assert windows and all("part#" in line.split("],")[1] for line in windows)
    assert values.select("part").distinct().count() > 1


def test_bootstraps_do_not_depend_on_tasks_and_agree_with_numpy(spark, sample, long):
    first, again = ({r["metric"]: (r["low"], r["high"]) for r in stats.bootstrap_effect(long, resamples=400).collect()} for _ in range(2))
    assert first["few"] == first["one side"] == (None, None) and first["flat"] == (0.0, 0.0) == again["flat"]
    a, b = of(sample, "wide", "clean"), of(sample, "wide", "profane")
    rng, got = np.random.default_rng(0), []
    for _ in range(400):
        x, y = np.sort(rng.choice(a, len(a))), rng.choice(b, len(b))
        less = np.searchsorted(x, y, "left")
        same = np.searchsorted(x, y, "right") - less
        got.append(1 - 2 * (len(x) * len(y) - (less + 0.5 * same).sum()) / (len(x) * len(y)))
    sd = np.std(got)
    for low, high in (first["wide"], again["wide"]):
        assert abs(low - np.quantile(got, 0.025)) < 0.5 * sd and abs(high - np.quantile(got, 0.975)) < 0.5 * sd
    medians = {(r["metric"], r["cohort"]): r for r in stats.bootstrap_median(long.filter("metric IS NOT NULL"), resamples=500).collect()}
    x = of(sample, "wide", "profane")
    got = [np.median(rng.choice(x, len(x))) for _ in range(500)]
    r, sd = medians["wide", "profane"], np.std(got)
    assert r["median"] == np.median(x) and abs(r["low"] - np.quantile(got, 0.025)) < 0.6 * sd and abs(r["high"] - np.quantile(got, 0.975)) < 0.6 * sd
    assert tuple(medians["hot", "clean"])[2:] == (5.0, 5.0, 5.0) and tuple(medians["few", "clean"])[2:] == (None, None, None)


def test_empty(spark, long):
    none = long.limit(0)
    assert not stats.mann_whitney(none).collect() and not stats.bootstrap_effect(none).collect() and not stats.bootstrap_median(none).collect() and not stats.ecdf(none, "metric", "x").collect()


def test_dealing_keeps_every_draw():
    sums = np.array([5, 0, 7, 1000])
    dealt = ranks.dealt_draws("k", 1, sums, 300)
    assert (dealt.sum(1) == 1012).all() and (dealt[:, 1] == 0).all() and np.array_equal(dealt, ranks.dealt_draws("k", 1, sums, 300))
    assert abs(dealt[:, 3].mean() - 1000) < 2
