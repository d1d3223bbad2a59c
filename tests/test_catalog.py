"""Every registered query that has SQL against DuckDB; the rest for rows and a stable schema."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from siltstone.plans import catalog, study_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in catalog.SQL:
        rel = con.sql(catalog.SQL[name])
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert got == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    else:
        assert got


def numpy_interval(draw, resamples):
    """Of a statistic's resamples: its 2.5 and 97.5 % quantiles, and what two runs of so many may differ by."""
    got = np.array([draw() for _ in range(resamples)])
    low, high = np.quantile(got, [0.025, 0.975])
    near = lambda q: max(abs(np.quantile(got, [max(0, q - 0.02), min(1, q + 0.03)]) - np.quantile(got, q)))
    return low, high, near(0.025) + 1e-9, near(0.975) + 1e-9


def agrees(row, want):
    low, high, a, b = want
    return abs(row["low"] - low) <= a and abs(row["high"] - high) <= b


def test_bootstrap_queries_do_all_subsets_like_numpy(spark):
    """Medians are exact; intervals lie within what two runs of numpy's form differ by."""
    long = catalog.metric_frame(spark, SF, "lang").toPandas()
    rng = np.random.default_rng(7)
    panel = {(r["subset"], r["metric"], r["cohort"]): r for r in study_queries.median_panel(spark, SF).collect()}
    groups = {}
    for subset in ["pooled", *long.lang.dropna().unique()]:
        for (metric, cohort), g in long[(long.lang == subset) | (subset == "pooled")].groupby(["metric", "cohort"]):
            groups[subset, metric, cohort] = g.x.to_numpy()
    assert len({k[0] for k in groups}) > 2 and set(panel) == set(groups)
    for k, x in groups.items():
        r = panel[k]
        assert (r["median"], r["low"], r["high"]) == (None, None, None) if len(x) < 5 else r["median"] == np.median(x) and agrees(r, numpy_interval(lambda: np.median(rng.choice(x, len(x))), 2000)), k

    def effect(a, b):
        return 1 - 2 * ((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b))

    rows = {r["metric"]: r for r in study_queries.forest_rows(spark, SF).collect()}
    assert set(rows) == set(catalog.METRICS)
    for metric, r in rows.items():
        a, b = groups["pooled", metric, "clean"], groups["pooled", metric, "profane"]
        assert abs(r["r_rb"] - effect(a, b)) < 1e-12 and agrees(r, numpy_interval(lambda: effect(rng.choice(a, len(a)), rng.choice(b, len(b))), 1000)), metric

    tests = {(r["subset"], r["metric"]): r for r in study_queries.mwu_subsets(spark, SF).collect()}
    joined = {(r["subset"], r["metric"]): r for r in study_queries.per_language_panel(spark, SF).collect()}
    held = {k: v for k, v in study_queries.SUBSETS.items()}
    assert set(joined) == {(s, m) for s in held for m in catalog.METRICS}
    for (subset, metric), r in joined.items():
        of = lambda c: long[(long.metric == metric) & (long.cohort == c) & (long.lang.isin(held[subset]) if held[subset] else True)].x.to_numpy()
        for c, n in (("clean", r["n_clean"]), ("profane", r["n_profane"])):
            x = of(c)
            assert n == len(x) and (r[f"median_{c}"] == np.median(x) if n >= 5 else r[f"median_{c}"] is None), (subset, metric, c)
            assert n < 5 or r[f"low_{c}"] <= np.median(x) <= r[f"high_{c}"]
        if (subset, metric) in tests and tests[subset, metric]["p"] is not None:
            assert abs(r["p"] - tests[subset, metric]["p"]) < 1e-6 and r["significant"] == (r["p"] < 0.01)
