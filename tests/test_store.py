"""The stored repositories: an update rewrites the parts that it touches, and does not shuffle what is stored."""

import uuid

import pytest
from pyspark.sql import functions as F

from siltstone.operators import store


@pytest.fixture()
def repos(spark):
    s = store.Store(spark, f"repos_{uuid.uuid4().hex}", "id", parts=16, buckets=2)
    s.create(spark.range(2000).select("id", (F.col("id") % 7).alias("commits"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("claimed_by"), F.array(F.lit("a")).alias("authors")))
    yield s
    spark.sql(f"DROP TABLE {s.name}")


def files(spark, s):
    return {r["f"]: r["p"] for r in spark.table(s.name).select(F.input_file_name().alias("f"), F.col(store.PART).alias("p")).distinct().collect()}


def test_untouched_parts_keep_their_files(spark, repos):
    before = files(spark, repos)
    delta = spark.createDataFrame([(5, 10, "seen", ["b", "a"]), (9, 1, "seen", ["c"]), (5000, 3, "seen", ["z"])], "id bigint, commits bigint, status string, authors array<string>")
    parts = repos.touched(delta)
    report = store.upsert(repos, delta, ["commits"], ("authors",))
    after = files(spark, repos)
    assert report == {"parts_rewritten": len(parts), "parts": 16} and 1 <= len(parts) <= 3
    assert {f for f, p in before.items() if p not in parts} == {f for f, p in after.items() if p not in parts}
    assert not {f for f, p in before.items() if p in parts} & set(after)
    assert max(sum(q == p for q in after.values()) for p in parts) <= 2  # one file a bucket
    got = {r["id"]: r for r in repos.rows().collect()}
    assert len(got) == 2001 and (got[5]["commits"], got[5]["status"], got[5]["authors"]) == (15, "pending", ["a", "b"]) and (got[9]["commits"], got[9]["authors"]) == (3, ["a", "c"])
    assert (got[5000]["commits"], got[5000]["status"], got[5000]["claimed_by"], got[5000]["authors"]) == (3, "seen", None, ["z"])
    assert all(got[i]["commits"] == i % 7 for i in range(2000) if i not in (5, 9))


def test_compare_and_set(spark, repos):
    claims = spark.createDataFrame([(i, "claimed", "me") for i in (1, 2, 3, 9999)], "id bigint, status string, claimed_by string")
    store.set_where(repos, claims, ["status", "claimed_by"], F.col("old.status") == "pending")
    store.set_where(repos, spark.createDataFrame([(1, "done", "me"), (2, "done", "other"), (4, "done", "me")], "id bigint, status string, claimed_by string"), ["status"], (F.col("old.status") == "claimed") & (F.col("old.claimed_by") == F.col("new.claimed_by")))
    got = {r["id"]: (r["status"], r["claimed_by"]) for r in repos.rows().collect()}
    assert len(got) == 2000 and [got[i] for i in (1, 2, 3, 4)] == [("done", "me"), ("claimed", "me"), ("claimed", "me"), ("pending", None)]
    assert store.set_where(repos, claims.limit(0), ["status"], F.lit(True))["parts_rewritten"] == 0 and repos.rows().count() == 2000


def test_the_stored_side_is_not_shuffled(spark, repos):
    delta = spark.range(3).select("id", F.lit(1).alias("commits"))
    parts = repos.touched(delta)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = repos.joined(delta, parts)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    at = plan.index("FileScan parquet")
    above = plan[:at].splitlines()[-4:]
    assert plan.count("Exchange") == 1 and not any("Exchange" in line for line in above) and f"{store.PART}" in plan[at:] and "PartitionFilters" in plan[at:], plan
