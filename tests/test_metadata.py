"""Metadata payloads: parsed once for all fields."""

from pyspark.sql import functions as F

from siltstone.plans.registry import NOW
from siltstone.sources import metadata


def test_a_payload_is_parsed_once(spark):
    rows = spark.createDataFrame([(1, '{"size": 7, "language": "Go", "topics": ["a"]}'), (2, "[1]"), (3, "{oops"), (4, None), (5, "{}")], "id int, payload string")
    found = rows.select("id", metadata.metadata(F.col("payload"), F.lit(NOW)).alias("m"))
    got = {r["id"]: r["m"] for r in found.collect()}
    assert got[2] is got[3] is got[4] is None and (got[1]["size_kb"], got[1]["language"], got[1]["topics"]) == (7, "Go", ["a"]) and (got[5]["size_kb"], got[5]["language"], got[5]["topics"]) == (0, None, [])
    flat = found.select("id", "m.size_kb", "m.language", "m.archived", "m.disabled")
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 1, plan
