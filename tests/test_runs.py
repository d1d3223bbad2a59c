"""Runs by the settings: a window of hours, cohorts, and study rounds down to the folders that they remove."""

import gzip
import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siltstone import runs
from siltstone.config import Settings

NOW = datetime(2024, 1, 2)
LEXICON = {"en": ["trash"]}
REPO = "id bigint, repo string, rate double, status string, claimed_by string, claimed_at timestamp, archived boolean, disabled boolean, size_kb bigint, failure_reason string, processing_time_sec double"
REPORTS = "repo string, ruff string, bandit string, eslint string, jscpd string, lizard string"


def settings(**given):
    return Settings.from_env({"STORE_URI": "s"} | given)


def repo(i, name, **given):
    row = dict(id=i, repo=name, rate=1.0 / i, status="pending", claimed_by=None, claimed_at=None, archived=None, disabled=None, size_kb=None, failure_reason=None, processing_time_sec=None) | given
    return tuple(row.values())


@pytest.fixture()
def trees(tmp_path):
    files = {"a/x.py": "# TODO trash\nx = 1\n", "a/y.py": "pass\n", "a/z.js": "// no\n", "a/vendor/v.py": "# trash\n", "b/q.js": "/* FIXME\n*/ let q;\n", "c/x.py": "kept = 1\n"}
    for name, body in files.items():
        p = tmp_path / "trees" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    (tmp_path / "trees/e").mkdir()
    return tmp_path / "trees"


def test_rounds(spark, trees):
    rows = [
        repo(1, "a"), repo(2, "b", status="claimed", claimed_by="old", claimed_at=datetime(2024, 1, 1, 23, 39)), repo(3, "c", status="claimed", claimed_by="busy", claimed_at=datetime(2024, 1, 1, 23, 41)),
        repo(4, "d", disabled=True), repo(5, "e"), repo(6, "late"), repo(7, "seen", status="seen"),
    ]
    told = [("a", '[{"code": "F1"}, {"code": "W1"}]', '{"results": []}', '[{"errorCount": 3}]', None, "<oops"), ("b", "[]", None, '[{"errorCount": 3}]', "{}", None), ("c", "[]", None, None, None, None)]
    run = lambda rows, **given: runs.study_round(rows, f"file://{trees}", spark.createDataFrame(told, REPORTS), settings(WORKER_CONCURRENCY="4", **given), "me-1", F.lit(NOW), LEXICON)
    after, found = run(spark.createDataFrame(rows, REPO), CLEANUP_AFTER_REPO="no")
    got = {r["repo"]: r for r in after.collect()}
    assert {k: (r["status"], r["claimed_by"], r["failure_reason"]) for k, r in got.items()} == {
        "a": ("done", "me-1", None), "b": ("done", "me-1", None), "c": ("claimed", "busy", None), "d": ("failed", "me-1", "skip: disabled"), "e": ("failed", "me-1", "git: no files"), "late": ("pending", None, None), "seen": ("seen", None, None),
    }
    assert all((r["processing_time_sec"] is not None) == (r["claimed_by"] == "me-1") for r in got.values())
    rows_ = {r["repo"]: r for r in found.collect()}
    a, b = rows_["a"], rows_["b"]
    assert set(rows_) == {"a", "b"} and len(found.columns) > 40
    assert (a["primary_language"], a["files_scanned"], a["comment_profanity_hits"], a["tech_debt_markers"], a["ruff_issues"], a["ruff_bug_issues"], a["bandit_issues"], a["eslint_issues"], a["lizard_functions"]) == ("python", 3, 1, 1, 2, 1, 0, None, None)
    assert (b["primary_language"], b["ruff_issues"], b["eslint_errors"], b["comment_nloc"]) == ("javascript", None, 3, 2)
    assert sorted(os.listdir(trees)) == ["a", "b", "c", "e"]
    left, none = run(after)
    assert {r["repo"]: r["status"] for r in left.collect()}["late"] == "failed" and none.count() == 0
    run(spark.createDataFrame(rows, REPO))
    assert sorted(os.listdir(trees)) == ["c"]  # claimed by another
    empty, nothing = run(spark.createDataFrame([], REPO))
    assert empty.count() == nothing.count() == 0
    with pytest.raises(ValueError, match="at most"):
        runs.study_round(after, str(trees), nothing, settings(WORKER_CONCURRENCY="1001"), "me", F.lit(NOW), LEXICON)


def test_folders_outside_are_not_removed(spark, trees):
    names = spark.createDataFrame([("..",), ("a/vendor",), (".",), ("",), (None,), ("b",), ("none",)], "repo string")
    assert runs.removed(spark, f"file://{trees}", names) == 1 and sorted(os.listdir(trees)) == ["a", "c", "e"] and (trees / "a/vendor/v.py").exists()


def test_window(spark, tmp_path):
    def push(who, message):
        return {"type": "PushEvent", "actor": {"login": who}, "repo": {"id": 1, "name": "r"}, "created_at": "2024-01-01T00:00:00Z", "payload": {"commits": [{"message": message, "author": {"email": who}}]}}

    for hour in range(4):
        body = "\n".join(json.dumps(push(who, f"trash {hour} 🎉 🚀")) for who in ("ann", "helper", "ci-bot"))
        (tmp_path / f"2024-01-01-{hour}.json.gz").write_bytes(gzip.compress(body.encode()))
    run = lambda name, **given: runs.ingest_window(spark, settings(**given), f"{tmp_path}/*.gz", f"{tmp_path}/{name}", f"{tmp_path}/{name}-checkpoint", LEXICON, NOW).collect()
    (r,) = run("some", GHA_START="2024-01-01-01", GHA_END="2024-01-01-02", BOT_REGEX="HELPER|bot", SAMPLE_PROFANE_N="2", EMOJI_TOP_N="1")
    assert (r["commits"], r["authors"], len(r["samples"]), r["emoji_hits"]) == (2, ["ann"], 2, 4)
    maps = [v for v in r.asDict().values() if isinstance(v, dict)]
    assert maps and all(len(m) <= 1 for m in maps)
    assert run("none", GHA_START="2023-01-01-01", GHA_END="2023-01-01-02") == []


def test_cohorts_by_settings(spark):
    rows = [(i, "seen", 30 + 40 * (i % 3), i % 2, (i % 2) / (i + 1.0), None) for i in range(40)]
    repos = spark.createDataFrame(rows, "id bigint, status string, commits bigint, hits bigint, rate double, cohort string")
    after, report = runs.draw(repos, settings(PROFANE_COHORT_SIZE="6", CLEAN_COHORT_SIZE="4", SAMPLING_COMMIT_BINS="20,50,80"))
    assert {(r["cohort"], r["count"]) for r in after.groupBy("cohort").count().collect()} == {("profane", 6), ("clean", 4), (None, 30)}
    assert sum(r["target"] for r in report.collect()) == 4
