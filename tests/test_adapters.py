"""Settings, HTTP, version control, tools and the worker, each against a stand-in."""

import gzip
import json
import shutil
import subprocess
import threading
import time
from datetime import timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from siltstone import config
from siltstone.operators import lifecycle, reports, sampling, worker
from siltstone.sources import git, http, lexicon, tree


def test_settings():
    plain = config.Settings.from_env({"STORE_URI": "s"})
    assert plain.commit_bins == (20, 50, 200, 1000) and plain.repo_timeout == timedelta(seconds=600) and plain.claim_ttl == timedelta(minutes=20)
    assert plain.clean_up and plain.bots.search("my-ROBOT") and plain.sampling().min_commits == 20 and len(config.fields(plain)) == 20
    given = config.Settings.from_env({"STORE_URI": "s", "CLEANUP_AFTER_REPO": "Off", "SAMPLING_COMMIT_BINS": " 1, 5 ,", "WORKER_CONCURRENCY": "3"})
    assert not given.clean_up and given.commit_bins == (1, 5) and given.workers == 3
    for bad in ({}, {"STORE_URI": ""}, {"STORE_URI": "s", "CLEANUP_AFTER_REPO": "maybe"}, {"STORE_URI": "s", "SAMPLING_COMMIT_BINS": "5,5"}, {"STORE_URI": "s", "SAMPLING_COMMIT_BINS": "0,5"}, {"STORE_URI": "s", "BOT_REGEX": "("}):
        with pytest.raises(ValueError):
            config.Settings.from_env(bad)


def answers(*given):
    """A stand-in for the network that gives these answers, and the pauses made between them."""
    left, pauses = list(given), []

    def opened(url, headers, timeout):
        got = left.pop(0)
        if isinstance(got, Exception):
            raise got
        return got

    return {"opened": opened, "sleep": pauses.append}, pauses


def test_patient_get():
    how, pauses = answers((429, {"retry-after": "7"}, b""), (503, {}, b""), OSError("gone"), (200, {}, b"body"))
    assert http.get("u", **how) == b"body" and pauses == [7.0, 2.0, 4.0]
    how, pauses = answers(*[(500, {}, b"")] * 8)
    with pytest.raises(RuntimeError):
        http.get("u", retries=6, **how)
    assert pauses == [1.0, 2.0, 4.0, 8.0, 16.0, 30.0]
    assert http.get("u", **answers((404, {}, b""))[0]) is None
    with pytest.raises(RuntimeError):
        http.get("u", **answers((401, {}, b""))[0])


def test_client_minds_the_limit():
    ask = lambda *given: (lambda how, pauses: (http.Client("b", "t", now=lambda: 100.0, **how).json("x"), pauses))(*answers(*given))
    assert ask((200, {"x-ratelimit-remaining": "500"}, b'{"a": 1}')) == ({"a": 1}, [])
    assert ask((200, {"x-ratelimit-remaining": "99", "x-ratelimit-reset": "110"}, b"[]")) == ([], [10.0])
    assert ask((403, {"x-ratelimit-remaining": "0", "x-ratelimit-reset": "900"}, b""), (200, {}, b"1")) == (1, [60.0])
    assert ask((429, {"retry-after": "3"}, b""), (429, {}, b"")) == (None, [3.0])
    assert ask((404, {}, b"")) == (None, []) and ask((200, {}, b"oops")) == (None, []) and ask(OSError("x"), OSError("x")) == (None, [1.0])


@pytest.fixture(scope="module")
def server():
    files = {"/2020-06-01-0.json.gz": gzip.compress(b'{"a": 1}\n\nbad'), "/2020-06-01-2.json.gz": gzip.compress(b"[2]"), "/rev/en": b"Damn\n# no\n\nass\n"}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            body = files.get(self.path)
            self.send_response(200 if body else 404)
            self.end_headers()
            self.wfile.write(body or b"")

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_archive_source_and_lexicon_fetch(spark, server):
    spark.dataSource.register(http.ArchiveSource)
    rows = spark.read.format("hourly_archive").options(first="2020-06-01-00", last="2020-06-01-02", base=server).load().collect()
    assert sorted((r["file_id"], r["line_no"], r["value"]) for r in rows) == [("2020-06-01-00", 0, '{"a": 1}'), ("2020-06-01-00", 2, "bad"), ("2020-06-01-02", 0, "[2]")]
    assert lexicon.as_map(lexicon.fetch(spark, server, "rev", ["en", "xx"])) == {"en": ["ass", "damn"]}


@pytest.mark.skipif(not shutil.which("git"), reason="needs git")
def test_git_steps(tmp_path):
    home = tmp_path / "origin"
    home.mkdir()
    env = {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@x", "PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(tmp_path)}
    run = lambda *a, at="2020-06-01T00:00:00Z": subprocess.run(["git", *a], cwd=home, env=env | {"GIT_AUTHOR_DATE": at, "GIT_COMMITTER_DATE": at}, check=True, capture_output=True)
    run("init", "-q")
    for text, at in (("one", "2020-06-01T00:00:00Z"), ("two", "2020-07-01T00:00:00Z")):
        (home / "f").write_text(text)
        run("add", "f")
        run("commit", "-q", "-m", text, at=at)
    clone = str(tmp_path / "clone")
    git.partial_clone(f"file://{home}", clone, 20)
    sha = git.sha_before(clone, "2020-06-15T00:00:00Z", 20)
    git.checkout(clone, sha, 20)
    assert (tmp_path / "clone" / "f").read_text() == "one" and git.sha_before(clone, "2019-01-01T00:00:00Z", 20) is None
    with pytest.raises(worker.GitError):
        git.partial_clone(f"file://{tmp_path}/nothing", str(tmp_path / "x"), 20)


def test_worker(spark):
    def step(row):
        if row["id"] == 1:
            raise worker.Skip("archived")
        if row["id"] == 2:
            raise KeyError("k" * 500)
        if row["id"] == 3:
            time.sleep(3)
        return f"r{row['id']}"

    cleaned = []
    assert worker.attempt(step, {"id": 1}, 1, cleaned.append)[:3] == (False, "skip: archived", None) and cleaned == [{"id": 1}]
    assert worker.attempt(step, {"id": 3}, 0.05)[1] == "timeout" and len(worker.attempt(step, {"id": 2}, 1)[1]) == len("KeyError: ") + worker.DETAIL
    jobs = spark.createDataFrame([(k, "pending", k / 10, "w") for k in range(5)], "id bigint, status string, rate double, claimed_by string")
    waves, settled = [jobs.filter("id < 3"), jobs.filter("id >= 3"), jobs.limit(0)], []
    assert worker.drain(lambda: waves.pop(0), lambda out: settled.extend(out.collect()), step, timeout=0.05) == 5
    assert {r["id"]: r["reason"] and r["reason"].split(":")[0] for r in settled} == {0: None, 1: "skip", 2: "KeyError", 3: "timeout", 4: None}
    stop = threading.Event()
    stop.set()
    assert worker.drain(lambda: jobs, lambda out: None, step, stop) == 0

    def broken():
        raise ValueError

    assert worker.run_all({"a": lambda: 1, "b": broken}, {"a": 0, "b": -1, "c": -2}) == {"a": 1, "b": -1, "c": -2}


def test_small_rules(spark, tmp_path):
    conf = sampling.Sampling()
    assert conf.bounds(20) == (20, 50) and conf.bounds(1000) == (1000, None)
    with pytest.raises(ValueError):
        conf.bounds(7)
    with pytest.raises(ValueError):
        reports.database_guard("production")
    row = spark.range(1).select(lifecycle.worker_id(F.lit("h"), F.lit(3)).alias("w")).select("w", lifecycle.scratch_path("/s/", F.lit(9), F.col("w")).alias("p")).first()
    assert tuple(row) == ("h-3", "/s/h-3-9")
    for name in ("a[1]/x.py", "a[1]/node_modules/y.py", "b c/z.min.js", "b c/w.js"):
        p = tmp_path / "t" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    got = tree.read_tree(spark, f"file://{tmp_path}/t").collect()
    assert sorted(r["path"].split("/t/")[1] for r in got) == ["a[1]/x.py", "b c/w.js"]
    reports.results_json({"rows": spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), "none": spark.createDataFrame([], "a int")}, f"file://{tmp_path}/r", alpha=0.05, name='q"x')
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("part-*"))
    assert json.loads(text) == {"alpha": 0.05, "name": 'q"x', "rows": [{"a": 1, "b": None}, {"a": 2, "b": "x"}], "none": []}
