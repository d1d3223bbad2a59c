"""Scalar tables, archive parsing, sampling fixtures, report parsers, streaming restarts."""

import gzip
import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import analyze, lifecycle, rollup, sampling, stats
from siltstone.sources import archive, lexicon, metadata, reports, tree
from siltstone.streaming import ingest

NOW = datetime(2020, 6, 1)
WORDS = {"en": ["damn", "ass"], "ru": ["блин"]}


def column(spark, values, f, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r[1] for r in sorted(spark.createDataFrame(rows, f"i int, v {kind}").select("i", f(F.col("v"))).collect())]


def test_lexicon_scan(spark):
    texts = ["Damn damn ASS", "class assess", "d4mn", "a$$ 455", None, "", "блин damn"]
    got = column(spark, texts, lambda c: T.lexicon_hits(c, F.lit("en"), WORDS))
    assert got == [["ass", "damn"], [], ["damn"], ["ass"], [], [], ["damn"]]
    assert column(spark, ["блин damn"], lambda c: T.lexicon_hits(c, F.lit("ru"), WORDS)) == [["damn", "блин"]]


def test_emoji(spark):
    got = column(spark, ["🎉 x 🎉", "👍🏽", "❤️", "👩‍💻!", "🇺🇸🇫🇷", "1️⃣", ":tada:", "plain 123 #", "🏽"], T.emoji)
    assert got == [["🎉", "🎉"], ["👍"], ["❤"], ["👩‍💻"], ["🇺🇸", "🇫🇷"], ["1⃣"], [], [], []]


def test_markers_language_bots(spark):
    assert column(spark, ["TODO FIXME", "todo TODOS", "HACK: XXX", None], T.marker_count) == [2, 0, 2, 0]
    assert column(spark, ["short", "der und die nicht das ist gut", "the end of the story is near"], T.detect_language) == ["en", "de", "en"]
    assert column(spark, ["x[bot]", "Renovate", "alice", None, "", "my-robot"], T.is_bot) == [True, True, False, False, False, True]
    assert spark.range(1).select(T.is_bot(F.lit("alice"), F.lit("Bot"))).first()[0]


def test_file_ids(spark):
    got = archive.file_ids(spark, "2020-06-01-23", "2020-06-02-01").collect()
    assert [r["file_id"] for r in got] == ["2020-06-01-23", "2020-06-02-00", "2020-06-02-01"] and got[1]["url_hour"] == "2020-06-02-0"
    with pytest.raises(ValueError):
        archive.file_ids(spark, "2020-06-02-00", "2020-06-01-00")
    assert column(spark, ["2020-06-01-7", "2020-06-01-17", "x"], archive.parse_file_id) == [datetime(2020, 6, 1, 7), datetime(2020, 6, 1, 17), None]


def push(repo, *messages, login="alice", kind="User", name=None):
    commits = [{"message": m, "author": {"email": "a@x", "name": "A"}} if isinstance(m, str) else m for m in messages]
    return {"type": "PushEvent", "created_at": "2020-06-01T12:00:00Z", "actor": {"id": 1, "login": login, "type": kind}, "repo": {"id": repo, "name": name or f"o/{repo}"}, "payload": {"commits": commits}}


FILES = {
    "2020-06-01-0": [push(1, "damn fix 🎉🎉"), push(2, "fine"), push(3, "damn", login="x[bot]"), {"type": "WatchEvent"}, "bad line {", push("9", "damn"), push(1, 7, {"message": 5}, {"message": ""})],
    "2020-06-01-1": [push(2, "x" * 300 + " damn"), push(4, "damn ass", {"message": "no author"})],
}


def land(path, name, rows):
    with gzip.open(f"{path}/{name}.json.gz", "wt") as f:
        f.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def test_archive_batch_and_stream(spark, tmp_path):
    src, out, ck = tmp_path / "src", f"file://{tmp_path}/out", f"file://{tmp_path}/ck"
    src.mkdir()
    land(src, "2020-06-01-0", FILES["2020-06-01-0"])
    ingest.start(spark, f"file://{src}", out, ck, WORDS, NOW).awaitTermination()
    first = {r["repo_id"]: r for r in ingest.repositories(spark, out).collect()}
    assert set(first) == {1, 2}
    land(src, "2020-06-01-1", FILES["2020-06-01-1"])
    ingest.start(spark, f"file://{src}", out, ck, WORDS, NOW).awaitTermination()
    ingest.start(spark, f"file://{src}", out, f"{ck}-replayed", WORDS, NOW).awaitTermination()  # every file once more
    got = {r["repo_id"]: r for r in ingest.repositories(spark, out).collect()}
    assert set(got) == {1, 2, 4} and got[2]["commits"] == 2 and got[1]["emoji_hits"] == 2 and got[1]["emoji_commits"] == 1
    assert got[4]["profanity_hits"] == 2 and got[4]["authors"] == ["a@x", "alice"] and got[4]["profanity_rate"] == 1.0
    ledger = {str(r["file_id"]): r for r in spark.read.parquet(f"{out}/ledger").collect()}
    r = ledger["2020-06-01-00"]
    assert (r["rows"], r["push_events"], r["bots_filtered"], r["commits_observed"]) == (7, 4, 1, 2)
    lines = archive.read_lines(spark, f"file://{src}")
    batch = rollup.merge(rollup.partials(archive.commits(archive.parse_lines(lines), NOW, WORDS)))
    same = ("repo_id", "commits", "profanity_hits", "emoji_hits", "authors")
    assert sorted(batch.select(*same).collect()) == sorted(ingest.repositories(spark, out).select(*same).collect())
    assert [x['sample'] for x in got[2]['samples']] == ['x' * 200]


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "en").write_text("Damn\n\n# note\n ass \ndamn\n")
    (tmp_path / "README.md").write_text("word\n")
    assert lexicon.as_map(lexicon.read_lexicon(spark, f"file://{tmp_path}")) == {"en": ["ass", "damn"]}


def cohort_fixture(spark):
    rows, i = [], 0
    for edge, top in ((20, 49), (50, 199), (200, 999), (1000, 5000)):
        for k in range(250):
            i += 1
            hits = 5 if k < 50 else 0
            rows.append((i, edge + k % (top - edge), hits, (0.9 if k < 50 else 0.0) - 0.005 * (k if k < 50 else 0), "seen", None))
    return spark.createDataFrame(rows, "id bigint, commits bigint, hits bigint, rate double, status string, cohort string")


def test_sampling(spark):
    repos = cohort_fixture(spark)
    out, report = sampling.run(repos, 200, 200)
    assert {r["bin"]: (r["target"], r["drawn"], r["shortfall"]) for r in report.collect()} == {b: (50, 50, 0) for b in (20, 50, 200, 1000)}
    n = {(r["status"], r["cohort"]): r["count"] for r in out.groupBy("status", "cohort").count().collect()}
    assert n == {("pending", "profane"): 200, ("pending", "clean"): 200, ("skipped", None): 600}
    few = repos.filter("NOT (commits >= 1000 AND hits = 0 AND id % 250 >= 60)")
    assert {r["bin"]: r["shortfall"] for r in sampling.run(few, 200, 200)[1].collect()}[1000] == 40
    again, gaps = sampling.top_up(out.withColumn("status", F.when(F.col("id") % 10 == 0, "missing").otherwise(F.col("status"))), 200, 200)
    assert gaps["profane"] == 20 and again.count() == 1000
    assert sampling.profane(repos, 0).count() == 0
    with pytest.raises(ValueError):
        sampling.Sampling(bins=(5, 1))


def test_report_parsers(spark):
    ruff = json.dumps([{"code": c, "fix": f} for c, f in (("F401", {}), ("E999", None), ("B1", {}), ("SIM1", {}), ("E501", None), ("W1", {}), ("UP1", None), ("N1", None))])
    assert tuple(column(spark, [ruff], reports.ruff)[0]) == (8, 4, 4, 4)
    assert column(spark, ["nope", None], reports.ruff) == [None, None]
    assert tuple(column(spark, ['{"results":[{"issue_severity":"HIGH"},{"issue_severity":"LOW"}]}'], reports.bandit)[0]) == (2, 1)
    assert tuple(column(spark, ['[{"errorCount":2,"warningCount":3,"fatalErrorCount":1},{"errorCount":1,"fixableErrorCount":1}]'], reports.eslint)[0]) == (6, 3, 3, 1, 1, 0)
    assert tuple(column(spark, ["[]"], reports.eslint)[0]) == (0, 0, 0, 0, 0, 0)
    assert tuple(column(spark, ['{"statistics":{"total":{"lines":100,"duplicatedLines":25}}}'], reports.jscpd)[0]) == (25, 100, 0.25)
    xml = lambda *v: '<?xml version="1.0"?><cppncss><measure type="Function"><labels><label>Nr.</label><label>NCSS</label><label>CCN</label></labels>' + "".join(f"<item><value>1</value><value>{n}</value><value>{c}</value></item>" for n, c in v) + "</measure></cppncss>"
    odd = xml((1, 1), ("x", 9), (3, "1.5"), (5, 2)).replace("NCSS", "NLOC").replace("</measure>", "<item><value>1</value></item></measure><measure type='Function'><item><value>9</value></item></measure>")
    given = [xml((10, 1), (20, 2), (30, 3), (40, 4), (50, 5)), xml((7, 3)), "<broken", None, "", xml(), xml((1, 2)).replace("CCN", "none"), xml((1, 2)) + "<", odd, "<cppncss/>"]
    rows = reports.lizard(spark.createDataFrame(list(enumerate(given)), "id int, report string"), "report").orderBy("id").select(*reports.LIZARD).collect()
    assert tuple(rows[0]) == (3.0, 5, 5, 3.0, 4.6, 4.96, 46) and tuple(rows[1]) == (3.0, 3, 1, None, None, None, None)
    assert all(v is None for r in (*rows[2:8], rows[9]) for v in r) and tuple(rows[8])[:3] == (1.5, 2, 2) and rows[8]["lizard_nloc_p90"] == 4


def test_scoring_compiles(spark):
    """The generated code of the whole scoring stage is small enough to compile, with all of the languages' word lists."""
    from siltstone.plans import ingest_queries

    keep = {k: spark.conf.get(k) for k in ("spark.sql.codegen.fallback", "spark.sql.codegen.factoryMode")}
    spark.conf.set("spark.sql.codegen.fallback", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
    try:
        parsed = archive.parse_lines(ingest_queries.lines(spark, "/root/testdata/sf0.001"))
        many = {code: [f"{code}{i}" for i in range(110)] for code in T.COMMON_WORDS}
        assert archive.commits(parsed, NOW, many).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_samples_are_limited_before_they_are_collected(spark):
    rows = spark.createDataFrame([("f", i % 3, i, 0, f"m{i}") for i in range(60)], "file_id string, repo_id int, line_no int, pos int, sample string").withColumn("at", F.struct("file_id", "line_no", "pos"))
    first = rollup.first_samples(rows, ["file_id", "repo_id"], 5)
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # before the shuffle and after it
    assert {r["repo_id"]: [s["sample"] for s in r["samples"]] for r in first.collect()} == {k: [f"m{i}" for i in range(k, 15, 3)] for k in range(3)}


def test_complexity_reports_take_one_parse(spark):
    """Ten thousand reports, and one XML expression in the plan however often its columns are used."""
    item = "".join(f"<item><value>{i}</value><value>{i % 7}</value></item>" for i in range(8))
    xml = f"<cppncss><measure type='Function'><labels><label>NCSS</label><label>CCN</label></labels>{item}</measure></cppncss>"
    rows = reports.lizard(spark.range(10_000).withColumn("report", F.lit(xml)), "report").filter("lizard_functions IS NOT NULL")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_xml") <= 1
    began = time.time()
    assert rows.filter("lizard_max_ccn = 6 AND lizard_functions = 8").count() == 10_000 and time.time() - began < 20


def test_odd_tools(spark):
    assert reports.run_tool(["/no/such/tool"], 1) is None


def test_tree_scan_and_compose(spark, tmp_path):
    for name, body in {"a.py": '"""doc"""\n# damn TODO 🎉\nx = "# no"\n', "b.js": 'let u = "http://x"; // ass\n', "node_modules/c.js": "// damn", "d.min.js": "//", "e.unknown": "one\n\ntwo"}.items():
        p = tmp_path / "r" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    files = tree.read_tree(spark, f"file://{tmp_path}/r").withColumn("language", tree.language_of(F.col("path"))).withColumn("repo", F.lit(1))
    got = tree.scan(files, ["repo"], WORDS).first()
    assert (got["files_scanned"], got["loc_total"], got["comment_nloc"], got["comment_profanity_hits"], got["comment_emoji_hits"], got["tech_debt_markers"]) == (3, 6, 2, 2, 1, 1)
    assert tree.primary_language(files, ["repo"]).first()["primary_language"] == "javascript"
    tools = spark.createDataFrame([(1, "[{}]", None, None, None, None)], "repo int, ruff string, bandit string, eslint string, jscpd string, lizard string")
    row = analyze.compose(tree.scan(files, ["repo"], WORDS), tools, "repo").first()
    assert row["ruff_issues"] == 1 and row["ruff_issues_per_kloc"] == 1 / 0.006 and row["eslint_issues"] is None
    assert len(row.asDict()) - 1 == 42 and row['emoji_top'] == {'🎉': 1}


def test_metadata(spark):
    payload = json.dumps({"stargazers_count": 3, "size": 10, "license": {"spdx_id": "MIT"}, "archived": True, "topics": ["a"], "created_at": "2020-01-01T00:00:00Z", "parent": None})
    m = column(spark, [payload], lambda c: metadata.metadata(c, F.lit(NOW)))[0]
    assert m["stargazers_count"] == 3 and m["license_spdx"] == "MIT" and m["topics"] == ["a"] and m["parent_full_name"] is None and m["archived"] and m["created_at"] == datetime(2020, 1, 1)
    assert column(spark, ['{"Go": 5, "C": "x"}'], metadata.language_bytes) == [{"Go": 5}]


def test_lifecycle(spark):
    rows = spark.createDataFrame([("seen", "promote"), ("pending", "claim"), ("claimed", "done"), ("done", "claim"), ("done", "missing")], "status string, event string")
    assert [r[0] for r in rows.select(lifecycle.step(F.col("status"), F.col("event"), lifecycle.REPO)).collect()] == ["pending", "claimed", "done", "done", "missing"]
    jobs = spark.createDataFrame([(1, "pending", 0.5, None), (2, "pending", 0.9, None), (3, "done", 1.0, "w")], "id int, status string, rate double, claimed_by string")
    assert lifecycle.claim_next(jobs, "me").first()["id"] == 2


def test_statistics(spark):
    a, b = [1.0, 2.0, 2.0, 3.0, 4.0, 5.0], [2.0, 3.0, 6.0, 7.0, 8.0, 9.0]
    long = spark.createDataFrame([("m", "clean", x) for x in a] + [("m", "profane", x) for x in b] + [("few", "clean", 1.0)], "metric string, cohort string, x double")
    got = {r["metric"]: r for r in stats.mann_whitney(long).collect()}
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert got["m"]["u"] == u and got["m"]["r_rb"] == 1 - 2 * u / 36 and 0 < got["m"]["p"] < 0.1
    assert got["few"]["u"] is None and got["few"]["p"] is None
    ci = stats.bootstrap_effect(long.filter("metric = 'm'"), resamples=100).first()
    assert ci["low"] <= got["m"]["r_rb"] <= ci["high"]
    assert column(spark, [100.0, 10**7.5, 99.0, 0.0, 10**8.0], stats.log_bin, "double") == [1, 49, None, None, None]
