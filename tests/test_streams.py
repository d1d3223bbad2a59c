"""The archive stream against a local server, killed between two batches; keyed state against the batch merge, late files included."""

import gzip
import json
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from siltstone.operators import rollup
from siltstone.plans.registry import LEXICON
from siltstone.sources import archive
from siltstone.sources.archive_stream import ArchiveStream
from siltstone.streaming import state

NOW = datetime(2024, 1, 2)


def push(repo, name, message, at, who="u"):
    return {"type": "PushEvent", "actor": {"login": who}, "repo": {"id": repo, "name": name}, "created_at": at, "payload": {"commits": [{"message": message, "author": {"email": f"{who}@x"}}, {"message": "more 🎉 trash"}]}}


@pytest.fixture()
def server():
    files = {f"/2024-01-01-{h}.json.gz": gzip.compress(b"\n".join([json.dumps({"h": h, "i": i}).encode() for i in range(h + 1)] + [b"", b"{broken"])) for h in range(7) if h != 3}
    asked = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked.append(self.path)
            body = files.get(self.path)
            self.send_response(200 if body else 404)
            self.end_headers()
            self.wfile.write(body or b"")

        def log_message(self, *_):
            pass

    httpd = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_address[1]}", asked
    httpd.shutdown()


def test_stream_is_killed_between_batches_and_rows_come_once(spark, server, tmp_path):
    base, asked = server
    spark.dataSource.register(ArchiveStream)
    out, checkpoint, held = f"{tmp_path}/out", f"{tmp_path}/checkpoint", []

    def run(fail_at):
        def write(batch, batch_id):
            rows = batch.collect()
            if batch_id == fail_at:
                raise RuntimeError("killed")
            held.append((batch_id, sorted({r["file_id"] for r in rows})))
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

        lines = spark.readStream.format("hourly_archive_stream").options(base=base, first="2024-01-01-00", last="2024-01-01-06", filesPerTrigger="2", checkpoint=checkpoint, retries="1").load()
        query = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    with pytest.raises(Exception, match="killed"):
        run(fail_at=1)
    run(fail_at=None)
    run(fail_at=None)  # nothing is left
    rows = spark.read.parquet(out).collect()
    got = sorted((r["file_id"], r["line_no"], r["value"]) for r in rows)
    want = sorted((f"2024-01-01-{h:02d}", i, v) for h in range(7) if h != 3 for i, v in [*((i, json.dumps({"h": h, "i": i})) for i in range(h + 1)), (h + 2, "{broken")])
    assert got == want and [b for b, _ in held] == [0, 1, 2, 3] and all(len(h) <= 2 for _, h in held)
    assert held[1] == (1, ["2024-01-01-02"]) and asked.count("/2024-01-01-3.json.gz") >= 1  # hour 3 has no file


def test_limits_need_the_checkpoint(spark):
    with pytest.raises(ValueError):
        ArchiveStream({"first": "2024-01-01-00", "base": "x", "filesPerTrigger": "2"}).streamReader(None)
    reader = ArchiveStream({"first": "2024-01-01-00", "base": "x"}).streamReader(None)
    assert reader.initialOffset() == {"hour": 0} and reader.latestOffset()["hour"] > 1000 and len(reader.partitions({"hour": 3}, {"hour": 5})) == 2


def test_keyed_state_takes_late_files_and_restarts(spark, tmp_path):
    files = {
        "2024-01-01-05": [push(1, "o/new", "you 1d10t", "2024-01-01T05:00:00Z", "b"), push(2, "o/two", "fine words here", "2024-01-01T05:10:00Z")],
        "2024-01-01-02": [push(1, "o/old", "scum and moron", "2024-01-01T02:00:00Z", "a")] * 4,  # late
        "2024-01-01-09": [push(3, "o/three", "x", "no time", "")],
    }
    schema = "file_id string, file_bytes bigint, value string, line_no bigint"
    rows = {f: spark.createDataFrame([(f, 1, json.dumps(e), i) for i, e in enumerate(events)], schema) for f, events in files.items()}
    for file_id, frame in rows.items():
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = state.start(spark, spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint", LEXICON, NOW)
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        if file_id == "2024-01-01-05":
            assert {r["repo_id"]: r["first"]["repo_name"] for r in state.latest(spark, f"{tmp_path}/out").collect()} == {1: "o/new", 2: "o/two"}
    scored = archive.commits(archive.parse_lines(rows["2024-01-01-05"].unionByName(rows["2024-01-01-02"]).unionByName(rows["2024-01-01-09"])), NOW, LEXICON)
    want = {r["repo_id"]: r for r in rollup.with_maps(rollup.merge(rollup.partials(scored)), rollup.merged_maps(rollup.counters(scored))).collect()}
    got = {r["repo_id"]: r for r in state.latest(spark, f"{tmp_path}/out").collect()}
    assert set(got) == set(want) == {1, 2, 3}
    for i, r in got.items():
        w = want[i]
        assert all(r[c] == w[c] for c in ("commits", "profanity_hits", "emoji_hits", "emoji_commits", "profanity_rate", "emoji_rate", *rollup.MAPS.values(), "authors")), i
        assert r["first"]["repo_name"] == w["first"]["repo_name"] and r["samples"] == [s["sample"] for s in w["samples"]]
    assert got[1]["first"]["repo_name"] == "o/old" and len(got[1]["samples"]) == 5
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != state.ROCKS
