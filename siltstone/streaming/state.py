"""Repositories as running state: a stream's commits update each repository's totals, maps, authors and samples in RocksDB,
and every batch tells the repositories that it changed."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltstone.functions.text import rate
from siltstone.operators import rollup
from siltstone.sources import archive

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
AT = "seen bigint, file_id string, line_no bigint, pos int, repo_name string"
TOTALS = "commits bigint, profanity_hits bigint, emoji_hits bigint, emoji_commits bigint"
SAMPLE = "file_id string, line_no bigint, pos int, sample string"
STATE = f"repo_id bigint, {TOTALS}, first struct<{AT.replace(' ', ': ').replace(',:', ',')}>, authors array<string>, samples array<string>, " + ", ".join(f"{c} map<string, bigint>" for c in rollup.MAPS.values())


class Repository(StatefulProcessor):
    """State of one repository. A batch's rows are summed first, so each state is written once a batch; what is kept does not
    depend on the order of files, so a late file changes what it must and nothing else."""

    def __init__(self, samples: int = 5):
        self.most = samples

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", TOTALS)
        self.first = handle.getValueState("first", AT)
        self.counts = handle.getMapState("counts", "kind string, key string", "n bigint")
        self.authors = handle.getMapState("authors", "author string", "seen boolean")
        self.samples = handle.getListState("samples", SAMPLE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new, counted, authors = [0, 0, 0, 0], Counter(), set()
        first = tuple(self.first.get()) if self.first.exists() else None
        samples = {tuple(s) for s in self.samples.get()} if self.samples.exists() else set()
        for r in rows:
            new = [new[0] + 1, new[1] + len(r.hits), new[2] + len(r.glyphs), new[3] + (len(r.glyphs) > 0)]
            at = (r.seen, r.file_id, r.line_no, r.pos, r.repo_name)
            first = at if first is None else min(first, at)
            counted.update([("languages", r.language), *(("words", h) for h in r.hits), *(("glyphs", g) for g in r.glyphs)])
            if r.author is not None:
                authors.add(r.author)
            if r.sample is not None:
                samples.add((r.file_id, r.line_no, r.pos, r.sample))
                if len(samples) > 64:
                    samples = set(sorted(samples)[: self.most])
        old = tuple(self.totals.get()) if self.totals.exists() else (0, 0, 0, 0)
        totals = tuple(a + b for a, b in zip(old, new))
        self.totals.update(totals)
        self.first.update(first)
        for k, n in counted.items():
            self.counts.updateValue(k, ((self.counts.getValue(k)[0] if self.counts.containsKey(k) else 0) + n,))
        for a in authors:
            self.authors.updateValue((a,), (True,))
        kept = sorted(samples)[: self.most]
        if kept:
            self.samples.put(kept)
        maps = {kind: {} for kind in rollup.MAPS}
        for (kind, name), (n,) in self.counts.iterator():
            maps[kind][name] = n
        yield Row(repo_id=key[0], **dict(zip(("commits", "profanity_hits", "emoji_hits", "emoji_commits"), totals)), first=first, authors=sorted(a for (a,) in self.authors.keys()), samples=[s[3] for s in kept], **{c: maps[kind] for kind, c in rollup.MAPS.items()})

    def close(self) -> None:
        pass


def repositories(lines: DataFrame, lexicon: dict[str, list[str]], now: datetime) -> DataFrame:
    """A streaming frame of STATE rows, one for each repository that a batch changes, from lines like archive.read_lines."""
    commits = archive.commits(archive.parse_lines(lines), now, lexicon)
    rows = commits.select("repo_id", F.unix_micros("seen_at").alias("seen"), "file_id", "line_no", "pos", "repo_name", "author", "language", "hits", "glyphs", "sample")
    return rows.groupBy("repo_id").transformWithState(statefulProcessor=Repository(), outputStructType=STATE, outputMode="Update", timeMode="None")


def start(spark: SparkSession, lines: DataFrame, out: str, checkpoint: str, lexicon: dict[str, list[str]], now: datetime):
    """Write each batch's changed repositories below out, a folder for each batch, which a batch that runs again overwrites.

    The number of state partitions is the session's shuffle partitions when the query first starts.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the query keeps the session's settings of its start
    try:
        return repositories(lines, lexicon, now).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The last state of each repository, with rates."""
    told = spark.read.parquet(out)
    cols = [c for c in told.columns if c not in ("repo_id", "batch")]
    last = told.groupBy("repo_id").agg(F.max_by(F.struct(*cols), "batch").alias("s")).select("repo_id", "s.*")
    return last.withColumns({"profanity_rate": rate(F.col("profanity_hits"), F.col("commits")), "emoji_rate": rate(F.col("emoji_hits"), F.col("commits"))})
