"""Incremental ingest: each batch of archive files becomes partial rows keyed by file, and repositories are merged from them.

A replayed batch overwrites its own files' partitions, so nothing is counted twice, and a late file is one more partition:
there is no watermark and nothing is dropped. finalize is the batch job that runs once the stream has ended.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import BOT_PATTERN
from siltstone.operators import rollup
from siltstone.session import written
from siltstone.sources import archive


def flush(frame: DataFrame, path: str) -> int:
    """Overwrite the partitions (file_id) of the files that frame holds; the rows written, counted on the way."""
    seen = Observation()
    frame.observe(seen, F.count("*").alias("rows")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_id").parquet(path)
    return seen.get["rows"]


def land(lines: DataFrame, out: str, lexicon: dict[str, list[str]], now: datetime, bots: str = BOT_PATTERN, samples: int = 5) -> dict[str, int]:
    """Partials, counters and ledger rows of the files in lines; rows written for each table. bots: a pattern of their logins."""
    tables = _tables(lines, lexicon, now, bots, samples)
    return {name: flush(frame, f"{out}/{name}") for name, frame in tables.items()}


def start(spark: SparkSession, source: str, out: str, checkpoint: str, lexicon: dict[str, list[str]], now: datetime, files_per_batch: int = 8, hours: tuple[str, str] | None = None, **options):
    """Process what is new below source and stop; call again for more. files_per_batch bounds what is in flight. hours: the
    first and last file id that count. Other options are land's."""
    lines = archive.lines_of(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source))
    lines = lines if hours is None else lines.filter(F.col("file_id").between(*hours))

    def write(batch: DataFrame, batch_id: int) -> None:
        land(archive.numbered(batch), out, lexicon, now, **options)

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_one_file(spark: SparkSession, path: str, out: str, lexicon: dict[str, list[str]], now: datetime) -> dict[str, int]:
    """Process one file outside the stream, again if need be."""
    return land(archive.read_lines(spark, path), out, lexicon, now)


def _tables(lines: DataFrame, lexicon: dict[str, list[str]], now: datetime, bots: str, samples: int) -> dict[str, DataFrame]:
    parsed = archive.parse_lines(lines, bots)
    scored = written(archive.commits(parsed, now, lexicon), "scored")  # the texts are scored once for all tables
    return {"partials": rollup.partials(scored, samples), "counters": rollup.counters(scored), "ledger": archive.ledger(parsed, scored).withColumns({"status": F.lit("done"), "finished_at": F.lit(now)})}


def _table(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table of what has landed; empty where nothing has."""
    try:
        found = spark.read.parquet(f"{out}/{name}")
    except AnalysisException as why:
        if why.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        none = spark.createDataFrame([], "file_id string, file_bytes bigint, value string, line_no bigint")
        found = _tables(none, {"en": []}, datetime(2000, 1, 1), BOT_PATTERN, 1)[name]
    return found.withColumn("file_id", F.col("file_id").cast("string"))


def repositories(spark: SparkSession, out: str, samples: int = 5) -> DataFrame:
    """Repositories as all files so far make them, maps whole."""
    return rollup.with_maps(rollup.merge(_table(spark, out, "partials"), samples), rollup.merged_maps(_table(spark, out, "counters")))


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """The file ledger with what each file did to the repositories."""
    effects = rollup.file_effects(_table(spark, out, "partials"))
    zero = F.lit(0).cast("bigint")
    return _table(spark, out, "ledger").join(effects, "file_id", "left").withColumns({c: F.coalesce(c, zero) for c in ("upserted", "modified")})


def finalize(spark: SparkSession, out: str, top: int = 20, samples: int = 5) -> DataFrame:
    """After the last file: rates, and maps cut to their largest counters."""
    return rollup.finalize(repositories(spark, out, samples), top)


def run(spark: SparkSession, source: str, out: str, checkpoint: str, lexicon: dict[str, list[str]], now: datetime, timeout: float | None = None, top: int = 20, **options) -> DataFrame | None:
    """Drain source, then finalize. Past timeout (seconds) the stream is stopped, what it has landed stays, and nothing is finalized."""
    query = start(spark, source, out, checkpoint, lexicon, now, **options)
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        return None
    return finalize(spark, out, top, options.get("samples", 5))
