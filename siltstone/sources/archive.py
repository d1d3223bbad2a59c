"""Hourly event archives: file ids, tolerant parsing of NDJSON lines, and the commits in them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.plan import computed


def file_ids(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every hourly file id from start to end, both included; ids are YYYY-MM-DD-HH."""
    a, b = (datetime.strptime(x, "%Y-%m-%d-%H") for x in (start, end))
    if b < a:
        raise ValueError("end lies before start")
    hours = F.explode(F.sequence(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz"), F.expr("INTERVAL 1 HOUR")))
    return spark.range(1).select(hours.alias("hour")).select(file_id(F.col("hour")).alias("file_id"), url_hour(F.col("hour")).alias("url_hour"))


def file_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd-HH")


def url_hour(ts: Column) -> Column:
    """The part of a download address that names the hour; the hour has no leading zero."""
    return F.date_format(ts, "yyyy-MM-dd-H")


def parse_file_id(value: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(value, r"-(\d)$", "-0$1"), F.lit("yyyy-MM-dd-HH"))


BASE_URL = "https://data.gharchive.org"  # fixed value


def url_for(file_id: Column, base: str = BASE_URL) -> Column:
    """Where an hourly file is fetched from."""
    return F.concat(F.lit(f"{base}/"), url_hour(parse_file_id(file_id)), F.lit(".json.gz"))


def lines_of(rows: DataFrame) -> DataFrame:
    """(file_id, file_bytes, block, value) from a text source of NDJSON files; the id is the last YYYY-MM-DD-H[H] of the path."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"^.*(?<!\d)(\d{4}-\d{2}-\d{2}-\d{1,2})", 1)
    return rows.select(F.regexp_replace(name, r"-(\d)$", "-0$1").alias("file_id"), F.col("_metadata.file_size").alias("file_bytes"), F.col("_metadata.file_block_start").alias("block"), "value")


def numbered(lines: DataFrame) -> DataFrame:
    """Add line_no, which orders the lines of a file: by the part of the file that a task reads, then as they come."""
    return lines.withColumn("line_no", F.col("block") * (1 << 20) + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).drop("block")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, file_bytes, value, line_no) of gzipped or plain NDJSON files. A gzipped file is read by one task."""
    return numbered(lines_of(spark.read.text(path)))


def parse_lines(lines: DataFrame, bots: str = T.BOT_PATTERN) -> DataFrame:
    """Add event (VARIANT, null if malformed or not an object) and its login, kind, flags is_push and is_bot (bots: a pattern
    of logins, in any case)."""
    v = F.try_parse_json("value")
    event = F.when(F.schema_of_variant(v).startswith("OBJECT"), v)
    get = lambda path, kind="string": F.try_variant_get("event", path, kind)
    out = computed(lines, event=event)  # parsed once, however many conditions look into it
    is_push = F.coalesce(get("$.type") == "PushEvent", F.lit(False))
    return out.withColumn("login", get("$.actor.login")).withColumn("is_push", is_push).withColumn("is_bot", is_push & T.is_bot(F.col("login"), get("$.actor.type"), pattern=bots))


def commits(parsed: DataFrame, now: datetime, lexicon: dict[str, list[str]], sample_chars: int = 200) -> DataFrame:
    """One scored row for each commit with a message, of pushes by people to repositories with a whole id and a name."""
    typed = lambda path, kinds: F.coalesce(F.schema_of_variant(F.try_variant_get("event", path, "variant")).isin(*kinds), F.lit(False))
    pushes = parsed.filter(F.col("is_push") & ~F.col("is_bot")).filter(typed("$.repo.id", ["BIGINT", "TINYINT", "SMALLINT", "INT"]) & typed("$.repo.name", ["STRING"]))
    listed = F.schema_of_variant(F.try_variant_get("event", "$.payload.commits", "variant")).startswith("ARRAY")
    each = F.posexplode(F.try_variant_get("event", "$.payload.commits", "array<variant>")).alias("pos", "commit")
    flat = pushes.filter(F.coalesce(listed, F.lit(False))).select(
        "file_id", "line_no", F.try_variant_get("event", "$.repo.id", "bigint").alias("repo_id"), F.try_variant_get("event", "$.repo.name", "string").alias("repo_name"),
        F.coalesce(T.iso_time(F.try_variant_get("event", "$.created_at", "string")), F.lit(now)).alias("seen_at"), "login", each,
    )
    text_of = lambda path: F.when(F.schema_of_variant(F.try_variant_get("commit", path, "variant")) == "STRING", F.try_variant_get("commit", path, "string"))
    rows = flat.withColumn("message", text_of("$.message")).filter(F.coalesce(F.col("message") != "", F.lit(False)))
    author = F.coalesce(F.nullif(text_of("$.author.email"), F.lit("")), F.nullif(text_of("$.author.name"), F.lit("")), F.nullif("login", F.lit("")))
    # Told apart, as one expression of both would be too large to compile: the language is read once for each word list.
    rows = computed(rows.withColumn("author", author), language=T.detect_language(F.col("message")))
    rows = computed(rows, hits=T.lexicon_hits(F.col("message"), F.col("language"), lexicon), glyphs=T.emoji(F.col("message")))
    return rows.withColumn("sample", F.when(F.size("hits") > 0, F.substring("message", 1, sample_chars))).drop("commit", "login")


def ledger(parsed: DataFrame, scored: DataFrame) -> DataFrame:
    """Per file: bytes (as stored, null where the source does not say), rows, push_events (by people), bots_filtered, commits_observed."""
    size = F.max("file_bytes") if "file_bytes" in parsed.columns else F.lit(None).cast("bigint")
    lines = parsed.groupBy("file_id").agg(size.alias("bytes"), F.count("*").alias("rows"), F.count_if(F.col("is_push") & ~F.col("is_bot")).alias("push_events"), F.count_if("is_bot").alias("bots_filtered"))
    seen = scored.groupBy("file_id").agg(F.count("*").alias("commits_observed"))
    return lines.join(seen, "file_id", "left").withColumn("commits_observed", F.coalesce("commits_observed", F.lit(0).cast("bigint")))
