"""Queries of the archive ingest: event lines are made from `conversations`, with every odd form that a parser must pass
over, and go through the same parse, partials, merge and finalizer as an archive's files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.plan import computed
from siltstone.operators import language, rollup
from siltstone.plans.registry import LEXICON, NOW, SQL, dealt, emoji_sql, hits_sql, language_sql, query, table
from siltstone.session import shared_folder, written
from siltstone.sources import archive, lexicon
from siltstone.sources.archive_stream import ArchiveStream
from siltstone.streaming import ingest, state

#: Added to a message by its place, so that every hour has emoji, words of the lexicon and leetspeak.
ADDED = [" 🎉🎉 fixed", " you 1d10t", "", " ❤️ scum and m0r0n", " trash", " – que para"]


def lines(spark, sf_dir) -> DataFrame:
    """(file_id, line_no, value): one event for each turn, in one of twelve forms, half of them with two commits."""
    rows = dealt(table(spark, sf_dir, "conversations"), "conv_id").withColumn("m", ((F.col("conv_id") * 7 + F.col("turn")) % 12).cast("int"))
    hour = F.lpad((F.col("conv_id") % 24).cast("string"), 2, "0")
    added = F.element_at(F.array(*map(F.lit, ADDED)), (F.col("turn") % len(ADDED) + 1).cast("int"))
    rows = rows.select("m", "role", F.concat(F.lit("2024-01-01-"), hour).alias("file_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("line_no"), (F.col("conv_id") % 50).alias("repo"), F.concat(F.lit("org/r"), (F.col("conv_id") % 50).cast("string"), F.lit("-"), (F.col("conv_id") % 24).cast("string")).alias("name"), F.concat(F.coalesce("text", F.lit("")), added).alias("message"), (F.col("conv_id") % 9).alias("who"))
    m, text = F.col("m"), lambda c: F.to_json(F.struct(c.alias("x")))
    quote = lambda c: F.substring(text(c), 6, 1 << 30).substr(F.lit(1), F.length(text(c)) - 6)  # noqa: E731  a JSON string
    who = F.concat(F.lit("u"), F.col("who").cast("string"))
    author = F.when(m == 7, F.concat(F.lit('{"name": "N'), F.col("role"), F.lit('", "email": ""}'))).when(m == 8, F.lit("{}")).otherwise(F.concat(F.lit('{"email": "'), F.col("role"), F.lit('@x", "name": "A"}')))
    commit = F.concat(F.lit('{"message": '), quote(F.col("message")), F.lit(', "author": '), author, F.lit("}"))
    second = F.concat(F.lit('{"message": "fix '), F.col("role"), F.lit('"}'))
    listed = F.when(m == 6, F.concat(F.lit('[7, {"message": 5}, {"message": ""}, '), commit, F.lit("]"))).when(m == 10, F.concat(F.lit("["), commit, F.lit("]"))).otherwise(F.concat(F.lit("["), commit, F.lit(", "), second, F.lit("]")))
    actor = F.when(m == 3, F.lit('{"login": "dependabot[bot]", "type": "User"}')).otherwise(F.concat(F.lit('{"login": "'), who, F.lit('", "type": "'), F.when(m == 4, "Bot").otherwise("User"), F.lit('"}')))
    repo = F.concat(F.lit('{"id": '), F.when(m == 5, F.concat(F.lit('"'), F.col("repo").cast("string"), F.lit('"'))).otherwise(F.col("repo").cast("string")), F.lit(', "name": "'), F.col("name"), F.lit('"}'))
    seconds = F.col("line_no") % 86400
    at = F.when(m == 9, F.lit('"no time"')).otherwise(F.concat(F.lit('"'), F.date_format(F.timestamp_seconds(seconds + 1704067200), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"')))
    event = F.concat(F.lit('{"type": "'), F.when(m == 2, "WatchEvent").otherwise("PushEvent"), F.lit('", "actor": '), actor, F.lit(', "repo": '), repo, F.lit(', "created_at": '), at, F.lit(', "payload": {"commits": '), F.when(m == 11, F.lit('"none"')).otherwise(listed), F.lit("}}"))
    return computed(rows, value=F.when(m == 0, F.lit("{broken")).when(m == 1, F.lit("[1]")).otherwise(event)).select("file_id", "line_no", "value")


def scored(spark, sf_dir) -> DataFrame:
    """The commits, written: what is made of them reads them more than once."""
    return written(archive.commits(archive.parse_lines(lines(spark, sf_dir)), NOW, LEXICON), "scored")


_ADDED = "['" + "', '".join(ADDED) + "']"
#: The same commits, told from the table.
COMMITS = f"""src AS (SELECT (conv_id * 7 + turn) % 12 AS m, role, printf('2024-01-01-%02d', conv_id % 24) AS file_id, conv_id * 100 + turn AS line_no, conv_id % 50 AS repo_id, 'org/r' || (conv_id % 50) || '-' || (conv_id % 24) AS repo_name,
  coalesce(text, '') || {_ADDED}[1 + turn % {len(ADDED)}] AS message, 'u' || (conv_id % 9) AS login FROM conversations),
both_ AS (SELECT *, CASE m WHEN 6 THEN 3 ELSE 0 END AS pos, message AS said, CASE m WHEN 7 THEN 'N' || role WHEN 8 THEN login ELSE role || '@x' END AS author FROM src WHERE m NOT IN (0, 1, 2, 3, 4, 5, 11) AND message <> ''
  UNION ALL SELECT *, 1, 'fix ' || role, login FROM src WHERE m IN (7, 8, 9)),
tagged AS (SELECT file_id, line_no, pos, repo_id, repo_name, CASE WHEN m = 9 THEN TIMESTAMP '2024-01-02' ELSE TIMESTAMP '2024-01-01' + to_seconds(line_no % 86400) END AS seen_at, author, said, {language_sql("said")} AS language FROM both_),
commits AS (SELECT *, {hits_sql("said", "language")} AS hits, {emoji_sql("said")} AS glyphs FROM tagged)"""


@query(f"WITH {COMMITS} SELECT file_id, line_no, pos::INTEGER AS pos, repo_id, repo_name, epoch(seen_at)::BIGINT AS seen, author, language, array_to_string(hits, ' ') AS hits, len(glyphs)::INTEGER AS glyphs, CASE WHEN len(hits) > 0 THEN left(said, 200) END AS sample FROM commits")
def archive_commits(spark, sf_dir):
    return scored(spark, sf_dir).select("file_id", "line_no", "pos", "repo_id", "repo_name", F.unix_timestamp("seen_at").alias("seen"), "author", "language", F.array_join("hits", " ").alias("hits"), F.size("glyphs").alias("glyphs"), "sample")


@query(f"""WITH {COMMITS}, c AS (SELECT file_id, count(*) AS n FROM commits GROUP BY file_id)
SELECT s.file_id, count(*) AS rows, count(*) FILTER (WHERE m NOT IN (0, 1, 2, 3, 4)) AS push_events, count(*) FILTER (WHERE m IN (3, 4)) AS bots_filtered, coalesce(any_value(c.n), 0)::BIGINT AS commits_observed FROM src s LEFT JOIN c ON c.file_id = s.file_id GROUP BY s.file_id""")
def archive_ledger(spark, sf_dir):
    parsed = archive.parse_lines(lines(spark, sf_dir))
    return archive.ledger(parsed, archive.commits(parsed, NOW, LEXICON)).drop("bytes")


PARTIAL_SQL = """SELECT file_id, repo_id, count(*) AS commits, sum(len(hits))::BIGINT AS profanity_hits, sum(len(glyphs))::BIGINT AS emoji_hits, count(*) FILTER (WHERE len(glyphs) > 0) AS emoji_commits,
array_to_string(list_sort(list(DISTINCT author)), ' ') AS authors, arg_min(repo_name, (epoch(seen_at)::BIGINT, file_id, line_no, pos)) AS first_name, array_to_string(list_slice(list(left(said, 200) ORDER BY file_id, line_no, pos) FILTER (WHERE len(hits) > 0), 1, 5), chr(10)) AS samples"""


def _flat(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.select(*keys, "commits", "profanity_hits", "emoji_hits", "emoji_commits", F.array_join("authors", " ").alias("authors"), F.col("first.repo_name").alias("first_name"), F.array_join("samples.sample", "\n").alias("samples"))


@query(f"WITH {COMMITS} {PARTIAL_SQL} FROM commits GROUP BY file_id, repo_id")
def event_flatten_scored(spark, sf_dir):
    return _flat(rollup.partials(scored(spark, sf_dir)), "file_id", "repo_id").withColumn("samples", F.nullif("samples", F.lit("")))


def _repositories(spark, sf_dir) -> DataFrame:
    rows = scored(spark, sf_dir)
    return rollup.finalize(rollup.with_maps(rollup.merge(rollup.partials(rows)), rollup.merged_maps(rollup.counters(rows))), 3)


REPO_SQL = PARTIAL_SQL.replace("SELECT file_id, repo_id", "SELECT repo_id")


@query(f"""WITH {COMMITS}, r AS ({REPO_SQL} FROM commits GROUP BY repo_id),
k AS (SELECT repo_id, 'languages' AS kind, language AS key FROM commits UNION ALL SELECT repo_id, 'words', unnest(hits) FROM commits UNION ALL SELECT repo_id, 'glyphs', unnest(glyphs) FROM commits),
n AS (SELECT repo_id, kind, key, count(*) AS n FROM k GROUP BY ALL), best AS (SELECT *, row_number() OVER (PARTITION BY repo_id, kind ORDER BY n DESC, key) AS place FROM n),
m AS (SELECT repo_id, string_agg(key || '=' || n, ' ' ORDER BY key) FILTER (WHERE kind = 'languages') AS languages, string_agg(key || '=' || n, ' ' ORDER BY key) FILTER (WHERE kind = 'words' AND place <= 3) AS words, string_agg(key || '=' || n, ' ' ORDER BY key) FILTER (WHERE kind = 'glyphs' AND place <= 3) AS glyphs FROM best GROUP BY repo_id)
SELECT r.repo_id, commits, profanity_hits, emoji_hits, emoji_commits, authors, first_name, profanity_hits / commits::DOUBLE AS profanity_rate, emoji_hits / commits::DOUBLE AS emoji_rate, coalesce(languages, '') AS languages, coalesce(words, '') AS words, coalesce(glyphs, '') AS glyphs FROM r LEFT JOIN m USING (repo_id)""")
def repositories_finalized(spark, sf_dir):
    return _told(_repositories(spark, sf_dir))


def _told(repos: DataFrame) -> DataFrame:
    told = lambda c: F.array_join(F.transform(rollup.entries(F.col(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ")
    flat = repos.select("repo_id", "commits", "profanity_hits", "emoji_hits", "emoji_commits", F.array_join("authors", " ").alias("authors"), F.col("first.repo_name").alias("first_name"), "profanity_rate", "emoji_rate", *[told(c).alias(k) for k, c in rollup.MAPS.items()])
    return flat


@query(f"WITH {COMMITS}, f AS (SELECT DISTINCT file_id, repo_id FROM commits), o AS (SELECT repo_id, min(file_id) AS first FROM f GROUP BY repo_id) SELECT file_id, count(*) FILTER (WHERE file_id = first) AS upserted, count(*) FILTER (WHERE file_id <> first) AS modified FROM f JOIN o USING (repo_id) GROUP BY file_id")
def file_effects(spark, sf_dir):
    return rollup.file_effects(rollup.partials(scored(spark, sf_dir)))


@query(f"WITH {COMMITS}, f AS (SELECT author, repo_id, min((epoch(seen_at)::BIGINT, file_id, line_no, pos)) AS at FROM commits GROUP BY ALL) SELECT repo_id, string_agg(DISTINCT author, ' ' ORDER BY author) AS authors, arg_min(repo_name, (epoch(seen_at)::BIGINT, file_id, line_no, pos)) AS first_name, min(epoch(seen_at))::BIGINT AS first_seen FROM commits GROUP BY repo_id")
def first_seen_and_authors(spark, sf_dir):
    return rollup.merge(rollup.partials(scored(spark, sf_dir))).select("repo_id", F.array_join("authors", " ").alias("authors"), F.col("first.repo_name").alias("first_name"), F.unix_timestamp("first.seen_at").alias("first_seen"))


@query(f"""WITH {COMMITS}, s AS (SELECT repo_id, left(said, 200) AS sample, row_number() OVER (PARTITION BY repo_id ORDER BY file_id, line_no, pos)::INTEGER AS place FROM commits WHERE len(hits) > 0)
SELECT * FROM s WHERE place <= 5""")
def sample_messages_capped(spark, sf_dir):
    repos = rollup.merge(rollup.partials(scored(spark, sf_dir)))
    return repos.select("repo_id", F.posexplode("samples.sample").alias("place", "sample")).withColumn("place", F.col("place") + 1)


@query(f"WITH {COMMITS}, h AS (SELECT repo_id, unnest(hits) AS key FROM commits), n AS (SELECT repo_id, key, count(*) AS n FROM h GROUP BY ALL) SELECT repo_id, key, n, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, key)::INTEGER AS rank FROM n QUALIFY rank <= 2")
def top_words_per_repo(spark, sf_dir):
    words = rollup.counters(scored(spark, sf_dir)).filter("kind = 'words'").groupBy("repo_id", "key").agg(F.sum("n").alias("n"))
    return rollup.top_n(words, ["repo_id"], n=2)


def _landed(spark, sf_dir, rows: DataFrame) -> str:
    """rows (file_id, value) as gzipped files below a folder for each hour, in the folder that the cluster shares."""
    where = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    rows.repartition("file_id").sortWithinPartitions("file_id", "line_no").select("file_id", "value").write.partitionBy("file_id").option("compression", "gzip").text(f"{where}/in")
    return where


@query(f"""WITH {COMMITS}, r AS ({REPO_SQL} FROM commits GROUP BY repo_id) SELECT repo_id, commits, profanity_hits, emoji_hits, emoji_commits, authors, first_name, profanity_hits / commits::DOUBLE AS profanity_rate, emoji_hits / commits::DOUBLE AS emoji_rate FROM r""")
def stream_ingest_equiv(spark, sf_dir):
    """The stream over landed files, then every file once more: replayed files overwrite what they wrote."""
    where = _landed(spark, sf_dir, lines(spark, sf_dir))
    ingest.run(spark, f"{where}/in/*", f"{where}/out", f"{where}/checkpoint", LEXICON, NOW, files_per_batch=8)
    ingest.run_one_file(spark, f"{where}/in/*", f"{where}/out", LEXICON, NOW)
    return _told(ingest.finalize(spark, f"{where}/out")).drop(*rollup.MAPS)


@query(SQL["repositories_finalized"])
def repositories_streamed(spark, sf_dir):
    """The archive stream into keyed state, stopped after a third of its files and started again from its checkpoint: the last
    state of every repository."""
    where = _landed(spark, sf_dir, lines(spark, sf_dir))
    spark.dataSource.register(ArchiveStream)
    source = {"base": f"{where}/in", "first": "2024-01-01-00", "filesPerTrigger": "8", "checkpoint": f"{where}/checkpoint"}
    for last in ("2024-01-01-07", "2024-01-01-23"):
        read = spark.readStream.format("hourly_archive_stream").options(**source, last=last).load()
        running = state.start(spark, read, f"{where}/state", f"{where}/checkpoint", LEXICON, NOW)
        try:
            running.processAllAvailable()
        finally:
            running.stop()
    return _told(rollup.finalize(state.latest(spark, f"{where}/state"), 3))


@query(f"""WITH {COMMITS}, c AS (SELECT file_id, count(*) AS n FROM commits GROUP BY file_id), f AS (SELECT DISTINCT file_id, repo_id FROM commits), o AS (SELECT repo_id, min(file_id) AS first FROM f GROUP BY repo_id),
e AS (SELECT file_id, count(*) FILTER (WHERE file_id = first) AS upserted, count(*) FILTER (WHERE file_id <> first) AS modified FROM f JOIN o USING (repo_id) GROUP BY file_id), l AS (SELECT file_id, count(*) AS rows FROM src GROUP BY file_id)
SELECT l.file_id, rows, 'done' AS status, coalesce(c.n, 0)::BIGINT AS commits_observed, coalesce(upserted, 0)::BIGINT AS upserted, coalesce(modified, 0)::BIGINT AS modified, true AS sized FROM l LEFT JOIN c USING (file_id) LEFT JOIN e USING (file_id)""")
def stream_ledger(spark, sf_dir):
    where = _landed(spark, sf_dir, lines(spark, sf_dir))
    ingest.start(spark, f"{where}/in/*", f"{where}/out", f"{where}/checkpoint", LEXICON, NOW).awaitTermination()
    return ingest.ledger(spark, f"{where}/out").select("file_id", "rows", "status", "commits_observed", "upserted", "modified", (F.col("bytes") > 0).alias("sized"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d-%H') AS file_id, 'https://data.gharchive.org/' || strftime(ts, '%Y-%m-%d-') || hour(ts) || '.json.gz' AS url, epoch(date_trunc('hour', ts))::BIGINT AS hour FROM events""")
def file_id_forms(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", archive.file_id(F.col("ts")).alias("file_id"), archive.url_hour(F.col("ts")).alias("short"))
    return rows.select("event_id", "file_id", archive.url_for(F.col("file_id")).alias("url"), F.unix_timestamp(archive.parse_file_id(F.col("short"))).alias("hour"))


@query(f"SELECT doc_id, {language_sql('text')} AS language FROM documents")
def language_detected(spark, sf_dir):
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", T.detect_language(F.col("text")).alias("language"))


@query()
def language_modelled(spark, sf_dir):
    """The n-gram model fitted on all labelled documents, and what it says of each."""
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    return language.detected(docs, language.LanguageModel.of(language.profiles(docs))).select("doc_id", "language", F.round("confidence", 6).alias("confidence"))


WORD_FILES = [("en", " Idiot "), ("en", "# note"), ("en", ""), ("en", "SCUM"), ("en", "scum"), ("de", "Nicht"), ("README.md", "words")]


@query("SELECT DISTINCT source || '-x' AS lang, lower(lang) AS word FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL UNION SELECT * FROM (VALUES ('en', 'idiot'), ('en', 'scum'), ('de', 'nicht'))")
def lexicon_words(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("-x")).alias("name"), F.concat(F.lit("  "), F.upper("lang"), F.lit(" ")).alias("value")).filter("name IS NOT NULL AND value IS NOT NULL")
    return lexicon.parsed(names.unionByName(spark.createDataFrame(WORD_FILES, "name string, value string")))
