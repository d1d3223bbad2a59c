"""The registered queries over the driver's tables, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import lifecycle, reports, rollup, sampling, stats
from siltstone.plans import registry
from siltstone.plans.registry import LEX_CTE, LEXICON, NOW, QUERIES, SQL, TOKEN, dealt, emoji_sql, p_value_sql, query, table
from siltstone.sources import archive, metadata, tree

CONF = sampling.Sampling(bins=(1, 5, 10, 15), min_commits=1)

HITS_CTE = f"""{LEX_CTE},
toks AS (SELECT doc_id, lang, source, text, unnest(list_distinct(list_concat(regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}'), regexp_extract_all(translate(lower(coalesce(text, '')), '4103$5@!', 'aioessai'), '{TOKEN}')))) AS word FROM documents),
hits AS (SELECT DISTINCT doc_id, source, word FROM toks t WHERE EXISTS (SELECT 1 FROM lex WHERE lex.word = t.word AND lex.lang IN (t.lang, 'en')))"""
REPOS_CTE = """repos AS (SELECT c_custkey AS id, count(o_orderkey) AS commits, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS hits FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey),
rated AS (SELECT *, CASE WHEN commits > 0 THEN hits / commits ELSE 0 END::DOUBLE AS rate, CASE WHEN commits >= 15 THEN 15 WHEN commits >= 10 THEN 10 WHEN commits >= 5 THEN 5 WHEN commits >= 1 THEN 1 END::BIGINT AS bin FROM repos)"""
COHORT_CTE = REPOS_CTE + """,
prof AS (SELECT id, commits, bin FROM rated WHERE commits >= 1 AND hits >= 1 ORDER BY rate DESC, id LIMIT 60),
edges(bin) AS (VALUES (1::BIGINT), (5), (10), (15)),
counts AS (SELECT e.bin, count(p.id) AS n FROM edges e LEFT JOIN prof p ON p.bin = e.bin GROUP BY e.bin),
scaled AS (SELECT bin, n, round_even(n * 60.0::DOUBLE / nullif(sum(n) OVER (), 0), 0)::BIGINT AS q, row_number() OVER (ORDER BY n DESC, bin) AS k FROM counts),
quota AS (SELECT bin, (q + CASE WHEN k = 1 THEN 60 - sum(q) OVER () ELSE 0 END)::BIGINT AS quota FROM scaled),
ranked AS (SELECT id, commits, bin, row_number() OVER (PARTITION BY bin ORDER BY md5('42:' || id::VARCHAR), id) AS rank FROM rated WHERE hits = 0 AND bin IS NOT NULL),
clean AS (SELECT r.id, r.commits, r.bin FROM ranked r JOIN quota q ON q.bin = r.bin AND r.rank <= q.quota)"""


def scored(spark, sf_dir):
    return dealt(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "source", "lang", "text", T.lexicon_hits(F.col("text"), F.col("lang"), LEXICON).alias("hits"))


def repos(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("commits"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("hits"))
    zero = F.lit(0).cast("bigint")
    out = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(orders, "id", "left").select("id", F.coalesce("commits", zero).alias("commits"), F.coalesce("hits", zero).alias("hits"))
    return out.withColumn("rate", T.rate(F.col("hits"), F.col("commits"))).withColumn("status", F.lit("seen")).withColumn("cohort", F.lit(None).cast("string"))


@query(f"""WITH {HITS_CTE}, d AS (SELECT source, count(*) AS commits FROM documents GROUP BY source), h AS (SELECT source, count(*) AS n FROM hits GROUP BY source)
SELECT d.source, commits, coalesce(n, 0)::BIGINT AS profanity_hits, coalesce(n, 0) / commits::DOUBLE AS profanity_rate FROM d LEFT JOIN h ON h.source = d.source ORDER BY profanity_rate DESC, d.source LIMIT 10""")
def lexicon_hits_by_source(spark, sf_dir):
    out = scored(spark, sf_dir).groupBy("source").agg(F.count("*").alias("commits"), F.sum(F.size("hits").cast("bigint")).alias("profanity_hits"))
    return out.withColumn("profanity_rate", T.rate(F.col("profanity_hits"), F.col("commits"))).orderBy(F.col("profanity_rate").desc(), "source").limit(10)


@query(f"WITH {HITS_CTE} SELECT word AS key, count(*) AS n FROM hits GROUP BY word ORDER BY n DESC, word LIMIT 30")
def lexicon_top_words(spark, sf_dir):
    return rollup.histogram(scored(spark, sf_dir), F.col("hits"), ()).orderBy(F.col("n").desc(), "key").limit(30)


@query(f"WITH {HITS_CTE}, c AS (SELECT source, word AS key, count(*) AS n FROM hits GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, key)::INTEGER AS rank FROM c QUALIFY rank <= 3")
def lexicon_top_words_per_source(spark, sf_dir):
    return rollup.top_n(rollup.histogram(scored(spark, sf_dir), F.col("hits"), ("source",)), ["source"])


LEET = [(1, "You 1d10t, m0r0n!"), (2, "455 and $cum"), (3, "fine words"), (4, "l0$3r"), (5, None)]


@query(f"""WITH {LEX_CTE}, l(id, text) AS (VALUES {", ".join(f"({i}, {'NULL' if t is None else repr(t)})" for i, t in LEET)}),
u AS (SELECT conv_id * 100 + turn AS id, text FROM conversations UNION ALL SELECT -id, text FROM l),
t AS (SELECT DISTINCT id, unnest(list_concat(regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}'), regexp_extract_all(translate(lower(coalesce(text, '')), '4103$5@!', 'aioessai'), '{TOKEN}'))) AS word FROM u)
SELECT id::BIGINT AS id, word FROM t WHERE word IN (SELECT word FROM lex WHERE lang = 'en')""")
def leet_normalised_hits(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    rows = rows.unionByName(spark.createDataFrame([(-i, t) for i, t in LEET], "id bigint, text string"))
    return rows.select("id", F.explode(T.lexicon_hits(F.col("text"), F.lit("en"), LEXICON)).alias("word"))


@query("SELECT source, CASE WHEN lang IN ('nb', 'nn') THEN 'no' ELSE lang END AS key, count(*) AS n FROM documents GROUP BY ALL")
def languages_by_source(spark, sf_dir):
    return rollup.histogram(table(spark, sf_dir, "documents"), F.array(T.language_code(F.col("lang"))), ("source",))


BOT_SQL = "coalesce(login <> '' AND (lower(login) LIKE '%[bot]' OR lower(login) IN (" + ", ".join(f"'{b}'" for b in T.BOT_LOGINS) + f") OR regexp_matches(login, '(?i){T.BOT_PATTERN}')), false)"
LOGIN_SQL = "CASE user_id % 7 WHEN 0 THEN 'dependabot[bot]' WHEN 1 THEN 'Stale' WHEN 2 THEN NULL WHEN 3 THEN 'robotics-fan' ELSE 'user' || user_id END"


@query(f"SELECT strftime(ts, '%Y-%m-%d-%H') AS file_id, count(*) AS rows, count(*) FILTER (WHERE event_type = 'click' AND NOT bot) AS push_events, count(*) FILTER (WHERE event_type = 'click' AND bot) AS bots_filtered FROM (SELECT *, {BOT_SQL} AS bot FROM (SELECT *, {LOGIN_SQL} AS login FROM events)) GROUP BY 1")
def bot_filtered_counts(spark, sf_dir):
    login = F.expr("CASE user_id % 7 WHEN 0 THEN 'dependabot[bot]' WHEN 1 THEN 'Stale' WHEN 2 THEN NULL WHEN 3 THEN 'robotics-fan' ELSE concat('user', user_id) END")
    rows = table(spark, sf_dir, "events").select(archive.file_id(F.col("ts")).alias("file_id"), (F.col("event_type") == "click").alias("push"), T.is_bot(login).alias("bot"))
    return rows.groupBy("file_id").agg(F.count("*").alias("rows"), F.count_if(F.col("push") & ~F.col("bot")).alias("push_events"), F.count_if(F.col("push") & F.col("bot")).alias("bots_filtered"))


HOURS_SQL = "SELECT strftime(h, '%Y-%m-%d-%H') AS file_id FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-03', INTERVAL 1 HOUR)) AS h)"


@query(f"WITH i AS ({HOURS_SQL}), e AS (SELECT strftime(ts, '%Y-%m-%d-%H') AS file_id, count(*) AS rows FROM events GROUP BY 1) SELECT i.file_id, coalesce(e.rows, 0)::BIGINT AS rows, CASE WHEN e.rows IS NULL THEN 'pending' ELSE 'done' END AS status FROM i LEFT JOIN e USING (file_id)")
def hourly_file_ledger(spark, sf_dir):
    seen = table(spark, sf_dir, "events").groupBy(archive.file_id(F.col("ts")).alias("file_id")).agg(F.count("*").alias("rows"))
    out = archive.file_ids(spark, "2024-01-01-00", "2024-01-03-00").select("file_id").join(seen, "file_id", "left")
    return out.select("file_id", F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"), F.when(F.col("rows").isNull(), "pending").otherwise("done").alias("status"))


@query(f"WITH i AS ({HOURS_SQL}), e AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d-%H') AS file_id FROM events WHERE event_type = 'error'), l AS (SELECT file_id, 'done' AS status FROM e) SELECT * FROM l UNION ALL SELECT file_id, 'pending' FROM i ANTI JOIN l USING (file_id)")
def ledger_seed_antijoin(spark, sf_dir):
    have = table(spark, sf_dir, "events").filter("event_type = 'error'").select(archive.file_id(F.col("ts")).alias("file_id")).distinct().withColumn("status", F.lit("done"))
    return lifecycle.seed(have, archive.file_ids(spark, "2024-01-01-00", "2024-01-03-00"))


@query("SELECT coalesce(o_orderstatus, '<total>') AS o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS o_custkey, sum((o_orderpriority = '1-URGENT')::BIGINT)::BIGINT AS urgent FROM orders GROUP BY ROLLUP (o_orderstatus)")
def status_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("urgent", (F.col("o_orderpriority") == "1-URGENT").cast("bigint"))
    return reports.status_totals(rows, "o_orderstatus", ["o_custkey", "urgent"])


COHORT_SQL = "SELECT d.*, CASE l.toxic WHEN 1 THEN 'profane' WHEN 0 THEN 'clean' END AS cohort, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)"


def labelled(docs, spark, sf_dir):
    """docs with their cohort and quality from the labels."""
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("cohort", F.when(F.col("toxic") == 1, "profane").when(F.col("toxic") == 0, "clean"))


def cohorts(spark, sf_dir):
    return labelled(table(spark, sf_dir, "documents"), spark, sf_dir)


@query(f"SELECT coalesce(lang, '<null>') AS language, count(*) FILTER (WHERE cohort = 'profane') AS profane, count(*) FILTER (WHERE cohort = 'clean') AS clean, count(*) FILTER (WHERE cohort IN ('profane', 'clean')) AS total FROM ({COHORT_SQL}) GROUP BY 1")
def cohort_language_pivot(spark, sf_dir):
    return reports.pivot_counts(cohorts(spark, sf_dir).withColumn("language", reports.language_label(F.col("lang"))), "language", "cohort", ["profane", "clean"])


@query("""WITH t AS (SELECT count(*) AS total, count(*) FILTER (WHERE lang = 'en') AS a, count(*) FILTER (WHERE lang IN ('fr', 'es')) AS b FROM documents)
SELECT 'a' AS tool, a AS n, 100.0::DOUBLE * a / total AS pct FROM t UNION ALL SELECT 'b', b, 100.0::DOUBLE * b / total FROM t""")
def tool_coverage_pct(spark, sf_dir):
    return reports.coverage(table(spark, sf_dir, "documents"), "lang", {"a": ("en",), "b": ("fr", "es")})


@query(f"WITH {COHORT_CTE} SELECT * FROM prof")
def topn_by_rate(spark, sf_dir):
    return sampling.profane(repos(spark, sf_dir), 60, CONF)


@query(f"WITH {COHORT_CTE} SELECT * FROM counts")
def bin_histogram(spark, sf_dir):
    return sampling.bin_counts(topn_by_rate(spark, sf_dir), CONF)


@query(f"WITH {COHORT_CTE} SELECT * FROM quota")
def bin_quota(spark, sf_dir):
    return sampling.quotas(bin_histogram(spark, sf_dir), 60)


@query(f"WITH {COHORT_CTE} SELECT * FROM clean")
def clean_matched_sample(spark, sf_dir):
    return sampling.clean(repos(spark, sf_dir), bin_quota(spark, sf_dir), CONF)


@query(f"WITH {COHORT_CTE} SELECT r.id, r.commits, r.hits, r.rate, CASE WHEN p.id IS NOT NULL OR c.id IS NOT NULL THEN 'pending' ELSE 'skipped' END AS status, CASE WHEN p.id IS NOT NULL THEN 'profane' WHEN c.id IS NOT NULL THEN 'clean' END AS cohort FROM rated r LEFT JOIN prof p ON p.id = r.id LEFT JOIN clean c ON c.id = r.id")
def cohort_promote(spark, sf_dir):
    return sampling.run(repos(spark, sf_dir), 60, 60, CONF)[0]


@query(f"WITH {COHORT_CTE} SELECT q.bin, quota AS target, count(c.id) AS drawn, greatest(quota - count(c.id), 0)::BIGINT AS shortfall FROM quota q LEFT JOIN clean c ON c.bin = q.bin GROUP BY q.bin, quota")
def shortfall_report(spark, sf_dir):
    return sampling.run(repos(spark, sf_dir), 60, 60, CONF)[1]


@query(f"""WITH {REPOS_CTE}, live AS (SELECT id FROM rated WHERE hits >= 1 AND id % 10 = 0), gap AS (SELECT greatest(0, 400 - count(*)) AS g FROM live)
SELECT id, rate FROM (SELECT *, row_number() OVER (ORDER BY rate DESC, id) AS k FROM rated WHERE commits >= 1 AND hits >= 1 AND id % 10 <> 0) WHERE k <= (SELECT g FROM gap)""")
def top_up_gap(spark, sf_dir):
    started = (F.col("hits") >= 1) & (F.col("id") % 10 == 0)
    rows = repos(spark, sf_dir).withColumn("status", F.when(started, "done").otherwise("seen")).withColumn("cohort", F.when(started, "profane"))
    out, _ = sampling.top_up(rows, 400, 0, CONF)
    return out.filter("status = 'pending' AND cohort = 'profane'").select("id", "rate")


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 AND ts < TIMESTAMP '2024-01-02' - INTERVAL 6 HOUR THEN 'pending' WHEN user_id % 3 = 0 THEN 'claimed' ELSE 'done' END AS status, CASE WHEN user_id % 3 = 0 AND ts < TIMESTAMP '2024-01-02' - INTERVAL 6 HOUR THEN NULL ELSE 'w' || user_id END AS claimed_by FROM events")
def stale_reclaim(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, "claimed").otherwise("done").alias("status"), F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("claimed_by"), F.col("ts").alias("claimed_at"))
    return lifecycle.reclaim(rows, F.lit(NOW).cast("timestamp_ntz"), "6 HOURS").drop("claimed_at")


@query(r"""WITH c AS (SELECT page_id, html, regexp_extract_all(html, '(?s)<!--.*?-->') AS comments FROM pages)
SELECT page_id, len(list_filter(string_split(html, chr(10)), lambda x: regexp_replace(x, '[ \t\r\x0B\f]', '', 'g') <> ''))::BIGINT AS loc_total, list_sum(list_transform(comments, lambda x: len(x) - len(replace(x, chr(10), '')) + 1))::BIGINT AS comment_nloc FROM c WHERE len(comments) > 0""")
def comment_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").withColumn("t", tree.lexed("html", F.lit("html")))
    return rows.filter(F.size("t.comments") > 0).select("page_id", T.nonblank_lines(F.col("html")).cast("bigint").alias("loc_total"), F.col("t.comment_nloc").alias("comment_nloc"))


@query("""WITH f AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, CASE regexp_extract(url, '^https?://[^/]+/([^/?]+)', 1) WHEN 'en' THEN 'python' WHEN 'de' THEN 'go' WHEN 'fr' THEN 'rust' ELSE 'markdown' END AS language FROM pages),
n AS (SELECT host, language, count(*) AS n FROM f WHERE language <> 'markdown' GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, language) AS k FROM n)
SELECT h.host, b.language AS primary_language FROM (SELECT DISTINCT host FROM f) h LEFT JOIN b ON b.host = h.host AND k = 1""")
def primary_language(spark, sf_dir):
    path = F.regexp_extract("url", "^https?://[^/]+/([^/?]+)", 1)
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.when(path == "en", "python").when(path == "de", "go").when(path == "fr", "rust").otherwise("markdown").alias("language"))
    return tree.primary_language(rows, ["host"])


@query("""SELECT c_custkey, n_name AS language, CASE WHEN c_custkey % 11 = 0 THEN 'archived' WHEN c_custkey % 13 = 0 THEN 'disabled' WHEN c_custkey * 1000 > 1024 * 1024 THEN 'oversize: ' || (c_custkey * 1000 // 1024) || ' MiB' END AS skip_reason FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def metadata_enrich_skip(spark, sf_dir):
    payload = F.to_json(F.struct(F.col("n_name").alias("language"), (F.col("c_custkey") * 1000).alias("size"), (F.col("c_custkey") % 11 == 0).alias("archived"), (F.col("c_custkey") % 13 == 0).alias("disabled")))
    rows = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"), "left")  # nation has 25 rows
    rows = rows.select("c_custkey", metadata.metadata(payload, F.lit(NOW)).alias("m"))
    return rows.select("c_custkey", "m.language", metadata.skip_reason(F.col("m.archived"), F.col("m.disabled"), F.col("m.size_kb"), 1024).alias("skip_reason"))


@query(f"WITH d AS ({COHORT_SQL}) SELECT DISTINCT cohort, n_chars, count(*) OVER (PARTITION BY cohort, n_chars) AS n, cume_dist() OVER (PARTITION BY cohort ORDER BY n_chars) AS share FROM d WHERE cohort IS NOT NULL AND n_chars IS NOT NULL")
def ecdf(spark, sf_dir):
    return stats.ecdf(cohorts(spark, sf_dir).filter("cohort IS NOT NULL"), "cohort", "n_chars")


@query(f"WITH d AS ({COHORT_SQL}), b AS (SELECT coalesce(cohort, 'none') AS cohort, CASE WHEN log10(n_chars) = 7.5 THEN 49 ELSE floor((log10(n_chars) - 2) / (5.5 / 49)) + 1 END::BIGINT AS bin FROM d WHERE n_chars > 0) SELECT cohort, bin, count(*) AS n FROM b WHERE bin BETWEEN 1 AND 49 GROUP BY ALL")
def log_histogram(spark, sf_dir):
    rows = cohorts(spark, sf_dir).select(F.coalesce("cohort", F.lit("none")).alias("cohort"), stats.log_bin(F.col("n_chars")).cast("bigint").alias("bin"))
    return rows.filter("bin IS NOT NULL").groupBy("cohort", "bin").agg(F.count("*").alias("n"))


METRICS = ["n_chars", "n_lines", "n_caps"]


def metric_frame(spark, sf_dir, *more):
    """(doc_id, cohort, more, metric, x); the texts are measured below the join with the labels, which shuffles their numbers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", *more, "n_chars", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("n_lines"), F.regexp_count("text", F.lit("[A-Z]")).alias("n_caps"))
    rows = labelled(docs, spark, sf_dir).filter("cohort IS NOT NULL")
    return stats.unpivot(rows, ["doc_id", "cohort", *more], METRICS)


@query(f"""WITH d AS (SELECT *, length(text) - length(replace(text, chr(10), '')) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_caps FROM ({COHORT_SQL}) WHERE cohort IS NOT NULL),
l AS (SELECT doc_id, cohort, unnest(['n_chars', 'n_lines', 'n_caps']) AS metric, unnest([n_chars, n_lines, n_caps])::DOUBLE AS x FROM d),
r AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY x) + (count(*) OVER (PARTITION BY metric, x) - 1) / 2.0::DOUBLE AS rk FROM l WHERE x IS NOT NULL),
s AS (SELECT metric, count(*) FILTER (WHERE cohort = 'clean') AS n1, count(*) FILTER (WHERE cohort = 'profane') AS n2, sum(rk) FILTER (WHERE cohort = 'clean') AS r1, median(x) FILTER (WHERE cohort = 'clean') AS median_1, median(x) FILTER (WHERE cohort = 'profane') AS median_2 FROM r GROUP BY metric),
u AS (SELECT *, CASE WHEN least(n1, n2) >= 5 THEN r1 - n1 * (n1 + 1) / 2.0::DOUBLE END AS u FROM s)
SELECT metric, n1, n2, median_1, median_2, u, 1 - 2 * u / (n1 * n2) AS r_rb FROM u""")
def mwu_table(spark, sf_dir):
    return stats.mann_whitney(metric_frame(spark, sf_dir)).select("metric", F.col("n1").cast("bigint").alias("n1"), F.col("n2").cast("bigint").alias("n2"), "median_1", "median_2", "u", "r_rb")


REASON_SQL = "CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 'git: exit ' || o_custkey WHEN o_orderstatus = 'F' THEN 'timeout' WHEN o_orderstatus = 'P' THEN 'skip: archived' END"


@query(f"SELECT split_part(reason, ':', 1) AS kind, count(*) AS n FROM (SELECT {REASON_SQL} AS reason FROM orders) WHERE reason IS NOT NULL GROUP BY 1")
def failure_histogram(spark, sf_dir):
    s = F.col("o_orderstatus")
    kind = F.when((s == "F") & (F.col("o_custkey") % 2 == 0), "git").when(s == "F", "timeout").when(s == "P", "skip")
    detail = F.when(s == "P", "archived").otherwise(F.concat(F.lit("exit "), F.col("o_custkey").cast("string")))
    return reports.failures(table(spark, sf_dir, "orders").select(metadata.failure(kind, detail).alias("reason")), "reason")


GLYPHS = [(1, "ok 😀😀 👍🏽"), (2, "👩‍💻 and ❤️"), (3, "🇺🇸 🇫🇷 1️⃣"), (4, ":smile: none"), (5, None)]


@query("""SELECT user_id, count(*) AS n, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS clicks, CASE WHEN bool_or(event_id % 2 = 0) THEN min(event_id) FILTER (WHERE event_id % 2 = 0) ELSE min(event_id) END AS first_event FROM events GROUP BY user_id""")
def upsert_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    part = lambda k: rows.filter(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.min("event_id").alias("first_event"))
    return rollup.upsert(part(0), part(1), "user_id", ["n", "clicks"], ["first_event"])


@query("SELECT o_orderkey AS id, 'w' || o_custkey % 3 AS claimed_by, CASE WHEN o_custkey % 3 = 1 AND o_orderkey % 2 = 0 THEN 'done' ELSE 'claimed' END AS status FROM orders")
def claim_guarded_update(spark, sf_dir):
    worker = F.concat(F.lit("w"), (F.col("o_custkey") % 3).cast("string"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), worker.alias("claimed_by"), F.lit("claimed").alias("status"))
    outcome = rows.filter(F.col("id") % 2 == 0).select("id", F.lit("w1").alias("claimed_by"), F.lit("done").alias("status"))
    return lifecycle.conditional_update(rows, outcome, ["status"]).select("id", "claimed_by", "status")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE p_partkey END::BIGINT AS eslint_errors FROM part")
def backfill_missing(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("bigint")).alias("eslint_errors"))
    return lifecycle.backfill(rows, table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("bigint").alias("eslint_errors")), "p_partkey", ["eslint_errors"])


#: Texts of the documents are given emoji by their ids, so that the grammar has work in every part of the table.
PLANTED = ["😀😀 ok", "👍🏽", "👩‍💻 and ❤️", "🇺🇸🇫🇷", "1️⃣ :smile:", "™ ©", "👨‍👩‍👧 x", "plain"]
PLANTED_SQL = f"coalesce(text, '') || ' ' || (['" + "', '".join(PLANTED) + f"'])[1 + doc_id % {len(PLANTED)}]"


_GLYPHS = ", ".join(f"({i}, " + ("NULL" if t is None else f"'{t}'") + ")" for i, t in GLYPHS)


@query(f"""WITH l(id, text) AS (VALUES {_GLYPHS}),
u AS (SELECT id::BIGINT AS id, text FROM l UNION ALL SELECT -doc_id - 1, {PLANTED_SQL} FROM documents),
g AS (SELECT id, unnest({emoji_sql("coalesce(text, '')")}) AS glyph FROM u) SELECT id, glyph, count(*) AS n FROM g GROUP BY id, glyph""")
def emoji_counts(spark, sf_dir):
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    planted = F.element_at(F.array(*map(F.lit, PLANTED)), (F.col("doc_id") % len(PLANTED) + 1).cast("int"))
    rows = spark.createDataFrame(GLYPHS, "id bigint, text string").unionByName(docs.select((-F.col("doc_id") - 1).alias("id"), F.concat(F.coalesce("text", F.lit("")), F.lit(" "), planted).alias("text")))
    return rows.select("id", F.explode(T.emoji(F.col("text"))).alias("glyph")).groupBy("id", "glyph").agg(F.count("*").alias("n"))


@query(f"""WITH {COHORT_CTE}, promoted AS (SELECT r.id, r.commits, r.hits, CASE WHEN p.id IS NOT NULL OR c.id IS NOT NULL THEN CASE WHEN r.id % 2 = 0 THEN 'done' ELSE 'pending' END ELSE 'skipped' END AS status,
CASE WHEN p.id IS NOT NULL THEN 'profane' WHEN c.id IS NOT NULL THEN 'clean' END AS cohort, r.commits % 3 AS emoji_hits, CASE WHEN r.id % 7 <> 0 THEN r.commits * 10 END AS loc_total FROM rated r LEFT JOIN prof p ON p.id = r.id LEFT JOIN clean c ON c.id = r.id),
a AS (SELECT count(*) AS n, count(*) FILTER (WHERE hits > 0) AS h, count(*) FILTER (WHERE emoji_hits > 0) AS e, count(*) FILTER (WHERE status = 'done') AS d, count(*) FILTER (WHERE status = 'done' AND coalesce(loc_total, 0) <= 0) AS l,
count(*) FILTER (WHERE status IN ('pending', 'claimed', 'done', 'failed') AND coalesce(cohort NOT IN ('profane', 'clean'), true)) AS c FROM promoted)
SELECT * FROM (SELECT 'enough repos' AS "check", n >= 100 AS ok, n AS detail FROM a UNION ALL SELECT 'a lexicon hit', h >= 1, h FROM a UNION ALL SELECT 'an emoji hit', e >= 1, e FROM a UNION ALL SELECT 'enough done', d >= 3, d FROM a
UNION ALL SELECT 'done rows have lines', l = 0, l FROM a UNION ALL SELECT 'live rows have a cohort', c = 0, c FROM a)""")
def dq_checks(spark, sf_dir):
    reports.database_guard("siltstone_test")
    rows = cohort_promote(spark, sf_dir).withColumn("status", F.when((F.col("status") == "pending") & (F.col("id") % 2 == 0), "done").otherwise(F.col("status")))
    rows = rows.withColumn("emoji_hits", F.col("commits") % 3).withColumn("loc_total", F.when(F.col("id") % 7 != 0, F.col("commits") * 10))
    return reports.checks(rows)


from siltstone.plans import code_queries, ingest_queries, study_queries  # noqa: E402, F401  they add their queries to the register
