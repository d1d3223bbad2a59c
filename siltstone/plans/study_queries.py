"""Queries of the cohort study: bins, claims, probes, the statistics by subset, the figures' rows and the report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.plan import computed
from siltstone.operators import lifecycle, reports, rollup, sampling, stats, store
from siltstone.plans.catalog import COHORT_CTE, COHORT_SQL, CONF, METRICS, REPOS_CTE, cohorts, metric_frame, repos
from siltstone.plans.registry import NOW, SQL, dealt, p_value_sql, query, table
from siltstone.session import shared_folder, written
from siltstone.sources import metadata


@query(f"WITH {REPOS_CTE}, b(bin, low, high) AS (VALUES (1::BIGINT, 1::BIGINT, 5::BIGINT), (5, 5, 10), (10, 10, 15), (15, 15, NULL)) SELECT b.bin, low, high, count(id) AS n, min(commits) AS least, max(commits) AS most FROM b LEFT JOIN rated r ON r.bin = b.bin GROUP BY ALL")
def bin_bounds(spark, sf_dir):
    """The bins with what the repositories in them hold."""
    bounds = sampling.bin_bounds(spark, CONF)
    held = sampling.in_bins(repos(spark, sf_dir).select("id", "commits"), bounds).groupBy("bin").agg(F.count("*").alias("n"), F.min("commits").alias("least"), F.max("commits").alias("most"))
    return bounds.join(held, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


@query(f"WITH {REPOS_CTE} SELECT id, commits, bin FROM rated WHERE bin IS NOT NULL")
def bin_range_join(spark, sf_dir):
    return sampling.in_bins(repos(spark, sf_dir).select("id", "commits"), sampling.bin_bounds(spark, CONF)).select("id", "commits", "bin")


STATUSES = ["seen", "skipped", "pending", "claimed", "done", "failed", "missing", "in_progress"]
EVENTS = ["skip", "promote", "claim", "done", "fail", "reclaim", "missing", "retry"]


@query(f"""WITH o AS (SELECT o_orderkey, ({STATUSES})[1 + o_orderkey % 8] AS status, ({EVENTS})[1 + o_custkey % 8] AS event FROM orders)
SELECT o_orderkey, status, event, CASE WHEN event = 'missing' THEN 'missing' WHEN status = 'seen' AND event = 'skip' THEN 'skipped' WHEN status IN ('seen', 'skipped') AND event = 'promote' THEN 'pending' WHEN status = 'pending' AND event = 'claim' THEN 'claimed'
WHEN status = 'claimed' AND event = 'done' THEN 'done' WHEN status = 'claimed' AND event = 'fail' THEN 'failed' WHEN status = 'claimed' AND event = 'reclaim' THEN 'pending' ELSE status END AS repo,
CASE WHEN status = 'pending' AND event = 'claim' THEN 'in_progress' WHEN status = 'in_progress' AND event = 'done' THEN 'done' WHEN status = 'in_progress' AND event = 'fail' THEN 'failed' WHEN status IN ('in_progress') AND event = 'reclaim' THEN 'pending' WHEN status = 'failed' AND event = 'retry' THEN 'pending' ELSE status END AS file FROM o""")
def status_steps(spark, sf_dir):
    """What an event makes of a status, for each order as a repository and as a file; every status meets every event."""
    of = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % len(names) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", of(STATUSES, "o_orderkey").alias("status"), of(EVENTS, "o_custkey").alias("event"))
    return rows.select("o_orderkey", "status", "event", *[lifecycle.step(F.col("status"), F.col("event"), t).alias(n) for n, t in (("repo", lifecycle.REPO), ("file", lifecycle.FILE))])


def claimed(spark, sf_dir) -> DataFrame:
    """Orders as repositories in every state of a claim."""
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("pending", "claimed", "done", "failed", "seen"))), (k % 5 + 1).cast("int"))
    by = F.when(k % 5 != 0, lifecycle.worker_id(F.lit("host"), F.col("o_custkey") % 3))
    return table(spark, sf_dir, "orders").select(k.alias("id"), status.alias("status"), F.when(k % 5 != 4, F.when(k % 2 == 0, "clean").otherwise("profane")).alias("cohort"), by.alias("claimed_by"), F.col("o_orderdate").cast("timestamp_ntz").alias("claimed_at"), (F.col("o_custkey") % 97).alias("rate"))


CLAIMED_SQL = "c AS (SELECT o_orderkey AS id, (['pending', 'claimed', 'done', 'failed', 'seen'])[1 + o_orderkey % 5] AS status, CASE WHEN o_orderkey % 5 <> 4 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'clean' ELSE 'profane' END END AS cohort, CASE WHEN o_orderkey % 5 <> 0 THEN 'host-' || o_custkey % 3 END AS claimed_by, o_orderdate::TIMESTAMP AS claimed_at, o_custkey % 97 AS rate FROM orders)"


@query(f"""WITH {CLAIMED_SQL}, h AS (SELECT *, id % 7 = 0 AND id % 21 <> 0 AND cohort IS NOT NULL AND status IN ('pending', 'claimed', 'failed') AS hit FROM c)
SELECT id, CASE WHEN hit THEN 'missing' ELSE status END AS status, CASE WHEN NOT hit THEN claimed_by END AS claimed_by, CASE WHEN NOT hit THEN epoch(claimed_at)::BIGINT END AS claimed FROM h""")
def demote_missing(spark, sf_dir):
    """A third of the findings are null and change nothing."""
    found = F.when(F.col("id") % 21 != 0, F.col("id") % 7 == 0)
    return sampling.demote_missing(claimed(spark, sf_dir), found).select("id", "status", "claimed_by", F.unix_timestamp(F.col("claimed_at").cast("timestamp")).alias("claimed"))


@query(f"WITH {CLAIMED_SQL} SELECT id, 'claimed' AS status, 'me' AS claimed_by FROM c WHERE status = 'pending' ORDER BY rate DESC, id LIMIT 25")
def claim_next_rows(spark, sf_dir):
    return lifecycle.claim_next(claimed(spark, sf_dir), "me", 25).select("id", "status", "claimed_by")


def outcomes(spark, sf_dir) -> DataFrame:
    """What a worker reports for every second row; some say they are another's."""
    rows = claimed(spark, sf_dir).filter("status = 'claimed' AND id % 2 = 1")
    by = F.when(F.col("id") % 11 == 0, "other").otherwise(F.col("claimed_by"))
    reason = metadata.failure(F.when(F.col("id") % 3 == 0, "timeout").otherwise("git"), F.lit("exit 128"))
    return rows.select("id", by.alias("claimed_by"), (F.col("id") % 3 == 1).alias("ok"), reason.alias("reason"), (F.col("rate") / 2.0).alias("elapsed"))


@query(f"""WITH {CLAIMED_SQL}, h AS (SELECT *, status = 'claimed' AND id % 2 = 1 AND id % 11 <> 0 AS hit FROM c)
SELECT id, CASE WHEN NOT hit THEN status WHEN id % 3 = 1 THEN 'done' ELSE 'failed' END AS status, CASE WHEN hit AND id % 3 = 0 THEN 'timeout' WHEN hit AND id % 3 = 2 THEN 'git: exit 128' END AS failure_reason, CASE WHEN hit THEN rate / 2.0::DOUBLE END AS processing_time_sec FROM h""")
def mark_outcomes(spark, sf_dir):
    rows = claimed(spark, sf_dir).withColumns({"failure_reason": F.lit(None).cast("string"), "processing_time_sec": F.lit(None).cast("double")})
    return lifecycle.settle(rows, outcomes(spark, sf_dir)).select("id", "status", "failure_reason", "processing_time_sec")


@query(f"WITH {CLAIMED_SQL} SELECT count(*) AS misses FROM c WHERE status = 'claimed' AND id % 2 = 1 AND id % 11 = 0")
def claim_misses(spark, sf_dir):
    return lifecycle.cas_misses(claimed(spark, sf_dir), outcomes(spark, sf_dir)).agg(F.count("*").alias("misses"))


@query("SELECT o_custkey, max((o_orderdate, o_orderkey))[2] AS o_orderkey, '/scratch/w-' || o_custkey AS place FROM orders WHERE o_orderdate < DATE '1996-07-01' GROUP BY o_custkey")
def last_before_cutoff(spark, sf_dir):
    rows = lifecycle.last_before(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderdate", F.lit("1996-07-01").cast("date"))
    return rows.withColumn("place", lifecycle.scratch_path("/scratch/", F.col("o_custkey"), F.lit("w")))


@query("""WITH e AS (SELECT user_id, event_id % 2 AS k, count(*) AS n, list(DISTINCT event_type) AS kinds FROM events GROUP BY ALL) SELECT user_id, sum(n)::BIGINT AS n, array_to_string(list_sort(list_distinct(flatten(list(kinds)))), ',') AS kinds FROM e GROUP BY user_id""")
def upsert_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    part = lambda k: rows.filter(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.count("*").alias("n"), F.collect_set("event_type").alias("kinds"))
    return rollup.upsert(part(0), part(1), "user_id", ["n"], [], ("kinds",)).withColumn("kinds", F.array_join("kinds", ","))


@query(SQL["upsert_sets"])
def upsert_stored(spark, sf_dir):
    """The same through a stored table: half of the events make it, the others update the parts that they fall into."""
    rows = table(spark, sf_dir, "events")
    part = lambda k: rows.filter(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("event_type")).alias("kinds"))
    users = store.Store(spark, f"users_{uuid.uuid4().hex}", "user_id", parts=8)
    users.create(part(0))
    store.upsert(users, part(1), ["n"], ("kinds",))
    out = written(users.rows().withColumn("kinds", F.array_join("kinds", ",")), "users")
    spark.sql(f"DROP TABLE {users.name}")
    return out


def probed(spark, sf_dir, refetch: bool = False) -> DataFrame:
    """Customers as cohort rows after a probe: some had metadata, some are gone, some were never asked."""
    k = F.col("c_custkey")
    held = F.when(k % 4 == 0, F.to_json(F.struct(F.lit("Old").alias("language"))))
    rows = dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(k.alias("id"), F.when(k % 3 == 0, "profane").otherwise("clean").alias("cohort"), F.when(k % 10 == 9, "seen").otherwise("done").alias("status"), metadata.metadata(held, F.lit(NOW)).alias("metadata"), F.lit(None).cast("map<string,bigint>").alias("languages_bytes"), F.lit(None).cast("timestamp").alias("missing_at"))
    asked = metadata.to_probe(rows, refetch).filter("id % 6 <> 5")
    payloads = asked.select("id", F.when(F.col("id") % 5 != 1, F.to_json(F.struct(F.element_at(F.array(F.lit("Go"), F.lit(None).cast("string"), F.lit("Python")), (F.col("id") % 3 + 1).cast("int")).alias("language")))).alias("payload"))
    languages = asked.filter("id % 2 = 0").select("id", F.format_string('{"Go": %d, "C": "x", "Py": 2}', "id").alias("payload"))
    return metadata.apply_probe(rows, metadata.merged(payloads, languages, "id", F.lit(NOW)), "id", F.lit(NOW))


PROBED_SQL = """p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'profane' ELSE 'clean' END AS cohort, CASE WHEN c_custkey % 10 = 9 THEN 'seen' ELSE 'done' END AS status, c_custkey % 4 = 0 AS held FROM customer),
a AS (SELECT *, NOT held AND status = 'done' AND id % 6 <> 5 AS asked FROM p),
f AS (SELECT *, asked AND id % 5 <> 1 AS found, asked AND id % 5 = 1 AS gone, CASE WHEN held THEN 'Old' WHEN asked AND id % 5 <> 1 THEN (['Go', NULL, 'Python'])[1 + id % 3] END AS language FROM a)"""


@query(f"WITH {PROBED_SQL} SELECT id, held OR found AS has_metadata, language, gone, CASE WHEN found THEN CASE WHEN id % 2 = 0 THEN 'Go=' || id || ' Py=2' ELSE '' END END AS languages FROM f")
def metadata_probe(spark, sf_dir):
    told = F.array_join(F.transform(F.array_sort(F.map_entries("languages_bytes")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ")
    return probed(spark, sf_dir).select("id", F.col("metadata").isNotNull().alias("has_metadata"), F.col("metadata.language").alias("language"), F.col("missing_at").isNotNull().alias("gone"), told.alias("languages"))


@query("""SELECT c_custkey AS id, c_custkey * 3 AS stargazers_count, c_custkey % 11 AS forks_count, 0::BIGINT AS watchers_count, c_nationkey::BIGINT AS subscribers_count, c_custkey % 2 AS open_issues_count, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE lower(c_mktsegment) || ',b' END AS topics,
CASE WHEN c_custkey % 4 <> 0 THEN 'MIT' END AS license_spdx, CASE WHEN c_custkey % 5 <> 0 THEN 'Go' END AS language, c_custkey * 100 AS size_kb, 'main' AS default_branch, c_custkey % 2 = 0 AS fork, CASE WHEN c_custkey % 2 = 0 THEN 'o/' || c_nationkey END AS parent_full_name, c_custkey % 7 = 0 AS archived, c_custkey % 9 = 0 AS disabled,
1577836800 + c_custkey AS created, CASE WHEN c_custkey % 6 <> 0 THEN 1577836800 + 2 * c_custkey END AS pushed, NULL::BIGINT AS updated, c_name AS description, 1704153600::BIGINT AS fetched, CASE WHEN c_custkey % 7 = 0 THEN 'archived' WHEN c_custkey % 9 = 0 THEN 'disabled' WHEN c_custkey * 100 > 2048 * 1024 THEN 'oversize: ' || floor(c_custkey * 100 / 1024.0)::BIGINT || ' MiB' END AS skip
FROM customer WHERE c_custkey % 13 <> 0""")
def metadata_fields(spark, sf_dir):
    """All twenty fields of a payload, absent, null and odd ones among them; payloads that are no objects give nothing."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    at = lambda t: F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = F.struct(
        (k * 3).alias("stargazers_count"), (k % 11).alias("forks_count"), F.lit("many").alias("watchers_count"), n.alias("subscribers_count"), (k % 2).alias("open_issues_count"),
        F.when(k % 3 != 0, F.array(F.lower("c_mktsegment"), F.lit("b"))).alias("topics"), F.when(k % 4 != 0, F.struct(F.lit("MIT").alias("spdx_id"))).alias("license"), F.when(k % 5 != 0, F.lit("Go")).alias("language"), (k * 100).alias("size"),
        F.lit("main").alias("default_branch"), (k % 2 == 0).alias("fork"), F.when(k % 2 == 0, F.struct(F.concat(F.lit("o/"), n.cast("string")).alias("full_name"))).alias("parent"), F.when(k % 7 == 0, F.lit(True)).alias("archived"), F.when(k % 9 == 0, F.lit(True)).alias("disabled"),
        at(k + 1577836800).alias("created_at"), F.when(k % 6 != 0, at(2 * k + 1577836800)).alias("pushed_at"), F.lit("no time").alias("updated_at"), F.col("c_name").alias("description"),
    )
    payload = F.when(k % 13 == 0, F.lit("[1]")).otherwise(F.to_json(fields))
    rows = computed(dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_name"), "c_custkey").select(k.alias("id"), payload.alias("payload")), m=metadata.metadata(F.col("payload"), F.lit(NOW))).filter("m IS NOT NULL").select("id", "m.*")
    times = {"created_at": "created", "pushed_at": "pushed", "updated_at": "updated", "fetched_at": "fetched"}
    skip = metadata.skip_reason(F.col("archived"), F.col("disabled"), F.col("size_kb"))
    return rows.select("*", skip.alias("skip"), *[F.unix_timestamp(c).alias(name) for c, name in times.items()]).withColumn("topics", F.array_join("topics", ",")).drop(*times)


def labelled(spark, sf_dir) -> DataFrame:
    return probed(spark, sf_dir).withColumn("label", reports.language_label(F.col("metadata.language"), F.col("metadata").isNotNull(), F.col("missing_at").isNotNull()))


LABEL_SQL = "CASE WHEN held OR found THEN coalesce(language, '<null>') WHEN gone THEN '<missing>' ELSE '<not-probed>' END"


@query(f"WITH {PROBED_SQL} SELECT coalesce(label, '<total>') AS label, count(*) FILTER (WHERE cohort = 'profane') AS profane, count(*) FILTER (WHERE cohort = 'clean') AS clean, count(*) AS total FROM (SELECT *, {LABEL_SQL} AS label FROM f) GROUP BY ROLLUP (label)")
def cohort_language_totals(spark, sf_dir):
    return reports.pivot_counts(labelled(spark, sf_dir), "label", "cohort", ["profane", "clean"], grand=True).orderBy(F.col("total").desc(), "label")


def _coverage_sql() -> str:
    one = lambda name, held: f"SELECT '{name}' AS tool, count(*) FILTER (WHERE label IN ({', '.join(repr(x) for x in held)})) AS n, 100.0::DOUBLE * count(*) FILTER (WHERE label IN ({', '.join(repr(x) for x in held)})) / count(*) AS pct FROM l"
    return f"WITH {PROBED_SQL}, l AS (SELECT {LABEL_SQL} AS label FROM f) " + " UNION ALL ".join(one(k, v) for k, v in reports.TOOLS.items())


@query(_coverage_sql())
def tool_coverage_sets(spark, sf_dir):
    return reports.coverage(labelled(spark, sf_dir), "label")


@query(f"""WITH {CLAIMED_SQL}, s AS (SELECT unnest(['done', 'failed', 'missing']) AS status, unnest([0, 1, 2]) AS place), n AS (SELECT status, nullif(count(*) FILTER (WHERE cohort = 'profane'), 0) AS profane, nullif(count(*) FILTER (WHERE cohort = 'clean'), 0) AS clean FROM c WHERE cohort IS NOT NULL GROUP BY status)
SELECT s.place::INTEGER AS place, s.status, profane, clean FROM s LEFT JOIN n USING (status)""")
def cohort_funnel(spark, sf_dir):
    return reports.funnel(claimed(spark, sf_dir))


@query(f"WITH {CLAIMED_SQL} SELECT status, count(*) AS n FROM c GROUP BY status ORDER BY n DESC, status LIMIT 3")
def largest_status_groups(spark, sf_dir):
    return claimed(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "status").limit(3)


@query(" UNION ALL ".join(f"SELECT '{m}' AS metric, count({m}) FILTER (WHERE cohort = 'clean') AS n_first, count({m}) FILTER (WHERE cohort = 'profane') AS n_second, 100.0::DOUBLE * count(*) FILTER (WHERE {m} IS NULL) / count(*) AS pct_missing FROM ({COHORT_SQL})" for m in ("n_chars", "quality")))
def missingness(spark, sf_dir):
    return reports.missingness(cohorts(spark, sf_dir), "cohort", ["n_chars", "quality"], "clean", "profane")


def studied(spark, sf_dir) -> DataFrame:
    """Documents as analysed repositories."""
    rows, n = cohorts(spark, sf_dir), F.col("n_chars").cast("double")
    names = {v.split(".")[1] for v in reports.STUDY.values() if "." in v}
    analysis = F.struct(*[(n / (i + 1)).alias(c) for i, c in enumerate(sorted(names))])
    return rows.select(F.concat(F.lit("o/"), F.col("doc_id").cast("string")).alias("full_name"), "cohort", F.col("lang").alias("primary_language"), F.when(F.col("doc_id") % 5 != 0, "done").otherwise("failed").alias("status"), analysis.alias("code_analysis"))


def _study_sql() -> str:
    names = sorted({v.split(".")[1] for v in reports.STUDY.values() if "." in v})
    cols = ", ".join({"full_name": "'o/' || doc_id AS full_name", "cohort": "cohort", "primary_language": "lang AS primary_language"}.get(k) or f"n_chars::DOUBLE / {names.index(v.split('.')[1]) + 1} AS {k}" for k, v in reports.STUDY.items())
    return f"SELECT {cols} FROM ({COHORT_SQL}) WHERE cohort IS NOT NULL AND doc_id % 5 <> 0"


@query(_study_sql())
def study_frame(spark, sf_dir):
    return reports.study_frame(studied(spark, sf_dir))


RANKS = f"""d AS (SELECT *, length(text) - length(replace(text, chr(10), '')) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_caps FROM ({COHORT_SQL}) WHERE cohort IS NOT NULL),
l AS (SELECT doc_id, cohort, lang, unnest(['n_chars', 'n_lines', 'n_caps']) AS metric, unnest([n_chars, n_lines, n_caps])::DOUBLE AS x FROM d),
s AS (SELECT 'pooled' AS subset, metric, cohort, x FROM l UNION ALL SELECT 'en', metric, cohort, x FROM l WHERE lang = 'en' UNION ALL SELECT 'de or fr', metric, cohort, x FROM l WHERE lang IN ('de', 'fr')),
r AS (SELECT *, rank() OVER (PARTITION BY subset, metric ORDER BY x) + (count(*) OVER (PARTITION BY subset, metric, x) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY subset, metric, x) AS t FROM s WHERE x IS NOT NULL),
g AS (SELECT subset, metric, count(*) FILTER (WHERE cohort = 'clean') AS n1, count(*) FILTER (WHERE cohort = 'profane') AS n2, sum(rk) FILTER (WHERE cohort = 'clean') AS r1, sum((t::DOUBLE * t - 1)) AS ties FROM r GROUP BY ALL),
u AS (SELECT *, CASE WHEN least(n1, n2) >= 5 THEN r1 - n1 * (n1 + 1) / 2.0::DOUBLE END AS u FROM g),
p AS (SELECT *, CASE WHEN u IS NOT NULL THEN {p_value_sql("u", "n1", "n2", "ties")} END AS p FROM u)"""
SUBSETS = {"pooled": (), "en": ("en",), "de or fr": ("de", "fr")}


@query(f"WITH {RANKS} SELECT metric, u, round(p, 6) AS p, p < 0.05 / 3 AS significant FROM p WHERE subset = 'pooled'")
def mwu_significance(spark, sf_dir):
    return stats.mann_whitney(metric_frame(spark, sf_dir)).select("metric", "u", F.round("p", 6).alias("p"), "significant")


@query(f"WITH {RANKS} SELECT subset, metric, n1::BIGINT AS n1, n2::BIGINT AS n2, u, round(p, 6) AS p, p < 0.05 / 5 AS significant FROM p WHERE subset <> 'en' OR metric <> 'n_caps'")
def mwu_subsets(spark, sf_dir):
    """The rank tests of every subset in one job, in the order of p; the second subset leaves out a metric."""
    long = stats.in_subsets(metric_frame(spark, sf_dir, "lang"), "lang", SUBSETS)
    metrics = {k: tuple(m for m in METRICS if (k, m) != ("en", "n_caps")) for k in SUBSETS}
    return stats.mwu_tables(long, metrics, family=5).select("subset", "metric", F.col("n1").cast("bigint").alias("n1"), F.col("n2").cast("bigint").alias("n2"), "u", F.round("p", 6).alias("p"), "significant")


@query()
def forest_rows(spark, sf_dir):
    return stats.forest(metric_frame(spark, sf_dir)).select("metric", "r_rb", "low", "high")


@query()
def median_panel(spark, sf_dir):
    long = metric_frame(spark, sf_dir, "lang")
    subset = F.filter(F.array(F.lit("pooled"), "lang"), lambda x: x.isNotNull())
    return stats.bootstrap_median(long.select(F.explode(subset).alias("subset"), "metric", "cohort", "x"), by=("subset", "metric", "cohort"))


@query()
def per_language_panel(spark, sf_dir):
    return stats.median_rows(stats.in_subsets(metric_frame(spark, sf_dir, "lang"), "lang", SUBSETS), family=5)


@query(f"""WITH {COHORT_CTE}, c AS (SELECT bin, n FROM counts) SELECT 'bins' AS part, string_agg(bin || ':' || n, ' ' ORDER BY bin) AS told, 0.05::DOUBLE AS alpha FROM c
UNION ALL SELECT 'statuses', (SELECT string_agg(o_orderstatus || ':' || n, ' ' ORDER BY o_orderstatus) FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)), 0.05""")
def results_report(spark, sf_dir):
    """The report written as one JSON document and read again."""
    where = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    bins = sampling.bin_counts(sampling.profane(repos(spark, sf_dir), 60, CONF), CONF)
    statuses = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    reports.results_json({"bins": bins, "statuses": statuses}, where, alpha=0.05, title="cohorts")
    read = spark.read.json(where, schema="alpha double, title string, bins array<struct<bin: bigint, n: bigint>>, statuses array<struct<o_orderstatus: string, n: bigint>>")
    told = lambda c, k: F.array_join(F.transform(F.array_sort(c), lambda x: F.concat(x[k].cast("string"), F.lit(":"), x["n"].cast("string"))), " ")
    each = F.explode(F.array(F.struct(F.lit("bins").alias("part"), told("bins", "bin").alias("told")), F.struct(F.lit("statuses").alias("part"), told("statuses", "o_orderstatus").alias("told")))).alias("e")
    return read.select(each, "alpha").select("e.*", "alpha")
