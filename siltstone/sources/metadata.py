"""Repository metadata: fetched JSON payloads to columns, language byte maps, and who is skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("stargazers_count", "forks_count", "watchers_count", "subscribers_count", "open_issues_count")
TIMES = ("created_at", "pushed_at", "updated_at")


def metadata(payload: Column, fetched_at: Column) -> Column:
    """The fields of a payload, null if that is no object. It is parsed once for all of them: as the element of an array that
    is transformed, the parsed value is not put in place of each use."""
    return F.transform(F.array(F.try_parse_json(payload)), lambda v: _fields(v, fetched_at))[0]


def _fields(v: Column, fetched_at: Column) -> Column:
    text = lambda p: F.try_variant_get(v, f"$.{p}", "string")
    whole = lambda p: F.coalesce(F.try_variant_get(v, f"$.{p}", "bigint"), F.lit(0).cast("bigint"))
    flag = lambda p: F.coalesce(F.try_variant_get(v, f"$.{p}", "boolean"), F.lit(False))
    topics = F.coalesce(F.try_variant_get(v, "$.topics", "array<string>"), F.array().cast("array<string>"))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.struct(
        fetched_at.alias("fetched_at"), *[whole(c).alias(c) for c in COUNTS], topics.alias("topics"), text("license.spdx_id").alias("license_spdx"), text("language").alias("language"),
        whole("size").alias("size_kb"), text("default_branch").alias("default_branch"), flag("fork").alias("fork"), text("parent.full_name").alias("parent_full_name"),
        flag("archived").alias("archived"), flag("disabled").alias("disabled"), *[F.try_to_timestamp(text(t)).alias(t) for t in TIMES], text("description").alias("description"),
    ))


def language_bytes(payload: Column) -> Column:
    return F.map_filter(F.try_variant_get(F.try_parse_json(payload), "$", "map<string,bigint>"), lambda k, n: n.isNotNull())


def skip_reason(archived: Column, disabled: Column, size_kb: Column, max_mb: int = 2048) -> Column:
    """Why a repository is not analysed; null if it is."""
    over = F.concat(F.lit("oversize: "), F.floor(size_kb / 1024).cast("string"), F.lit(" MiB"))
    return F.when(archived, F.lit("archived")).when(disabled, F.lit("disabled")).when(size_kb > max_mb * 1024, over)


LIVE = ("pending", "claimed", "done", "failed")


def to_probe(repos: DataFrame, refetch: bool = False) -> DataFrame:
    """Live cohort rows whose metadata is still to be fetched, or all of them again."""
    live = repos.filter(F.col("status").isin(*LIVE) & F.col("cohort").isin("profane", "clean"))
    return live if refetch else live.filter("metadata IS NULL")


def merged(payloads: DataFrame, languages: DataFrame, key: str, fetched_at: Column) -> DataFrame:
    """(key, metadata, languages_bytes): payloads and languages (key, payload) of fetched repositories; without languages the map is empty."""
    meta = payloads.select(key, metadata(F.col("payload"), fetched_at).alias("metadata"))
    bytes_ = languages.select(key, language_bytes(F.col("payload")).alias("languages_bytes"))
    return meta.join(bytes_, key, "left").withColumn("languages_bytes", F.coalesce("languages_bytes", F.create_map().cast("map<string,bigint>")))


def apply_probe(repos: DataFrame, fetched: DataFrame, key: str, now: Column) -> DataFrame:
    """repos (with metadata, languages_bytes, missing_at) after a probe: fetched has key and the two columns, null metadata
    where there is no such repository any more, which stamps missing_at; finding one clears it."""
    new = fetched.select(F.col(key).alias("__k"), F.col("metadata").alias("__m"), F.col("languages_bytes").alias("__l"))
    out = repos.join(new, F.col(key) == F.col("__k"), "left")
    asked, found = F.col("__k").isNotNull(), F.col("__m").isNotNull()
    return out.withColumns({
        "metadata": F.coalesce("__m", "metadata"), "languages_bytes": F.when(found, F.col("__l")).otherwise(F.col("languages_bytes")),
        "missing_at": F.when(asked & ~found, now).when(~asked, F.col("missing_at")),
    }).drop("__k", "__m", "__l")


def failure(kind: Column, detail: Column) -> Column:
    """A failure reason: timeout, or kind (skip, git, or an error's name) and at most 200 characters of detail."""
    return F.when(kind == "timeout", F.lit("timeout")).otherwise(F.concat(kind, F.lit(": "), F.substring(detail, 1, 200)))
