"""Per-repository state: partials by file, their merge, rates, top words, samples, and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import rate


def first_samples(rows: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """(keys, samples): the first of each group's samples (at, sample) in order. The limit is applied before the shuffle and
    after it, so no more than samples rows of a group are ever held together."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("at", "sample"))
    first = rows.filter("sample IS NOT NULL").select(*keys, "at", "sample").withColumn("place", place).filter(F.col("place") <= samples)
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "sample"))).alias("samples"))


def with_samples(groups: DataFrame, first: DataFrame, keys: list[str]) -> DataFrame:
    """groups with their samples, none as an empty array; keys may be null."""
    renamed = first.withColumnsRenamed({k: f"__{k}" for k in keys})
    out = groups.join(renamed, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left").drop(*[f"__{k}" for k in keys])
    return out.withColumn("samples", F.coalesce("samples", F.array().cast(first.schema["samples"].dataType)))


def partials(scored: DataFrame, samples: int = 5) -> DataFrame:
    """One row for each (file_id, repo_id): counters, authors, first name and time, the first sample messages. scored is
    read twice: hand it over written where it is costly."""
    keys = ["file_id", "repo_id"]
    counted = scored.groupBy(*keys).agg(
        F.count("*").alias("commits"), F.sum(F.size("hits").cast("bigint")).alias("profanity_hits"), F.sum(F.size("glyphs").cast("bigint")).alias("emoji_hits"),
        F.count_if(F.size("glyphs") > 0).alias("emoji_commits"), F.array_sort(F.collect_set("author")).alias("authors"),
        F.min(F.struct("seen_at", "file_id", "line_no", "pos", "repo_name")).alias("first"),
    )
    return with_samples(counted, first_samples(scored.withColumn("at", F.struct("file_id", "line_no", "pos")), keys, samples), keys)


def histogram(scored: DataFrame, values: Column, keys: tuple[str, ...] = ("file_id", "repo_id")) -> DataFrame:
    """Long-form counters: keys, key, n."""
    return scored.select(*keys, F.explode(values).alias("key")).groupBy(*keys, "key").agg(F.count("*").alias("n"))


def merge(parts: DataFrame, samples: int = 5) -> DataFrame:
    """Repositories from partials of any files; every aggregate is associative, so late files need no order."""
    out = parts.groupBy("repo_id").agg(
        F.sum("commits").alias("commits"), F.sum("profanity_hits").alias("profanity_hits"), F.sum("emoji_hits").alias("emoji_hits"), F.sum("emoji_commits").alias("emoji_commits"), F.min("first").alias("first"),
    )
    each = parts.select("repo_id", F.explode("authors").alias("author")).distinct()  # in long form, so that files' lists do not meet
    authors = each.groupBy("repo_id").agg(F.array_sort(F.collect_list("author")).alias("authors"))
    known = parts.select("repo_id", F.explode("samples").alias("s")).select("repo_id", "s.*")
    out = with_samples(out.join(authors, "repo_id", "left").withColumn("authors", F.coalesce("authors", F.array().cast("array<string>"))), first_samples(known, ["repo_id"], samples), ["repo_id"])
    return out.withColumn("profanity_rate", rate(F.col("profanity_hits"), F.col("commits"))).withColumn("emoji_rate", rate(F.col("emoji_hits"), F.col("commits")))


def counters(scored: DataFrame) -> DataFrame:
    """Long-form map counters of each (file_id, repo_id): kind (languages, words, glyphs), key, n."""
    tagged = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("key")))
    each = F.explode(F.concat(tagged("languages", F.array("language")), tagged("words", F.col("hits")), tagged("glyphs", F.col("glyphs")))).alias("c")
    return scored.select("file_id", "repo_id", each).groupBy("file_id", "repo_id", "c.kind", "c.key").agg(F.count("*").alias("n"))


#: Column of the repository for each kind of counter.
MAPS = {"languages": "languages_detected", "words": "profanity_top", "glyphs": "emoji_top"}


def merged_maps(counts: DataFrame) -> DataFrame:
    """repo_id and a map for each kind, from counters of any files; every count is kept (finalize prunes)."""
    total = counts.groupBy("repo_id", "kind", "key").agg(F.sum("n").alias("n"))
    entry = F.struct("key", "n")
    return total.groupBy("repo_id").agg(*[F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, entry)))).alias(name) for kind, name in MAPS.items()])


def with_maps(repos: DataFrame, maps: DataFrame) -> DataFrame:
    """repos (one row for each repo_id) with its maps; without counters they are empty."""
    out = repos.join(maps, "repo_id", "left")
    return out.withColumns({c: F.coalesce(c, F.create_map().cast("map<string,bigint>")) for c in MAPS.values()})


def entries(counts: Column) -> Column:
    """A map's entries as structs (key, value), ordered by key."""
    return F.array_sort(F.map_entries(counts))


def pruned(counts: Column, n: int) -> Column:
    """A map's n largest counters, ties by key."""
    order = F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("less"), e["key"].alias("key")))
    return F.map_from_entries(F.transform(F.slice(F.array_sort(order), 1, n), lambda e: F.struct(e["key"].alias("key"), (-e["less"]).alias("value"))))


def finalize(repos: DataFrame, top: int = 20) -> DataFrame:
    """The state after all files: rates, and word and glyph maps cut to their largest counters."""
    return repos.withColumns({
        "profanity_rate": rate(F.col("profanity_hits"), F.col("commits")), "emoji_rate": rate(F.col("emoji_hits"), F.col("commits")),
        "profanity_top": pruned(F.col("profanity_top"), top), "emoji_top": pruned(F.col("emoji_top"), top),
    })


def file_effects(parts: DataFrame) -> DataFrame:
    """(file_id, upserted, modified): repositories that the file saw first, and others that it adds to."""
    first = parts.groupBy("repo_id").agg(F.min("file_id").alias("first"))
    seen = parts.select("file_id", "repo_id").join(first, "repo_id")
    new = F.col("file_id") == F.col("first")
    return seen.groupBy("file_id").agg(F.count_if(new).alias("upserted"), F.count_if(~new).alias("modified"))


def top_n(counts: DataFrame, keys: list[str], key: str = "key", n_col: str = "n", n: int = 3) -> DataFrame:
    """The n largest counters of each group, ties by key."""
    w = Window.partitionBy(*keys).orderBy(F.col(n_col).desc(), F.col(key))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def as_maps(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias(name))


def upsert(existing: DataFrame, delta: DataFrame, key: str, counters: list[str], on_insert: list[str], add_to_set: tuple[str, ...] = ()) -> DataFrame:
    """Add delta's counters to existing rows by key, insert the rest; on_insert columns keep the existing value, and
    add_to_set columns, arrays, take in what they lack (sorted)."""
    old, new = existing.withColumn("__new", F.lit(0)), delta.withColumn("__new", F.lit(1))
    return old.unionByName(new).groupBy(key).agg(
        *[F.sum(c).alias(c) for c in counters], *[F.min_by(c, "__new").alias(c) for c in on_insert],
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in add_to_set],
    )
