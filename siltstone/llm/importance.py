"""Quality classifier by importance resampling.

Two bag-of-n-grams models over the same hashed buckets, one of the target (documents labelled good) and one of the raw
text (all documents), give each document a log importance weight; Gumbel noise keyed by the document makes the top k of
the sum a sample without replacement in proportion to the weights. N-grams are words and punctuation runs, pairs of
them, and triples of their shapes (case, digits, punctuation, repeat of the token before).
"""

from __future__ import annotations

import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import CACHES, drop_caches, each_row, staged, trim_memory, with_rank, without

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 1 << 14


def shape(token: str) -> str:
    if not (token[0].isalnum() or token[0] == "_"):
        return "p" if len(token) == 1 else "P"
    if token.isdigit():
        return "0"
    return "A" if len(token) > 1 and token.isupper() else "a"


class _Shapes(dict):
    def __missing__(self, token: str) -> tuple[str, int]:
        if len(self) > 100_000:
            self.clear()
        self[token] = got = (shape(token), crc32(token.lower().encode()))
        return got


_SHAPES = _Shapes()
CACHES.append(_SHAPES)


def _drop_others() -> None:
    """At module level, so that it names the worker's own memory; a nested function would carry a copy of it."""
    drop_caches(_SHAPES)


def buckets_of(text: str | None) -> np.ndarray:
    """The hashed n-grams of the whole text, one entry for each occurrence."""
    tokens = TOKEN.findall(text or "")
    if not tokens:
        return np.zeros(0, dtype=np.int64)
    got = [_SHAPES[t] for t in tokens]
    h = np.array([g[1] for g in got], dtype=np.uint64)
    s = np.array([ord(g[0]) for g in got], dtype=np.uint64)
    s[1:] += np.uint64(128) * (h[1:] == h[:-1])
    pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    three = ((s[:-2] << np.uint64(16)) | (s[1:-1] << np.uint64(8)) | s[2:]) + np.uint64(1 << 40) if len(s) > 2 else np.zeros(0, np.uint64)
    mixed = np.concatenate([h, pair, three]) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(50)).astype(np.int64)


def model_counts(docs: DataFrame, labels: DataFrame, sample_limit: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Counts per bucket over all documents, and over at most sample_limit good ones; the share of good among the labelled."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("q")).filter(F.col("q").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("q").alias("q"))
    good, n = known.agg(F.sum("q"), F.count("*")).first()
    target = F.broadcast(known.filter("q = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_limit).select("doc_id", F.lit(True).alias("target")))

    def run(batches):
        _drop_others()
        raw, aim = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t, is_target in each_row(b):
                c = np.bincount(buckets_of(t), minlength=BUCKETS)
                raw += c
                if is_target:
                    aim += c
        at = np.flatnonzero(raw)
        trim_memory()
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(aim[at])], ["bucket", "raw", "aim"])

    marked = docs.select("doc_id", "text").join(target, "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    sums = marked.mapInArrow(run, "bucket bigint, raw bigint, aim bigint").groupBy("bucket").agg(F.sum("raw"), F.sum("aim")).collect()  # at most BUCKETS rows
    raw, aim = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for k, r, a in sums:
        raw[k], aim[k] = r, a
    return raw, aim, (good / n if n else 1.0)


def gumbel(doc_id: F.Column, seed: int) -> F.Column:
    """Standard Gumbel noise from a hash of seed and id; the same for every run and partitioning."""
    u = (F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def _ranked(docs: DataFrame, labels: DataFrame, share: float | None = None, slack: float = 0.01, sample_limit: int = 20_000, smoothing: float = 1.0, seed: int = 7) -> DataFrame:
    """importance_resample's rows, with th, the hash of the text."""
    raw, aim, good = model_counts(docs, labels, sample_limit)
    if aim.sum() == 0:
        aim, good = raw, 1.0
    ratio = np.log((aim + smoothing) / (aim.sum() + smoothing * BUCKETS)) - np.log((raw + smoothing) / (raw.sum() + smoothing * BUCKETS))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        _drop_others()
        for b in batches:
            found = [(len(x), float(shared.value[x].sum())) for x in (buckets_of(t) for _, t, _ in each_row(b))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([n for n, _ in found], pa.int64()), pa.array([w for _, w in found], pa.float64())], ["doc_id", "th", "n_grams", "log_weight"])
        drop_caches()  # a reused worker keeps nothing for later stages

    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).mapInArrow(run, "doc_id bigint, th bigint, n_grams bigint, log_weight double")
    scored = staged(scored.withColumn("score", F.col("log_weight") + gumbel(F.coalesce("doc_id", F.lit(-1)), seed)), "importance")
    k = math.ceil(min(1.0, share if share is not None else good + slack) * scored.count())
    ranked = with_rank(scored, [], [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_grams")], "rank", "importance-rank")
    return ranked.select("doc_id", "th", "n_grams", "log_weight", "score", (F.col("rank") < k).alias("kept"))


def importance_resample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_grams, log_weight, score (with Gumbel noise), kept (among the top k).

    Options: share, slack, sample_limit, smoothing, seed. k is share of all rows; by default the share of good rows among
    the labelled, and slack more, so that clean documents are not crowded out by noise at the edge. The target's model
    takes at most sample_limit good rows; the raw one all rows. Ties are broken by id, then n_grams; null ids come last. A
    null or empty text has weight 0. Repeated ids get the same noise; of equal rows at the edge any one is taken. Without
    labels all rows stay; an empty table gives no rows. Other columns are ignored. Very long texts are counted whole.
    """
    return _ranked(docs, labels, **options).drop("th")


def resampled(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with their own columns; rows of equal id and text stay if any of them does.

    Nulls, ties and missing labels count as in importance_resample; an empty table stays empty. Only rows that may have to
    go are shuffled.
    """
    rows = _ranked(docs, labels, **options)
    gone = rows.groupBy("doc_id", "th").agg(F.max("kept").alias("kept")).filter("NOT kept").select("doc_id", "th")
    return without(docs, gone, "importance")
