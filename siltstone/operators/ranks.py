"""Order statistics and bootstraps of counted values that no single task holds.

Values are counted first. The counts are cut into ranges by (keys, value), each range is summed, and what lies before a
range is looked up in the sums of a key's ranges (one number for each range). So a rank, a share or a median needs no task
that sees all values of a key, and a resample can be dealt: how many of its draws fall into each range is one multinomial
over the ranges' sums, which every task draws alike, and within a range it is one over the range's own counts.
"""

from __future__ import annotations

from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import written

CELLS = 1 << 21  #: counts of resamples that a task holds at once


def cumulated(counted: DataFrame, keys: list[str], x: str, counts: list[str]) -> DataFrame:
    """counted (one row for each keys and x; counts are whole numbers) with part, the range of values that the row lies in;
    parts, the sums of all of a key's ranges in order; and for each count c, c_before (of smaller x) and c_total."""
    spark = counted.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(counted.repartitionByRange(n, *keys, x).withColumn("part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*keys, "part").agg(*[F.sum(c).cast("bigint").alias(c) for c in counts])
    parts = sums.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.array_sort(F.collect_list(F.struct("part", *counts))).alias("parts"))  # a number for each range
    rows = ranged.join(parts, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])).drop(*[f"__{k}" for k in keys])
    inside = Window.partitionBy(*keys, "part").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    over = lambda parts, c: F.aggregate(parts, zero, lambda total, p: total + p[c])
    before = lambda c: F.coalesce(F.sum(c).over(inside), zero) + over(F.filter("parts", lambda p: p["part"] < F.col("part")), c)
    return rows.select("*", *[e for c in counts for e in (before(c).alias(f"{c}_before"), over(F.col("parts"), c).alias(f"{c}_total"))])


def median_of(x: str, c: str) -> Column:
    """The median of the values that count c stands for, as an aggregate over cumulated rows; null if there are none."""
    at = lambda k: F.max(F.when((F.col(f"{c}_before") <= k) & (k < F.col(f"{c}_before") + F.col(c)), F.col(x)))
    total = F.col(f"{c}_total")
    return (at(F.floor((total - 1) / 2)) + at(F.floor(total / 2))) / 2


def dealt_draws(key: str, seed: int, sums: np.ndarray, resamples: int) -> np.ndarray:
    """Draws of each resample in each range, [resample, range]: the same for whoever asks with the same key and sums."""
    rng = np.random.default_rng([seed, crc32(key.encode())])
    return rng.multinomial(int(sums.sum()), sums / sums.sum(), size=resamples)


def _range_rng(key: str, seed: int, part: int, what: int) -> np.random.Generator:
    return np.random.default_rng([seed, crc32(key.encode()), part + 1, what])


def _draws(rng: np.random.Generator, n: np.ndarray, counts: np.ndarray):
    """(from, to, [resample, value] counts) of n draws each over the counts, a few resamples at a time."""
    share = counts / max(1, counts.sum())
    step = max(1, CELLS // max(1, len(counts)))
    for at in range(0, len(n), step):
        yield at, min(len(n), at + step), rng.multinomial(n[at : at + step], share) if counts.sum() else np.zeros((len(n[at : at + step]), len(counts)), np.int64)


def _sorted(rows: pa.Table, keys: list[str], counts: list[str]):
    """(key, part, place, x, counts, sums) of one range of one key, by x."""
    order = np.argsort(rows["x"].to_numpy(), kind="stable")
    first = {c: rows[c][0].as_py() for c in (*keys, "part", "place", *(f"{c}_sums" for c in counts))}
    return "\x1f".join(str(first[k]) for k in keys), first["part"], first["place"], rows["x"].to_numpy()[order], [rows[c].to_numpy()[order] for c in counts], [np.array(first[f"{c}_sums"], np.int64) for c in counts]


def _told(rows: pa.Table, keys: list[str], size: int, **columns: np.ndarray) -> pa.Table:
    """size rows of a key with these columns."""
    return pa.table({k: pa.repeat(rows[k][0], size) for k in keys} | {c: pa.array(v) for c, v in columns.items()})


def _ranges(*counts: str) -> list[Column]:
    """place, that of the row's range among its key's, and the sums of all of them."""
    at = F.size(F.filter("parts", lambda p: p["part"] < F.col("part")))
    return [at.alias("place"), *[F.col(f"parts.{c}").alias(f"{c}_sums") for c in counts]]


def effect_resamples(rows: DataFrame, keys: list[str], resamples: int, seed: int, least: int) -> DataFrame:
    """(keys, resample, r_rb) of cumulated counts a and b: the rank-biserial effect of each resample of both sides."""

    def one(table: pa.Table) -> pa.Table:
        key, part, place, _, (a, b), (a_sums, b_sums) = _sorted(table, keys, ["a", "b"])
        dealt_a, dealt_b = dealt_draws(key + "\x1fa", seed, a_sums, resamples), dealt_draws(key + "\x1fb", seed, b_sums, resamples)
        u = dealt_a[:, place] * dealt_b[:, :place].sum(1).astype(float)  # all of these values are above all of the ranges before
        draws = zip(_draws(_range_rng(key, seed, part, 0), dealt_a[:, place], a), _draws(_range_rng(key, seed, part, 1), dealt_b[:, place], b))
        for (lo, hi, some_a), (_, _, some_b) in draws:
            u[lo:hi] += (some_a * (np.cumsum(some_b, axis=1) - some_b / 2)).sum(1)
        return _told(table, keys, resamples, resample=np.arange(resamples, dtype=np.int32), u=u, n=np.full(resamples, float(a_sums.sum()) * float(b_sums.sum())))

    enough = rows.filter(F.least("a_total", "b_total") >= max(1, least)).select(*keys, "part", *_ranges("a", "b"), "x", "a", "b", "a_total", "b_total")
    drawn = enough.groupBy(*keys, "part").applyInArrow(one, ", ".join(f"`{k}` string" for k in keys) + ", resample int, u double, n double")
    return drawn.groupBy(*keys, "resample").agg((1 - 2 * F.sum("u") / F.max("n")).alias("r_rb"))


def median_resamples(rows: DataFrame, keys: list[str], resamples: int, seed: int, least: int) -> DataFrame:
    """(keys, resample, median) of cumulated counts n. Only the ranges that a resample's median falls into draw it."""

    def one(table: pa.Table) -> pa.Table:
        key, part, place, x, (n,), (sums,) = _sorted(table, keys, ["n"])
        dealt = dealt_draws(key, seed, sums, resamples)
        total, before = int(sums.sum()), dealt[:, :place].sum(1)
        middle = ((total - 1) // 2, total // 2)
        inside = np.stack([(before <= k) & (k < before + dealt[:, place]) for k in middle])
        asked, found = np.flatnonzero(inside.any(0)), []
        for lo, hi, drawn in _draws(_range_rng(key, seed, part, 0), dealt[asked, place], n):
            for r, upto in zip(asked[lo:hi].tolist(), np.cumsum(drawn, axis=1)):
                found += [(r, x[np.searchsorted(upto, k - before[r], "right")]) for i, k in enumerate(middle) if inside[i, r]]
        return _told(table, keys, len(found), resample=np.array([r for r, _ in found], np.int32), x=np.array([v for _, v in found], float))

    enough = rows.filter(F.col("n_total") >= max(1, least)).select(*keys, "part", *_ranges("n"), "x", "n")
    drawn = enough.groupBy(*keys, "part").applyInArrow(one, ", ".join(f"`{k}` string" for k in keys) + ", resample int, x double")
    return drawn.groupBy(*keys, "resample").agg(F.avg("x").alias("median"))  # the two middle values


def interval(resampled: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, low, high): the 2.5 and 97.5 % quantiles of a value over resamples."""
    ends = F.percentile(value, [0.025, 0.975])
    return resampled.groupBy(*keys).agg(ends.alias("ends")).select(*keys, F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high"))
