"""Packing by cutting-stock column generation.

Documents longer than a sequence are cut into whole sequences and a rest. The rests are counted in length classes (exact
when short, in steps of 16 beyond), so the driver sees one bounded histogram whatever the corpus. A linear
program over patterns (multisets of classes that fit a sequence) is solved by column generation: the master's duals price
new patterns, a knapsack dynamic program finds the best one, and the loop ends when none improves the bound by more than
the tolerance. Pattern counts are rounded down, what is left is packed first-fit decreasing, and the pieces of a class,
ranked across the cluster, are dealt to the slots of the patterns in order.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import each_row, staged, trim_memory, with_rank
from siltstone.llm.tokens import encoder, file_of

SEQUENCE = 2048
END = 1


SHORT, STEP = 64, 16


def class_sizes(capacity: int = SEQUENCE) -> np.ndarray:
    """Ascending lengths that the classes take up: exact below SHORT, multiples of STEP from there on, and capacity."""
    return np.unique([*range(1, min(SHORT, capacity)), *range(SHORT, capacity, STEP), capacity])


def price(sizes: np.ndarray, values: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Unbounded knapsack: the pattern of greatest total value that fits, then for each class the best one that holds it."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int64)
    use = np.flatnonzero(values > 1e-12)
    if not len(use):
        return []
    s, v = sizes[use], values[use]
    fits = np.searchsorted(s, np.arange(capacity + 1), side="right").tolist()
    for c in range(int(s[0]), capacity + 1):
        got = best[c - s[: fits[c]]] + v[: fits[c]]
        k = got.argmax()
        if got[k] > best[c - 1] + 1e-15:
            best[c], took[c] = got[k], k
        else:
            best[c] = best[c - 1]

    def pattern(counts: np.ndarray, room: int) -> np.ndarray:
        while room > 0:
            k = took[room]
            if k < 0:
                room -= 1
            else:
                counts[use[k]] += 1
                room -= int(s[k])
        return counts

    by = np.argsort(-(v + best[capacity - s]), kind="stable")
    return [pattern(np.zeros(len(sizes)), capacity), *(pattern(np.eye(1, len(sizes), use[k])[0], capacity - int(s[k])) for k in by)]


def inverse_of(basis: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots; element-wise only, as threaded linear algebra can stall beside a JVM."""
    m = len(basis)
    a = np.hstack([basis, np.eye(m)])
    for k in range(m):
        p = k + int(np.abs(a[k:, k]).argmax())
        if p != k:
            a[[k, p]] = a[[p, k]]
        a[k] /= a[k, k]
        factor = a[:, k].copy()
        factor[k] = 0
        a -= factor[:, None] * a[k]
    return a[:, m:]


def times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(1)


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, tolerance: float = 1e-3, rounds: int = 3000) -> tuple[list[np.ndarray], np.ndarray]:
    """Patterns and how often to use each, so that every class is used exactly demand times.

    Short classes, exact, and long ones, in steps, are solved apart: each by a program of one unit.
    """
    out, uses = [], []
    for part in (sizes < SHORT, sizes >= SHORT):
        if part.any():
            unit = int(np.gcd.reduce([*sizes[part], capacity]))
            for p, n in zip(*_solve(sizes[part] // unit, demand[part], capacity // unit, tolerance, rounds)):
                whole = np.zeros(len(sizes), dtype=np.int64)
                whole[part] = p
                out.append(whole)
                uses.append(int(n))
    return out, np.array(uses, dtype=np.int64)


def _solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, tolerance: float, rounds: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Revised simplex on: minimise the number of sequences, patterns times counts = demand.

    It starts from the patterns of one class each; each knapsack table prices a pattern for every class, which enter
    while their reduced costs last. It stops when Farley's bound is within tolerance of the objective, or after rounds
    tables with what it has, which still is a whole packing. Demands are perturbed by up to 2 % while it runs, against
    degenerate pivots, and exact when it rounds.
    """
    live = np.flatnonzero(demand > 0)
    if not len(live):
        return [], np.zeros(0, dtype=np.int64)
    s, m = sizes[live], len(live)
    d = demand[live] * (1 + 0.02 * np.random.default_rng(17).random(m))
    basis = np.diag((capacity // s).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    x = times(inverse, d)
    bound = 0.0
    for step in range(1, rounds + 1):
        duals = np.maximum(inverse.sum(0), 0)
        found = price(s, duals, capacity)
        if not found:
            break
        value = float((duals * found[0]).sum())
        bound = max(bound, float((duals * d).sum()) / value)
        if value <= 1 + 1e-9 or x.sum() <= bound * (1 + tolerance):
            break
        for pattern in found:
            if float((inverse.sum(0) * pattern).sum()) <= 1 + 1e-6:
                continue
            direction = times(inverse, pattern)
            ok = np.flatnonzero(direction > 1e-9)
            if not len(ok):
                continue
            ratio = x[ok] / direction[ok]
            out, theta = ok[int(ratio.argmin())], float(ratio.min())
            x = x - theta * direction
            x[out] = theta
            basis[:, out] = pattern
            row = inverse[out] / direction[out]
            inverse = inverse - np.outer(direction, row)
            inverse[out] = row
        if step % 50 == 0:
            inverse = inverse_of(basis)
            x = np.maximum(times(inverse, d), 0)
    inverse = inverse_of(basis)
    full = np.rint(basis).astype(np.int64)
    x = np.maximum(times(inverse, demand[live]), 0)
    counts = np.floor(x + 1e-9).astype(np.int64)
    left = demand[live] - full @ counts
    for k in np.flatnonzero(counts):  # where the floor's tolerance took too much
        while counts[k] and (left[full[:, k] > 0] < 0).any():
            counts[k] -= 1
            left = left + full[:, k]
    patterns, uses = [], []
    for k in np.flatnonzero(counts):
        p = np.zeros(len(sizes), dtype=np.int64)
        p[live] = full[:, k]
        patterns.append(p)
        uses.append(int(counts[k]))
    while left.any():  # first fit decreasing, a pattern at a time: at most a few for each class
        p, room = np.zeros(len(sizes), dtype=np.int64), capacity
        for i in range(m - 1, -1, -1):
            n = min(int(left[i]), room // int(s[i]))
            p[live[i]] = n
            room -= n * int(s[i])
        held = p[live] > 0
        n = int((left[held] // p[live][held]).min())
        left = left - n * p[live]
        patterns.append(p)
        uses.append(n)
    return patterns, np.array(uses, dtype=np.int64)


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = SEQUENCE, end_id: int = END, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document: doc_id, start, length, ids_crc32, doc_tokens (and ids)."""

    def run(batches):
        trim_memory()  # what earlier stages left in a reused worker
        e = encoder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            out = []
            for doc_id, packed in zip(b.column(0).to_pylist(), e.encode_all(text for _, text in each_row(b))):
                ids = packed + end
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    part = ids[4 * at : 4 * (at + capacity)]
                    out.append((doc_id, at, len(part) // 4, crc32(part), n, *([part] if keep_ids else [])))
            cols = list(zip(*out)) or [()] * (5 + keep_ids)
            types = [pa.int64()] * 5 + [pa.binary()] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids])
            del out, cols
            trim_memory()

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def _table(spark: SparkSession, rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> DataFrame:
    """rows as Arrow, which the JVM reads itself; lists of tuples would start a second set of Python workers on every executor."""
    return spark.createDataFrame(pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(columns)}))


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = SEQUENCE, end_id: int = END, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the packed ids).

    A null or empty text is a document of its end id alone. Null or repeated ids and equal rows are packed row by row;
    other columns are ignored; an empty table gives no rows. However many pieces share one length, none meet in a task:
    whole sequences are numbered and rests ranked by range partitions and prefix sums of their counts.
    """
    spark = docs.sparkSession
    pieces = staged(cut_documents(docs, tokenizer or file_of("byte_bpe_50k.json"), capacity, end_id, keep_ids), "pieces")
    sizes = class_sizes(capacity)
    small = _table(spark, [(i, int(a) + 1, int(b)) for i, (a, b) in enumerate(zip([0, *sizes[:-1]], sizes))], [("class", pa.int32()), ("low", pa.int32()), ("high", pa.int32())])
    classes = F.broadcast(small.select("class", F.explode(F.sequence("low", "high")).alias("length")).select("class", F.col("length").cast("bigint").alias("length")))  # one row for each length
    rows = pieces.join(classes, "length")
    ranked = with_rank(rows, ["class"], [F.col("length").desc(), F.col("doc_id").asc_nulls_last(), F.col("start"), F.col("ids_crc32")], "rank", "packing-rank")
    demand = np.zeros(len(sizes), dtype=np.int64)
    for k, n in rows.groupBy("class").count().collect():  # at most one row for each class
        demand[k] = n
    patterns, uses = solve_patterns(sizes, demand, capacity)
    slots, taken, first = [], np.zeros(len(sizes), dtype=np.int64), 0
    for p, n in zip(patterns, uses.tolist()):
        before = 0
        for i in np.flatnonzero(p)[::-1]:
            slots.append((int(i), int(taken[i]), int(taken[i] + n * p[i]), int(p[i]), first, before))
            taken[i] += n * p[i]
            before += int(p[i])
        first += n
    table = _table(spark, slots, [("class", pa.int32()), *((name, pa.int64()) for name in ("low", "high", "per", "first", "before"))])
    # Ranks below the bounds: patterns number a few for each class, so the table's size has a bound.
    dealt = ranked.join(F.broadcast(table), "class").filter((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    into = F.col("rank") - F.col("low")
    dealt = dealt.withColumn("sequence_id", F.col("first") + F.floor(into / F.col("per"))).withColumn("__slot", F.col("before") + into % F.col("per"))
    w = Window.partitionBy("sequence_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("bigint"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids)
