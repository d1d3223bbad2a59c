"""Spelling variant grouping by rolling-hash deletions.

Two words differ by one inserted or deleted code point if a deletion of one is the other, and by one replaced code point if
deletions at the same place are equal. Prefix and suffix polynomial hashes give the keys of all deletions of a batch of
words as NumPy integers; keys are radix-partitioned and sorted, and runs of equal keys are verified on the strings.

A run says how many near words it gives to each of its members and which of them is the most frequent, so what leaves it is
linear in what enters it: pairs are never listed. A deletion at one place is shared by at most as many words as there are
letters (90), so no key is hot, whatever the texts.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import small_batches, staged, tasks_for

RUN = r"[A-Za-zÀ-ÿ]{6,}"  #: maximal runs; shorter ones give no word
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS, LEAST_COUNT, RATIO, TYPO_EVERY = 6, 5, 5, 199
BASE = 0x9E3779B97F4A7C15  #: odd, so that it has an inverse modulo 2**64
BASE_INVERSE = pow(BASE, -1, 1 << 64)
WHOLE = -1  #: the place of a row that holds the word itself
KEYED = "key bigint, place int, once boolean, word string, n bigint"
NEAR = "word string, n_near bigint, best_n bigint, best string"


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the distinct results and how often they occur; counted before the shuffle, so frequent words are no hot keys."""
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    typo = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    found = rows.select(F.when(h % TYPO_EVERY == 0, typo).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= LEAST_CHARS)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a polynomial hash over all 64 bits, as its low bits depend on few places."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def deletion_keys(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of words of one length (a row of code points each): of the word itself, and of its deletion at each place.

    The polynomial of a word without place i is the prefix before i plus the suffix after i, one power lower.
    """
    with np.errstate(over="ignore"):
        n, size = chars.shape
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, BASE, np.uint64)]), dtype=np.uint64)
        upto = np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * powers, axis=1, dtype=np.uint64)
        prefix = np.hstack([np.zeros((n, 1), np.uint64), upto[:, :-1]])
        deleted = prefix + (upto[:, -1:] - upto) * np.uint64(BASE_INVERSE)
        return mixed(upto[:, -1]), mixed(deleted)


def keyed(batch: pa.RecordBatch, mask: int = -1) -> pa.RecordBatch:
    """Rows of KEYED for a batch (word, n): one for each word and one for each place in it; once marks the first of the
    places where a deletion gives the same string."""
    by_size: dict[int, list[tuple[str, int]]] = {}
    for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        by_size.setdefault(len(word), []).append((word, n))
    parts = []
    for size, group in by_size.items():
        chars = np.frombuffer("".join(w for w, _ in group).encode("latin-1"), np.uint8).reshape(len(group), size)
        whole, deleted = deletion_keys(chars)
        keys = np.hstack([whole[:, None], deleted]).view(np.int64) & np.int64(mask)
        once = np.ones((len(group), size + 1), bool)
        once[:, 2:] = chars[:, 1:] != chars[:, :-1]
        names = pa.array([w for w, _ in group], pa.string()).take(pa.array(np.repeat(np.arange(len(group)), size + 1)))
        counts = np.repeat(np.array([n for _, n in group], np.int64), size + 1)
        places = np.tile(np.arange(WHOLE, size, dtype=np.int32), len(group))
        parts.append(pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(places), pa.array(once.ravel()), names, pa.array(counts)], ["key", "place", "once", "word", "n"]))
    empty = pa.RecordBatch.from_pylist([], pa.schema([("key", pa.int64()), ("place", pa.int32()), ("once", pa.bool_()), ("word", pa.string()), ("n", pa.int64())]))
    return pa.Table.from_batches(parts or [empty]).combine_chunks().to_batches()[0] if parts else empty


def best_of(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The two most frequent of (word, n), ties by code points."""
    return sorted(rows, key=lambda r: (-r[1], r[0]))[:2]


def near_in(run: list[tuple]) -> list[tuple[str, int, int, str]]:
    """NEAR rows of one run of equal keys (place, once, word, n): first split by the strings that the keys stand for."""
    by_string: dict[str, list[tuple]] = {}
    for place, once, word, n in run:
        by_string.setdefault(word if place == WHOLE else word[:place] + word[place + 1 :], []).append((place, once, word, n))
    out = []
    for rows in by_string.values():
        if len(rows) < 2:
            continue
        rows.sort(key=lambda r: (r[0], r[2]))
        own = [(w, n) for place, _, w, n in rows if place == WHOLE]
        longer = [(w, n) for place, once, w, n in rows if place != WHOLE and once]
        for word, _ in own:
            if longer:
                top = best_of(longer)[0]
                out.append((word, len(longer), top[1], top[0]))
        for word, _ in longer:
            if own:
                out.append((word, 1, own[0][1], own[0][0]))
        for _, same in groupby((r for r in rows if r[0] != WHOLE), key=lambda r: r[0]):
            members = [(w, n) for _, _, w, n in same]
            if len(members) > 1:
                top = best_of(members)
                for word, _ in members:
                    other = top[1] if top[0][0] == word else top[0]
                    out.append((word, len(members) - 1, other[1], other[0]))
    return out


def _near_of_sorted(batches):
    """NEAR rows of rows sorted by key; a run that a batch cuts is kept until its end has come."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    rest: list[tuple] = []
    rest_key = None

    def told(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema.names) if rows else pa.RecordBatch.from_pylist([], schema)

    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        out = []
        several = [(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if b - a > 1 or a == 0 or b == len(keys)]
        columns = [batch.column(i) for i in range(1, 5)]
        for a, b in several:
            rows = list(zip(*(c.slice(a, b - a).to_pylist() for c in columns)))
            if a == 0 and rest and keys[0] != rest_key:
                out += near_in(rest)
                rest = []
            if b == len(keys):
                rest, rest_key = (rest if a == 0 else []) + rows, keys[-1]
            else:
                out += near_in(rest + rows if a == 0 else rows)
                rest = [] if a == 0 else rest
        yield told(out)
    yield told(near_in(rest))


def near(vocabulary: DataFrame, mask: int = -1) -> DataFrame:
    """NEAR for each word that has near words: their number, and the most frequent of them (ties by code points).

    mask keeps fewer bits of the keys, for tests of collisions.
    """
    spark = vocabulary.sparkSession
    small_batches(spark)
    rows = vocabulary.select("word", "n").mapInArrow(lambda batches: (keyed(b, mask) for b in batches), KEYED)
    n_bytes = vocabulary.agg(F.sum((F.length("word") + 1) * 40)).first()[0] or 0
    parts = tasks_for(spark, n_bytes, 64 << 20)
    found = rows.repartition(parts, "key").sortWithinPartitions("key", "place", "word").mapInArrow(_near_of_sorted, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form): where following forms ends. Each round doubles the way that a link covers, and
    counts grow fivefold at each form, so a few rounds do."""
    at = staged(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        further = staged(at.join(on, F.col("root") == F.col("__w"), "left").select("word", F.coalesce("__r", "root").alias("root"), F.col("__r").isNotNull().alias("moved")), "spelling-roots")
        at = further.select("word", "root")
        if not further.filter("moved").limit(1).count():
            return at


def spelling_variants(docs: DataFrame, mask: int = -1) -> DataFrame:
    """One row for each word: word, n, n_near, form, form_n, root.

    Words are the results of runs of at least 6 code points, found at least 5 times over all documents. The form of a word
    is its near word of largest n, ties by code points, if that n is at least 5 times the word's; root is where forms end.
    A null text has no words; a null doc_id stands as nothing before the colon; rows that are equal count each, and all
    of a text is read, whatever its length (a run that fills it included). Other columns do not matter. Without words there
    are no rows.
    """
    vocabulary = staged(words(docs), "spelling-words")
    found = near(vocabulary, mask)
    rows = vocabulary.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(F.col("best_n") >= RATIO * F.col("n"), F.col("best")).alias("form"), F.when(F.col("best_n") >= RATIO * F.col("n"), F.col("best_n")).alias("form_n"))
    rows = staged(rows, "spelling-forms")
    ends = roots(rows.filter("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
