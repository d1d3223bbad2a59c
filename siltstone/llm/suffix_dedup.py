"""Suffix-array dedup: remove bytes of SPAN-byte strings that also start in a document with a smaller id.

Of the suffixes, those that start at anchors stand for the rest: every SPAN-byte window picks the K-gram in it with the
least hash, so equal windows pick the same one at the same place. An anchor carries the text around it that its windows
cover. Splitters sampled from the anchors' leading bytes range-partition them into buckets, so equal suffixes meet and
none lies across a boundary (a splitter that repeats is a hot prefix, spread by the bytes after it). A bucket drops
equal anchors first, then expands what shares a K-gram into its suffixes, sorts them by multikey quicksort with
8-byte characters, and gives each run of equal suffixes the smallest id in it.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import BitFilter, drop_caches, each_row, staged, tasks_for, trim_memory

SPAN, K = 50, 16
REACH = SPAN - K  #: bytes of an anchor's windows before it
WIDTH = REACH + SPAN  #: bytes of text that an anchor's windows can cover
ROW = 88  #: WIDTH, first and last window, zeros up to whole 8-byte words
GROUP = 4 << 20  #: bytes of text whose anchors a sender compares and packs together
PART = 1 << 18  #: bytes of text that are hashed at once; longer documents are cut into overlapping parts
LEAVES = 1 << 20  #: packed bytes with which a batch leaves a sender, as the worker and the JVM hold a batch several times
MOST_SPLITTERS = 1 << 17  #: beyond, ranges are cut by a hash of the bytes after the leading ones
SUB = 4  #: buckets that travel and arrive together, packed, and are unpacked one at a time
NO_ID = (1 << 63) - 1  #: a null id: larger than every other
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], dtype=np.uint64)
_S = np.uint64(29)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _MULT[4]
    return x ^ (x >> np.uint64(32))


def _row_hash(rows: np.ndarray) -> np.ndarray:
    words = rows.view(np.uint64)
    h = np.zeros(len(rows), np.uint64)
    for j in range(words.shape[1]):
        h = _mix(h + words[:, j] * _MULT[j])
    return h


def anchors(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the documents buf[lo:hi]: (document, anchor, first window, last window) for each anchor, as places in buf."""
    n = len(buf)
    if n < SPAN:
        return (np.zeros(0, np.int64),) * 4
    word = np.ndarray((n - 7,), "<u8", buf.tobytes(), strides=(1,)).astype(np.uint64)
    h = _mix(word[: n - K + 1] * _MULT[0] + _mix(word[K - 8 :] * _MULT[1]))
    key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)  # the place breaks ties to the left
    least, width = key, 1
    while 2 * width <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = REACH + 1 - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    doc = np.full(len(at), -1, np.int64)
    for d in np.flatnonzero(hi - lo >= SPAN):
        doc[lo[d] : hi[d] - SPAN + 1] = d
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    ok = doc[first] >= 0
    return doc[first][ok], at[first][ok], first[ok], last[ok]


def contexts(buf: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A row for each anchor: the text that its windows cover (zeros elsewhere), and its first and last window."""
    padded = np.concatenate([np.zeros(REACH, np.uint8), buf, np.zeros(WIDTH, np.uint8)])
    rows = np.zeros((len(at), ROW), np.uint8)
    rows[:, :WIDTH] = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[at]
    a, b = first - at + REACH, last - at + REACH
    col = np.arange(WIDTH, dtype=np.int16)
    rows[:, :WIDTH] *= (col >= a.astype(np.int16)[:, None]) & (col < (b + SPAN).astype(np.int16)[:, None])
    rows[:, WIDTH], rows[:, WIDTH + 1] = a, b
    return rows


def equal_rows(rows: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by content then document, and for each place of that order the place of the first equal row."""
    h = _row_hash(rows)
    order = np.lexsort((doc, h))
    hs = h[order]
    start = np.flatnonzero(np.append(True, hs[1:] != hs[:-1]))
    head = np.repeat(start, np.diff(np.append(start, len(hs))))
    same = np.ones(len(order), bool)
    words = rows.view(np.uint64)
    for at in range(0, len(order), 1 << 15):
        k = slice(at, at + (1 << 15))
        same[k] = (words[order[k]] == words[order[head[k]]]).all(1)
    return order, np.where(same, head, np.arange(len(order)))  # of two contents with one hash, the second stands alone


def multikey_runs(words: np.ndarray) -> np.ndarray:
    """A number for each row of words (8-byte characters), equal for equal rows and distinct otherwise for rows that tie.

    Multikey quicksort: sort by a character, and go on to the next one only within the runs that tie.
    """
    n = len(words)
    group, live = np.zeros(n, np.int64), np.arange(n)
    for level in range(words.shape[1]):
        order = live[np.lexsort((words[live, level], group[live]))]
        g, w = group[order], words[order, level]
        new = np.append(True, (g[1:] != g[:-1]) | (w[1:] != w[:-1]))
        ids = np.cumsum(new) - 1 + (level + 1) * n
        group[order] = ids
        size = np.bincount(ids - ids[0])
        live = order[size[ids - ids[0]] > 1]
        if not len(live):
            break
    return group


def partial_matches(rows: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, window) of windows that equal one of another row with a smaller document."""
    gram = np.ascontiguousarray(rows[:, REACH : REACH + K]).view(">u8").astype(np.uint64)
    order = np.lexsort((gram[:, 1], gram[:, 0]))
    g = gram[order]
    start = np.flatnonzero(np.append(True, (g[1:] != g[:-1]).any(1))) if len(order) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(order)))
    low = np.minimum.reduceat(doc[order], start) if len(start) else doc[:0]
    high = np.maximum.reduceat(doc[order], start) if len(start) else doc[:0]
    shared = np.repeat((size > 1) & (low < high), size)
    todo = order[shared]
    run = np.repeat(np.arange(len(start)), size)[shared]
    out_row, out_window = [], []
    n_windows = rows[todo, WIDTH + 1].astype(np.int64) - rows[todo, WIDTH] + 1
    upto = np.cumsum(n_windows)
    at = 0
    while at < len(todo):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 150_000)))
        if end < len(todo):  # whole runs of a K-gram only
            end = int(np.searchsorted(run, run[min(end, len(run) - 1)], side="left")) if run[end - 1] == run[end] and run[end] != run[at] else int(np.searchsorted(run, run[end - 1], side="right"))
        part = todo[at:end]
        n = n_windows[at:end]
        which = np.repeat(np.arange(len(part)), n)
        window = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + rows[part, WIDTH].astype(np.int64)[which]
        for k0 in _chunks(which, window, run[at:end]):
            w, o = which[k0], window[k0]
            text = np.zeros((len(w), 56), np.uint8)
            flat = np.ascontiguousarray(rows[part]).reshape(-1)
            text[:, :SPAN] = np.lib.stride_tricks.sliding_window_view(flat, SPAN)[w * ROW + o]
            text[:, SPAN] = o
            group = multikey_runs(text.view(">u8").astype(np.uint64))
            by = np.lexsort((doc[part[w]], group))
            gs = group[by]
            first = np.append(True, gs[1:] != gs[:-1])
            least = np.repeat(doc[part[w[by]]][first], np.diff(np.append(np.flatnonzero(first), len(gs))))
            hit = by[doc[part[w[by]]] > least]
            out_row.append(part[w[hit]])
            out_window.append(o[hit])
        at = end
    none = np.zeros(0, np.int64)
    return np.concatenate(out_row or [none]), np.concatenate(out_window or [none])


def _chunks(which: np.ndarray, window: np.ndarray, run: np.ndarray, most: int = 300_000):
    """All windows at once, or, for a K-gram with very many contexts, by their place: equal windows have the same one."""
    if len(which) <= most:
        yield np.arange(len(which))
        return
    for o in range(REACH + 1):
        k = np.flatnonzero(window == o)
        if len(k):
            yield k


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, s[1:] > e[:-1])
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:], len(s)) - 1]


def _ranges(which: np.ndarray, start: np.ndarray, end: np.ndarray):
    """For each value of which: (value, packed merged ranges)."""
    order = np.lexsort((start, which))
    which, start, end = which[order], start[order], end[order]
    cut = np.flatnonzero(np.append(True, which[1:] != which[:-1])) if len(which) else []
    for a, b in zip(cut, [*cut[1:], len(which)]):
        s, e = merged(start[a:b], end[a:b])
        yield int(which[a]), np.stack([s, e], 1).astype("<i8").tobytes()


def bucket_of(rows: np.ndarray, splitters: np.ndarray, parts: int = 1) -> np.ndarray:
    """The bucket of each anchor: the range of its leading bytes, cut into parts by the bytes after them. A splitter that
    repeats is spread over its ranges in the same way, so equal anchors share a bucket."""
    gram = np.ascontiguousarray(rows[:, REACH : REACH + K]).view(">u8").astype(np.uint64)
    low, high = np.searchsorted(splitters, gram[:, 0], "left"), np.searchsorted(splitters, gram[:, 0], "right")
    width = ((high - low + 1) * parts).astype(np.uint64)
    return low * parts + (_mix(gram[:, 1]) % width).astype(np.int64)


def _pack(rows: np.ndarray, doc: np.ndarray, tag: np.ndarray, first: np.ndarray) -> bytes:
    """Rows and their places, which come in runs of one document: lengths, rows, run starts, places (32 bits: a text is below 2 GB), then ids and tags."""
    new = np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))
    at = np.flatnonzero(new)
    head = np.array([len(rows), len(at)], "<u4")
    return b"".join(x.tobytes() for x in (head, rows, at.astype("<u4"), first.astype("<u4"), doc[at].astype("<i8"), tag[at].astype("<i8")))


def _unpack(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = np.frombuffer(body, "<u4", 2).tolist()
    at = 8 + n * ROW
    rows = np.frombuffer(body, np.uint8, n * ROW, 8).reshape(n, ROW)
    starts = np.frombuffer(body, "<u4", m, at).astype(np.int64)
    first = np.frombuffer(body, "<u4", n, at + 4 * m).astype(np.int64)
    ids = np.frombuffer(body, "<i8", m, at + 4 * m + 4 * n)
    tags = np.frombuffer(body, "<i8", m, at + 12 * m + 4 * n)
    run = np.repeat(np.arange(m), np.diff(np.append(starts, n)))
    return rows, np.stack([ids[run], tags[run], first], 1)


def _sent(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["bucket", "body", "doc_id", "tag", "ranges"])


def _segments(doc: int, tag: int, text: bytes):
    """A document in parts that share SPAN - 1 bytes, so that each window lies in one whole part."""
    for at in range(0, max(1, len(text) - SPAN + 1), PART):
        yield doc, tag, at, text[at : at + PART + SPAN - 1]


def sample_splitters(docs: DataFrame, buckets: int, limit: int = 2000) -> np.ndarray:
    """Quantiles of the leading 8 bytes of anchors in about 2 * limit documents, chosen by a hash of the id; for balance only."""
    def run(batches):
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                data = np.frombuffer((text or "").encode("utf-8", "surrogatepass")[:GROUP], np.uint8)
                _, at, *_ = anchors(data, np.array([0]), np.array([len(data)]))
                lead = np.ndarray((max(0, len(data) - 7),), ">u8", data.tobytes(), strides=(1,)) if len(data) > 7 else np.zeros(0, ">u8")
                out.append(lead[at[:200]].astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["lead"])

    chosen = docs.select("text", F.xxhash64("doc_id").alias("h"), "doc_id")
    share = docs.agg(F.count("*")).first()[0]
    if share > 2 * limit:  # a filter by hash before the limit: nothing is sorted
        chosen = chosen.filter(F.pmod("h", F.lit(share)) < 2 * limit)
    got = [r[0] for r in chosen.select("text").limit(2 * limit).mapInArrow(run, "lead binary").collect()]
    lead = np.sort(np.frombuffer(b"".join(got), "<u8"))
    if not len(lead) or buckets < 2:
        return np.zeros(0, np.uint64)
    return lead[(np.arange(1, buckets) * len(lead)) // buckets].astype(np.uint64)


def removed_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, tag (hash of the text), ranges (packed 64-bit starts and ends): rows of what is removed, several for a document."""
    spark = docs.sparkSession
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = tasks_for(spark, total, 2 * GROUP)
    parts = -(-n * SUB // MOST_SPLITTERS)  # so that what is broadcast has a bound
    n = -(-n // parts) * parts
    splitters = spark.sparkContext.broadcast(sample_splitters(docs, n * SUB // parts))

    def send(batches):
        drop_caches()
        group, size = [], 0
        for b in batches:
            for doc, tag, text in each_row(b):
                for part in _segments(NO_ID if doc is None else doc, tag, (text or "").encode("utf-8", "surrogatepass")):
                    group.append(part)
                    size += len(part[3])
                    if size >= GROUP:
                        yield from flush(group)
                        group, size = [], 0
                        trim_memory()
        if group:
            yield from flush(group)
        trim_memory()

    def flush(group):
        group.sort(key=lambda p: p[:3])
        ids = np.array([p[0] for p in group], np.int64)
        got, at = [], 0
        while at < len(group):
            end, size = at + 1, len(group[at][3])
            while end < len(group) and size + len(group[end][3]) <= PART:
                size += len(group[end][3])
                end += 1
            ends = np.cumsum([len(p[3]) for p in group[at:end]])
            begins = np.append(0, ends[:-1])
            buf = np.frombuffer(b"".join(p[3] for p in group[at:end]), np.uint8)
            which, spot, first, last = anchors(buf, begins, ends)
            got.append((at, np.array([p[2] for p in group[at:end]], np.int64) - begins, buf, which, spot, first, last))
            at = end
        rows = np.empty((sum(len(x[3]) for x in got), ROW), np.uint8)  # filled in place: rows are most of the memory
        at = 0
        for _, _, buf, _, spot, first, last in got:
            rows[at : at + len(spot)] = contexts(buf, spot, first, last)
            at += len(spot)
        which, first, last = (np.concatenate(x) for x in zip(*((which + at, first + shift[which], last + shift[which]) for at, shift, _, which, _, first, last in got)))
        got.clear()
        order, head = equal_rows(rows, ids[which])
        doc = ids[which[order]]
        known = doc > doc[head]  # an equal row of a smaller document is sent
        k = order[known]
        local = {}
        for p, blob in _ranges(which[k], first[k], last[k] + SPAN):
            local.setdefault(group[p][:2], []).append(blob)
        k = order[~known]
        bucket = (bucket_of(rows, splitters.value, parts) // SUB)[k]
        by = np.lexsort((first[k], which[k], bucket))
        k, bucket = k[by], bucket[by]
        out, held = [(-1, None, d, t, b"".join(x)) for (d, t), x in local.items()], 0
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(k) else []
        tags = np.array([p[1] for p in group], np.int64)
        for a, b in zip(cut, [*cut[1:], len(k)]):
            p = k[a:b]
            body = _pack(rows[p], ids[which[p]], tags[which[p]], first[p])
            out.append((int(bucket[a]), pa.Codec("zstd", compression_level=3).compress(body, asbytes=True), None, len(body), None))
            held += len(out[-1][1])
            if held >= LEAVES:
                yield _sent(out)
                out, held = [], 0
        if out:
            yield _sent(out)

    def meet(batches):
        drop_caches()
        held, at = [], None
        for b in batches:
            buckets, bodies = b.column(0).to_pylist(), b.column(1)
            own = [i for i, k in enumerate(buckets) if k < 0]
            if own:
                yield b.take(pa.array(own)).select(["doc_id", "tag", "ranges"])
            for i, (bucket, tag) in enumerate(zip(buckets, b.column(3).to_pylist())):
                if bucket < 0:
                    continue
                if bucket != at and held:
                    yield from compare(held)
                    held = []  # one bucket at a time, and packed
                at = bucket
                held.append((bodies[i].as_buffer(), tag))  # in the batch's memory, not copied
        if held:
            yield from compare(held)
        held = b = bodies = None  # a reused worker keeps nothing for the next stage
        trim_memory()

    def compare(bodies):
        for sub in range(SUB):
            part = []
            for body, size in bodies:
                rows, refs = _unpack(pa.Codec("zstd").decompress(body, decompressed_size=size, asbytes=True))
                mine = bucket_of(rows, splitters.value, parts) % SUB == sub
                part.append((rows[mine], refs[mine]))
            rows, refs = (np.concatenate(x) for x in zip(*part))
            part.clear()
            if len(rows):
                yield from settle(rows, refs)
            del rows, refs
            trim_memory()

    def settle(rows, refs):
        doc = refs[:, 0]
        order, head = equal_rows(rows, doc)
        known = doc[order] > doc[order[head]]
        full = order[known]
        lead = order[np.unique(head[~known])] if len(order) else order
        row, window = partial_matches(rows[lead], doc[lead])
        # A row of the leader's own document that equals it shares its partial matches.
        own = order[~known]
        leader = order[head[~known]]
        twin = own[own != leader]
        back = np.full(len(rows), -1, np.int64)
        back[lead] = np.arange(len(lead))
        extra_r, extra_w = [], []
        if len(twin) and len(row):
            by = np.argsort(row, kind="stable")
            rs = row[by]
            lo, hi = np.searchsorted(rs, back[leader[own != leader]], "left"), np.searchsorted(rs, back[leader[own != leader]], "right")
            for t, a, b in zip(twin[hi > lo], lo[hi > lo], hi[hi > lo]):
                extra_r.append(np.full(b - a, t))
                extra_w.append(window[by[a:b]])
        who = np.concatenate([lead[row], *extra_r]).astype(np.int64)
        win = np.concatenate([window, *extra_w]).astype(np.int64)
        first = refs[:, 2]
        begin = np.concatenate([first[full], first[who] + win - rows[who, WIDTH]])
        end = np.concatenate([first[full] + (rows[full, WIDTH + 1].astype(np.int64) - rows[full, WIDTH]) + SPAN, begin[len(full) :] + SPAN])
        hit = np.concatenate([full, who])
        if not len(hit):
            return
        key, inverse = np.unique(refs[hit, :2], axis=0, return_inverse=True)
        got = [{"doc_id": int(key[i, 0]), "tag": int(key[i, 1]), "ranges": blob} for i, blob in _ranges(inverse.reshape(-1), begin, end)]
        for k in range(0, len(got), 5000):
            yield pa.RecordBatch.from_pylist(got[k : k + 5000], schema=OUT)

    OUT = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("ranges", pa.binary())])
    tagged = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
    sent = tagged.mapInArrow(send, "bucket int, body binary, doc_id bigint, tag bigint, ranges binary")
    spread = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("doc_id", "tag"), F.lit(n))).otherwise(F.col("bucket"))
    return sent.repartition(n, spread).sortWithinPartitions("bucket").mapInArrow(meet, "doc_id bigint, tag bigint, ranges binary")


def _kept(text: str | None, blobs: list[bytes] | None) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    data = (text or "").encode("utf-8", "surrogatepass")
    pairs = np.frombuffer(b"".join(blobs or []), "<i8").reshape(-1, 2)
    s, e = merged(pairs[:, 0], pairs[:, 1])
    out, at = [], 0
    for a, b in zip(s.tolist(), e.tolist()):
        out.append(data[at:a])
        at = b
    return data, b"".join([*out, data[at:]]), s, e


def _split(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents that may lose bytes, with their ranges or none; the rest). Only the texts of the first are shuffled."""
    found = removed_ranges(docs).groupBy("doc_id", "tag").agg(F.collect_list("ranges").alias("__ranges"))
    found = staged(found, "removed-ranges").select(F.col("doc_id").alias("__doc"), F.col("tag").alias("__tag"), "__ranges")
    keyed = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))).withColumn("__th", F.xxhash64("text"))
    flagged = BitFilter(found.select(F.xxhash64("__doc", "__tag")), "affected").mark(keyed, F.xxhash64("__key", "__th"), "__may")
    some = flagged.filter("__may").join(found, (F.col("__key") == F.col("__doc")) & (F.col("__th") == F.col("__tag")), "left")
    return some, flagged.filter("NOT __may")


def suffix_dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text, spans).

    Strings are judged on the input. A null or empty text has no bytes; a null id counts as larger than any other, and
    rows with one id (or none) never remove each other's text, though equal ones lose the same bytes. An empty table
    gives no rows; other columns are ignored. kept_text decodes the bytes that remain, cut characters replaced. A
    passage that many documents share is sent once by each sender, as the smallest document's; the others are settled
    before the shuffle. Very long texts are worked on in overlapping parts.
    """

    def run(batches):
        for b in batches:
            out = []
            for doc, text, blobs in each_row(b):
                data, kept, s, e = _kept(text, blobs)
                out.append((doc, len(data), len(data) - len(kept), len(s), sha256(kept).hexdigest(), *((kept.decode("utf-8", "replace"), np.stack([s, e], 1).tolist()) if with_text else ())))
            cols = list(zip(*out)) or [()] * (5 + 2 * with_text)
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.string(), pa.list_(pa.list_(pa.int64()))] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text", "spans"] * with_text])

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text string, spans array<array<bigint>>" * with_text
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    some, rest = _split(base)
    return some.select("doc_id", "text", "__ranges").unionByName(rest.select("doc_id", "text", F.lit(None).cast("array<binary>").alias("__ranges"))).mapInArrow(run, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the removed bytes gone from text (n_chars follows, where there is one); a text that loses nothing is left as it is.

    Judged as by suffix_dedup, null and repeated ids as there: a null text stays null, an empty one empty, an empty table
    empty. A character that a removed run cuts goes with it. Very long texts are worked on in overlapping parts.
    """

    @F.pandas_udf("string")
    def cut(text, ranges):
        import pandas as pd

        return pd.Series([t if r is None or not len(r) else _kept(t, list(r))[1].decode("utf-8", "ignore") for t, r in zip(text, ranges)], dtype=object)

    some, rest = _split(docs)
    lost = some.withColumn("text", F.when(F.col("__ranges").isNull(), F.col("text")).otherwise(cut("text", "__ranges")))
    if "n_chars" in docs.columns:
        lost = lost.withColumn("n_chars", F.when(F.col("__ranges").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return lost.select(*docs.columns).unionByName(rest.select(*docs.columns))
