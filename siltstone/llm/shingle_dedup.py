"""Near-duplicates by SimHash and Jaccard similarity of word shingles: what the pipeline's near-dedup stage asks of simhash.py.

Texts reduce to distinct shingle sets. Fingerprints of the shingles, linked by the vantage-point trees, give the first
candidates. They miss pairs, so the rest come from the sets: a set of n shingles that reaches the similarity s with another
shares one of its first n - ceil(s n) + 1 shingles in any global order with the other's first (prefix filter), and the order
puts frequent shingles last, by counts over all documents in hashed buckets. Sets that share such a shingle form a list;
lists of equal members are one. A parity sketch, the bits of an odd number of shingles, differs in no more places than the
sets do, so it rules pairs out for certain before any text is fetched. In each list, stars of pairs that the sketch thinks
alike are verified first, twice, around different members; what is still apart and not ruled out is then verified in full,
a pair that several lists share in the first of them. Long lists are compared in pairs of blocks.
Every candidate is verified on its whole sets, so no pair is lost and none is linked wrongly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import BitFilter, drop_caches, each_row, staged, without
from siltstone.llm.simhash import SEED, components, majority, star_edges

SHINGLE, SIMILARITY = 5, 0.8
COUNTERS = 1 << 18  #: hashed counts of shingles, whatever the corpus
SLICES = 16  #: parts in which the counts travel
LEAST_BITS, BITS_EACH = 1024, 1  #: of a parity sketch, in all and for each shingle, rounded up to a power of two
BLOCK = 16_384  #: members of a list that are compared in one piece
KEPT = 64  #: shingle sets that a verifying task keeps
PART = 1 << 20  #: bytes of text that are hashed at once
BASE = 0x9E3779B97F4A7C15  #: odd, so that it has an inverse
_TO = np.arange(256, dtype=np.uint8)  #: A-Z to a-z, white space to space
_TO[65:91] += 32
_TO[9:14] = 32
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _grown(name: str, n: int) -> np.ndarray:
    """Powers of BASE, or of its inverse, up to n at least."""
    if len(_powers[name]) < n:
        step = np.uint64(BASE if name == "up" else pow(BASE, -1, 1 << 64))
        steps = np.full(max(n, 1 << 16), step, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hash of each word shingle, repeats included; of the whole sequence if it is shorter; none without words.

    A polynomial over the bytes of the words, one space between them, from prefix sums; long texts go in parts.
    """
    low = _TO[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    gap = low == 32
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    w = len(start)
    if not w:
        return np.zeros(0, np.uint64)
    size, out, at = min(w, shingle), [], 0
    while at <= w - size:
        upto = max(at + 1, min(w - size + 1, int(np.searchsorted(start, start[at] + PART))))  # shingles that begin here
        s, e = start[at : upto + size - 1], end[at : upto + size - 1]
        keep = ~gap[s[0] : e[-1]]
        keep[s[1:] - s[0] - 1] = True
        line = low[s[0] : e[-1]][keep]
        ends = np.cumsum(e - s + 1) - 1
        begins = ends - (e - s)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((line.astype(np.uint64) + np.uint64(1)) * _grown("up", len(line)))])
        a, b = begins[: upto - at], ends[size - 1 :]
        out.append(_mixed((sums[b] - sums[a]) * _grown("down", len(line))[a] + (b - a).astype(np.uint64)))
        at = upto
    return np.concatenate(out)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes, sorted."""
    return np.unique(shingle_hashes(text, shingle))


def key_of(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), SEED)


def sketch_of(s: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of some buckets, more for larger sets."""
    bits = LEAST_BITS
    while bits < BITS_EACH * len(s):
        bits *= 2
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


class Sketches:
    """The parity sketches of a list's members. One of twice another's size is folded to it: half its buckets on the other."""

    def __init__(self, packed: list[bytes]):
        self.size = np.array([len(x) // 8 for x in packed], np.int64)  # in 64-bit words
        self.row = np.zeros(len(packed), np.int64)
        self.of, self.half = {}, {}
        for size in np.unique(self.size).tolist():
            at = np.flatnonzero(self.size == size)
            self.row[at] = np.arange(len(at))
            self.of[size] = m = np.frombuffer(b"".join(packed[i] for i in at), np.uint64).reshape(len(at), size)
            self.half[size] = m[:, : size // 2] ^ m[:, size // 2 :]

    def apart(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(buckets in which i and each of others differ, buckets compared); 0 where sizes are further apart, as sets of such
        sizes are never alike."""
        out, bits, mine = np.zeros(len(others), np.int64), np.full(len(others), 64.0), int(self.size[i])
        for size, table, own in ((mine, self.of, self.of[mine]), (2 * mine, self.half, self.of[mine]), (mine // 2, self.of, self.half[mine])):
            at = np.flatnonzero(self.size[others] == size)
            if len(at):
                out[at] = np.bitwise_count(table[size][self.row[others[at]]] ^ own[self.row[i]]).sum(1, dtype=np.int64)
                bits[at] = 64.0 * min(size, mine)
        return out, bits


def most_apart(n1, n2, similarity: float):
    """How many shingles two sets of these sizes may not share, to reach the similarity."""
    return np.floor((n1 + n2) * (1 - similarity) / (1 + similarity) + 1e-9)


def required(n: int, similarity: float) -> int:
    """Shingles of n that a set must share with any set it reaches the similarity with."""
    return max(1, int(np.ceil(similarity * n - 1e-9)))


def gathered(parts, names: list[str], least: int = 1 << 16):
    """Tuples of equally long arrays as record batches of at least so many rows."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= least:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names)


def runs(batches):
    """Tables sorted by their first column, cut anew so that no value of it is divided."""
    held: list[pa.Table] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        first = t.column(0).to_numpy()
        if last is not None and first[-1] == last:
            held.append(t)
            continue
        at = int(np.searchsorted(first, first[-1], "left"))
        whole = [*held, t.slice(0, at)] if at or held else []
        if whole:
            yield pa.concat_tables(whole)
        held, last = [t.slice(at)], first[-1]
    if held:
        yield pa.concat_tables(held)


def _alike(sketch: Sketches, n: np.ndarray, i: int, others: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of others, against i: whether the sketch rules the pair out not, and whether it thinks it alike."""
    most = most_apart(n[others], n[i], similarity)
    open_ = np.abs(n[others] - n[i]) <= most
    near = others[open_]
    apart, bits = sketch.apart(i, near)
    open_[open_] = apart <= most[open_]
    guess = np.full(len(others), np.inf)
    kept = apart <= most_apart(n[near], n[i], similarity)
    guess[open_] = (-bits / 2 * np.log(np.maximum(1e-9, 1 - 2 * np.minimum(apart, bits / 2 - 1) / bits)))[kept]
    return open_, open_ & (guess <= most)


def stars(key, n, sketch, root, similarity: float):
    """(a, b) of each leader with the members that it is thought alike to; those of its own group need no pair."""
    left = np.arange(len(key))
    while len(left) > 1:
        lead, rest = left[0], left[1:]
        same = root[rest] == root[lead]
        like = _alike(sketch, n, lead, rest, similarity)[1] & ~same
        if like.any():
            yield np.full(int(like.sum()), key[lead]), key[rest[like]]
        left = rest[~(like | same)]


def across(key, n, sketch, root, similarity: float, side, whole: bool, smaller: list):
    """(a, b) of all members of different groups whose pair is not ruled out, and that no smaller list holds, where the pair
    is compared too: within the cell if it is whole, else between its two sides."""
    smaller = [frozenset(x) for x in smaller]
    first = np.arange(len(key)) if whole else np.flatnonzero(side == side.min())
    rest = first if whole else np.flatnonzero(side != side.min())
    for i in first:
        others = rest[(root[rest] != root[i]) & (rest < i if whole else True)]
        if len(others):
            others = others[_alike(sketch, n, i, others, similarity)[0]]
            others = np.array([j for j in others.tolist() if smaller[i].isdisjoint(smaller[j])], np.int64)
            if len(others):
                yield np.full(len(others), key[i]), key[others]


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, th (xxhash64 of the text), component_id, the smallest id linked by pairs of at least
    this Jaccard similarity.

    Texts without words are alike. Null ids take part but name a component only where it has no other id (then it is
    null). Equal rows and repeated ids are each answered. An empty table gives no rows; other columns are ignored. Very
    long texts are hashed in parts.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")

    def keyed(batches):
        """The rows' keys, and, at the task's end, its counts."""
        drop_caches()
        counts, pending, size = np.zeros(COUNTERS, np.int64), [], 0
        kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary(), pa.int32(), pa.binary()]
        names = ["doc_id", "th", "key", "fp", "n", "sketch", "slice", "counts"]
        for b in batches:
            out = []
            for d, t, text in each_row(b):
                h = shingle_hashes(text, shingle)
                s = np.unique(h)
                out.append((d, t, np.uint64(key_of(s)).astype(np.int64), np.uint64(majority(h)).astype(np.int64), len(s), sketch_of(s), None, None))
                pending.append((s >> np.uint64(46)).astype(np.int64))
                size += len(s)
                if size > 1 << 20:
                    counts += np.bincount(np.concatenate(pending), minlength=COUNTERS)
                    pending, size = [], 0
            cols = list(zip(*out)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
        if pending:
            counts += np.bincount(np.concatenate(pending), minlength=COUNTERS)
        if counts.any():
            packed = [pa.Codec("zstd").compress(part.astype("<i8").tobytes(), asbytes=True) for part in counts.reshape(SLICES, -1)]
            cols = [[None] * SLICES] * 6 + [list(range(SLICES)), packed]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
        drop_caches()

    def summed(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, body in each_row(b):
                got = np.frombuffer(pa.Codec("zstd").decompress(body, decompressed_size=8 * COUNTERS // SLICES, asbytes=True), "<i8")
                total[part] = total[part] + got if part in total else got
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "counts"])

    first = staged(texts.mapInArrow(keyed, "doc_id bigint, th bigint, key bigint, fp bigint, n int, sketch binary, slice int, counts binary"), "shingle-keys")
    rows = first.filter("slice IS NULL").select("doc_id", "th", "key")
    kept = first.filter("slice IS NULL").select("doc_id", "th", "key", "fp", "n", "sketch")
    sets = staged(kept.groupBy("key").agg(F.min("doc_id").alias("least"), F.min("th").alias("th"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "shingle-sets")
    slices = first.filter("slice IS NOT NULL").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(summed, "slice int, counts binary").collect()  # SLICES rows in all
    counts = np.zeros((SLICES, COUNTERS // SLICES), np.int64)
    for r in slices:
        counts[r["slice"]] = np.frombuffer(r["counts"], "<i8")
    order = spark.sparkContext.broadcast(np.minimum(counts.reshape(-1), (1 << 31) - 1).astype(np.int32))  # 1 MB

    def first_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        s = shingles(text, shingle)
        m = len(s) - required(len(s), similarity) + 1 if len(s) else 0
        rare = np.argsort(order.value[(s >> np.uint64(46)).astype(np.int64)], kind="stable")[:m]  # s ascends, so ties go by hash
        return s[rare].view(np.int64), np.full(m, key_of(s), np.uint64).view(np.int64)

    def prefixes(batches):
        drop_caches()
        yield from gathered((first_of(t) for b in batches for (t,) in each_row(b)), ["tok", "key"])
        drop_caches()

    def shared(batches):
        """The members of each shingle that several sets share, under a name that equal member sets have in common."""

        def lists():
            for t in runs(batches):
                tok, key = (c.to_numpy() for c in t.columns)
                new = np.append(True, (tok[1:] != tok[:-1]) | (key[1:] != key[:-1]))  # a set in several rows comes once
                tok, key = tok[new], key[new]
                start = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
                size = np.diff(np.append(start, len(tok)))
                name = _mixed(np.add.reduceat(_mixed(key.view(np.uint64)), start) + size.astype(np.uint64)).view(np.int64)
                some = np.repeat(size > 1, size)
                if some.any():
                    yield np.repeat(name, size)[some], key[some]

        yield from gathered(lists(), ["list", "key"])

    prefix = texts.select("text").mapInArrow(prefixes, "tok bigint, key bigint").repartition("tok").sortWithinPartitions("tok", "key")
    lists = staged(prefix.mapInArrow(shared, "list bigint, key bigint").distinct(), "shingle-lists")
    def alike(batches):
        drop_caches()
        known: dict[int, np.ndarray] = {}

        def of(key: int, text: str | None) -> np.ndarray:
            if key not in known:
                if len(known) >= KEPT:
                    known.pop(next(iter(known)))
                known[key] = shingles(text, shingle)
            return known[key]

        for b in batches:
            out = []
            for x, y, t, u in each_row(b):
                s, v = of(x, t), of(y, u)
                both = len(np.intersect1d(s, v, assume_unique=True))
                out.append((x, y, both >= similarity * (len(s) + len(v) - both) - 1e-9))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "linked"])
        known.clear()
        drop_caches()

    def verified(pairs: DataFrame, before: DataFrame | None) -> DataFrame:
        """pairs (a, b) that before has not, with linked; only the texts of their sets are shuffled."""
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        if before is not None:
            pairs = pairs.join(before.select("a", "b"), ["a", "b"], "left_anti")
        pairs = staged(pairs, "shingle-candidates")
        keys = staged(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(sets, "key").select("key", "th"), "candidate-keys")
        may = BitFilter(keys.select("th"), "candidates").mark(texts.select("th", "text"), F.col("th"), "may").filter("may")
        text = may.join(keys, "th").groupBy("key").agg(F.first("text").alias("text"))
        text = staged(text, "candidate-texts")
        both = pairs.join(text.toDF("a", "ta"), "a").join(text.toDF("b", "tb"), "b").sortWithinPartitions("b", "a")
        got = staged(both.select("a", "b", "ta", "tb").mapInArrow(alike, "a bigint, b bigint, linked boolean"), "shingle-pairs")
        return got if before is None else before.unionByName(got)

    def grouped(roots: DataFrame) -> DataFrame:
        """(list, key, root, count, most, major) of the lists that hold several groups: their members, the number of them, and
        their largest group. Sketches come later, as only these members need theirs."""
        at = lists.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        by_group = at.groupBy("list", "root").agg(F.count("*").alias("c")).groupBy("list").agg(F.sum("c").alias("count"), F.max(F.struct("c", "root")).alias("m"))
        mixed = by_group.filter("count > m.c").select("list", "count", F.col("m.c").alias("most"), F.col("m.root").alias("major"))
        return at.join(mixed, "list")

    def blocks_of(n):
        return F.ceil(n / BLOCK).cast("int")

    def starred(turn: int, at: DataFrame) -> DataFrame:
        """Each member in one block of its list, which the turn deals anew."""
        return at.withColumn("cell", F.struct(F.lit(0).alias("kind"), F.pmod(F.xxhash64("key", F.lit(turn)), blocks_of(F.col("count"))).cast("int").alias("a"), F.lit(0).alias("b"))).withColumns({"side": F.lit(0), "smaller": F.array().cast("array<bigint>")})

    def celled(turn: int, at: DataFrame) -> DataFrame:
        """Each list as cells of pairs of blocks, so that every pair of different groups meets in one cell, and a cell holds two
        blocks at most: blocks of members outside the largest group against one another, and against that group's. smaller:
        the lists before this one that the member is in as well."""
        at = at.withColumns({"minor": F.col("root") != F.col("major"), "rows": blocks_of(F.col("count") - F.col("most")), "cols": blocks_of(F.col("most"))})
        at = at.withColumn("own", F.pmod(F.xxhash64("key", F.lit(turn)), F.when(F.col("minor"), F.col("rows")).otherwise(F.col("cols"))).cast("int"))
        upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        cell = lambda kind, a, b, side: F.struct(F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b")).alias("cell"), side.cast("int").alias("side"))
        own = F.col("own")
        one_another = F.transform(upto("rows"), lambda v: cell(0, F.least(own, v), F.greatest(own, v), own))
        cells = F.when(F.col("minor"), F.concat(one_another, F.transform(upto("cols"), lambda w: cell(1, own, w, F.lit(0))))).otherwise(F.transform(upto("rows"), lambda u: cell(1, u, own, F.lit(1))))
        held = at.groupBy("key").agg(F.collect_list("list").alias("held"))  # no more than a set's first shingles
        at = at.join(held, "key").withColumn("smaller", F.filter("held", lambda x: x < F.col("list")))
        return at.select("list", "key", "root", "smaller", F.explode(cells).alias("c")).select("list", "key", "root", "smaller", "c.*")

    def compared(turn: int, roots: DataFrame, how) -> DataFrame:
        """Candidate pairs of lists that hold several groups."""
        at = (celled if how is across else starred)(turn, grouped(roots))
        whole = (F.col("cell.kind") == 0) & (F.col("cell.a") == F.col("cell.b"))
        dealt = at.select("key", "root", "side", "smaller", F.xxhash64("list", "cell").alias("run"), whole.alias("whole"), F.xxhash64("key", F.lit(turn)).alias("spot")).join(sets.select("key", "n", "sketch"), "key")

        def run(batches):
            drop_caches()

            def pairs():
                for t in runs(batches):
                    run_, key, n, root, side, whole_ = (t.column(c).to_numpy() for c in ("run", "key", "n", "root", "side", "whole"))
                    packed = t.column("sketch").to_pylist()
                    start = np.flatnonzero(np.append(True, run_[1:] != run_[:-1]))
                    for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(key)]):
                        more = (side[lo:hi], bool(whole_[lo]), t.column("smaller").slice(lo, hi - lo).to_pylist()) if how is across else ()
                        yield from how(key[lo:hi], n[lo:hi].astype(np.int64), Sketches(packed[lo:hi]), root[lo:hi], similarity, *more)

            yield from gathered(pairs(), ["a", "b"])

        keyed_ = dealt.select("run", "key", "n", "root", "sketch", "side", "whole", "smaller", "spot")
        return keyed_.repartition("run").sortWithinPartitions("run", "spot").mapInArrow(run, "a bigint, b bigint")

    prints = staged(sets.groupBy("fp").agg(F.min("key").alias("key")), "shingle-fingerprints")
    near = star_edges(prints.select("fp")).join(prints.toDF("a", "ka"), "a").join(prints.toDF("b", "kb"), "b").select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    twins = sets.select("fp", "key").join(prints.toDF("fp", "one"), "fp").filter("key <> one").select(F.col("key").alias("a"), F.col("one").alias("b"))
    tested = verified(near.unionByName(twins), None)
    known, roots = -1, None
    for turn, how in enumerate((stars, stars, across, None)):
        links = tested.filter("linked").select("a", "b")
        n = links.count()
        if n != known:
            known, roots = n, components(links)
        if how is not None:
            tested = verified(compared(turn, roots, how), tested)
    member = sets.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    of_key = staged(member.join(named, "root").select("key", "component_id"), "shingle-components")
    return rows.join(of_key, "key").select("doc_id", "th", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their own columns: those of the smallest id of each group. A repeated id stays with
    all its rows that are in groups which it names; null ids stay. Null texts count as empty; an empty table stays empty."""
    gone = near_duplicates(docs).filter("doc_id <> component_id").select("doc_id", "th").distinct()
    return without(docs, gone, "near")
