"""SimHash near-duplicates by vantage-point trees.

Documents reduce to distinct 64-bit fingerprints. A vantage-point tree built from a bounded sample cuts Hamming space into
shards; a fingerprint lives in one shard and visits each later one that the triangle bounds leave within reach. A shard
finds its exact pairs ring by ring around its own vantage point and hands on a spanning star per local group rather than
its pairs; alternating large and small stars join the groups across shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import drop_caches, each_row, staged

SHINGLE, RADIUS, SEED = 3, 3, 42
SAMPLE = 20_000  #: fingerprints that shape the tree
SHARD_BASE = 512  #: shards grow as the square root of the fingerprints over this, which balances visits against comparisons
BLOCK = 65_536  #: points of a shard beyond which it is compared in pairs of blocks
BRUTE = 1 << 20  #: comparisons below which a local tree does not branch any more


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of word shingles, repeats included; of the whole sequence if it is shorter; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -shingle] + 1])
    return majority(np.fromiter((h(line[s:e], SEED) for s, e in zip(starts.tolist(), ends[shingle - 1 :].tolist())), np.uint64, len(starts)))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; 0 without any."""
    ones, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 1 << 14):
        block = hashes[at : at + (1 << 14)].astype("<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


class Tree:
    """Arrays of a vantage-point tree over a sample; leaves are shards. A bounded object, whatever the corpus."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.nodes: list[list] = []  # [vantage, bound, near, far]; a leaf is [-1, shard]
        self.shards = 0
        self._grow(sample, leaves, rng)

    def _grow(self, points: np.ndarray, leaves: int, rng) -> int:
        at = len(self.nodes)
        self.nodes.append([])
        if leaves > 1 and len(points) >= 8:
            best = None
            for v in rng.choice(points, size=min(16, len(points)), replace=False):  # of these, the vantage with the fewest points near its bound
                d = np.bitwise_count(points ^ v).astype(int)
                for bound in np.unique(np.quantile(d, [0.35, 0.5, 0.65]).astype(int)):
                    near = (d <= bound).mean()
                    if 0.2 <= near <= 0.8:
                        both = (np.abs(d - bound - 0.5) <= RADIUS).mean() + abs(near - 0.5)
                        if best is None or both < best[0]:
                            best = (both, v, int(bound), d <= bound)
            if best:
                _, v, bound, near = best
                self.nodes[at] = [int(v), bound, 0, 0]
                share = min(leaves - 1, max(1, round(leaves * near.mean())))
                self.nodes[at][2] = self._grow(points[near], share, rng)
                self.nodes[at][3] = self._grow(points[~near], leaves - share, rng)
                return at
        self.nodes[at] = [-1, self.shards]
        self.shards += 1
        return at

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into fps, shard, whether it lives there) for each shard that a fingerprint lives in or must visit."""
        out = []
        stack = [(0, np.arange(len(fps)), np.ones(len(fps), bool))]
        while stack:
            at, idx, home = stack.pop()
            if not len(idx):
                continue
            node = self.nodes[at]
            if node[0] == -1:
                out.append((idx, np.full(len(idx), node[1]), home))
                continue
            d = np.bitwise_count(fps[idx] ^ np.uint64(node[0])).astype(np.int64)
            near, far = d - RADIUS <= node[1], d + RADIUS > node[1]
            stack.append((node[2], idx[near], home[near] & (d[near] <= node[1])))
            stack.append((node[3], idx[far], home[far] & (d[far] > node[1])))
        i, shard, home = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        own = np.zeros(len(fps), np.int64)
        own[i[home.astype(bool)]] = shard[home.astype(bool)]
        keep = shard >= own[i]  # of two linked fingerprints, the one of the earlier shard visits the other
        return i[keep], shard[keep], home[keep].astype(bool)


def near_pairs(points: np.ndarray, mine: np.ndarray, others: np.ndarray, depth: int = 4):
    """(i, those of others within RADIUS of it) for i of mine, places in points: a local vantage-point tree. A node takes a
    vantage point and branches by the distance to it; a ring's pairs lie in the rings that the triangle bounds leave."""
    if not len(mine) or not len(others):
        return
    if depth and len(mine) * len(others) > BRUTE:
        vantage = points[mine[len(mine) // 2]]
        d, e = np.bitwise_count(points[mine] ^ vantage), np.bitwise_count(points[others] ^ vantage)
        order = np.argsort(e, kind="stable")
        e = e[order].astype(np.int64)
        for r in np.unique(d).tolist():
            lo, hi = np.searchsorted(e, [r - RADIUS, r + RADIUS + 1])
            yield from near_pairs(points, mine[d == r], others[order[lo:hi]], depth - 1)
        return
    step = max(1, (1 << 22) // len(others))
    for k in range(0, len(mine), step):
        part = mine[k : k + step]
        close = np.bitwise_count(points[part][:, None] ^ points[others][None, :]) <= RADIUS
        for j in np.flatnonzero(close.any(1)):
            yield part[j], others[close[j]]


def local_stars(home: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between homes and others, as (point, smallest point of its local group) for points with a link."""
    points = np.unique(np.concatenate([home, others]))
    parent = np.arange(len(points))

    def roots(x: np.ndarray) -> np.ndarray:
        while True:
            y = parent[x]
            if (parent[y] == y).all():
                return y
            parent[x] = parent[y]
            x = y

    for i, near in near_pairs(points, np.searchsorted(points, np.unique(home)), np.searchsorted(points, np.unique(others))):
        found = np.unique(roots(np.append(near, i)))
        parent[found] = found[0]
    root = roots(np.arange(len(points)))
    linked = np.flatnonzero(root != np.arange(len(points)))
    return points[linked], points[root[linked]]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def star_edges(fps: DataFrame) -> DataFrame:
    """Spanning stars (a, b) of every shard's exact pairs, over the distinct fingerprints fps (fp)."""
    spark = fps.sparkSession
    n = fps.count()
    if not n:
        return spark.createDataFrame([], "a bigint, b bigint")
    shards = max(1, int((n / SHARD_BASE) ** 0.5))
    most = max(SAMPLE, 32 * shards)  # grows as the square root of the fingerprints
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(most).collect()], dtype=np.int64).view(np.uint64)
    tree = spark.sparkContext.broadcast(Tree(sample, shards))

    def route(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            i, shard, home = tree.value.route(fp.astype(np.int64).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(shard.astype(np.int32)), pa.array(home)], ["fp", "shard", "home"])

    routed = staged(fps.select("fp").mapInArrow(route, "fp bigint, shard int, home boolean"), "routed")
    blocks = routed.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    sized = routed.join(F.broadcast(blocks), "shard")  # a row for each shard: the square root of the fingerprints
    spread = sized.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    # A shard of n blocks is compared as n * n pairs of them: homes of one with all points of the other.
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    asked = spread.filter("home").select("fp", "shard", F.col("own").alias("i"), every).select("fp", "shard", "i", F.col("other").alias("j"), F.lit(True).alias("home"))
    met = spread.select("fp", "shard", F.col("own").alias("j"), every).select("fp", "shard", F.col("other").alias("i"), "j", F.lit(False).alias("home"))

    def links(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        home = table.column("home").to_numpy()
        a, b = local_stars(fp[home], fp[~home]) if home.any() else (fp[:0], fp[:0])
        return pa.table({"a": _signed(a), "b": _signed(b)})

    return asked.unionByName(met).groupBy("shard", "i", "j").applyInArrow(links, "a bigint, b bigint").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that it reaches. Alternating stars; each round is staged."""
    edges = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state or not new[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = new
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = staged(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "large-star")
        floor = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(floor, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(floor.select("a", F.col("m").alias("b")))
        edges = staged(small.distinct(), "small-star")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds, which link 2 ** {most_rounds} nodes in a row: the edges change between runs; stage them, or raise most_rounds")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id, the smallest id linked at RADIUS bits or fewer.

    Null and empty texts have fingerprint zero, linked like any other. Null ids take part but name a component only where
    it has no other id (then it is null). Equal rows and repeated ids are each answered. An empty table gives no rows;
    other columns are ignored. Copies meet only as one fingerprint, aggregated map-side; a dense shard is dealt in blocks.
    """

    def run(batches):
        drop_caches()
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for _, t in each_row(b)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_signed(fp))], ["doc_id", "fp"])

    rows = staged(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint"), "fingerprints")
    fps = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(star_edges(fps))
    member = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    of = staged(member.join(named, "root").select("fp", "component_id"), "fingerprint-components")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
