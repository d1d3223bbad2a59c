"""Filter interaction audit by lattice-edge aggregation.

What a filter removes depends on the filters before it only as a set. Five filters make 80 edges (set already applied, next
filter) of the lattice of their subsets, and each of the 120 orders is a path of five edges through it. Documents are
counted once by what they fail, the counts go to the 80 edges, and the 600 steps of all orders look their edges up.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
GAP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failed_alone(text: Column) -> Column:
    """The bits of A to D that a text (not null) fails by itself."""
    words = F.array_remove(F.split(text, GAP), "")
    n, distinct, length = (c.cast("bigint") for c in (F.size(words), F.size(F.array_distinct(words)), F.length(text)))
    capitals = length - F.length(F.translate(text, UPPER, ""))
    fails = (n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * length, text.rlike(r"[#$%&*|]"))
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, good, toxic, n): documents of a part counted by the set of filters that they fail and by their labels.

    Of equal texts, those with the smallest doc_id pass E, the others fail it. A row with no doc_id has no smaller one and
    passes. A text travels as its digest; rows that are equal in all that counts are counted before each shuffle, so a
    text that many documents hold arrives as a few rows, and rows without an id are dealt by their digest.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"), F.coalesce("lang", F.lit("")).alias("part"), failed_alone(t).alias("bits"))
    rows = rows.select("*", F.col("id").isNotNull().alias("known"), F.coalesce("id", F.xxhash64("digest")).alias("deal")).groupBy("known", "deal", "id", "digest", "part", "bits").agg(F.count("*").alias("n"))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.lit(True).alias("known"), F.col("doc_id").cast("bigint").alias("deal")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(marks, ["known", "deal"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # By text: how many rows have the smallest id, how many any, how many none.
    known = F.when(F.col("id").isNotNull(), F.col("n"))
    groups = rows.groupBy("digest", "part", "bits", "good", "toxic").agg(F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"), F.sum("n").alias("n_all"), F.sum(known).alias("n_known"))
    first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))  # a row for each part and label, whatever the copies
    passing = F.col("n_all") - F.coalesce("n_known", F.lit(0)) + F.coalesce(F.when(first, F.col("n_least")), F.lit(0))
    each = F.explode(F.array(F.struct("bits", F.col("passing").alias("n")), F.struct((F.col("bits") + 16).alias("bits"), (F.col("n_all") - F.col("passing")).alias("n")))).alias("e")
    return groups.withColumn("passing", passing).select("part", "good", "toxic", each).filter("e.n > 0").groupBy("part", "e.bits", "good", "toxic").agg(F.sum("e.n").alias("n"))


def edges(counted: DataFrame) -> DataFrame:
    """(part, applied, next, the counts): one row for each part and each of the 80 edges."""
    lattice = [(s, f) for f in range(len(FILTERS)) for s in range(1 << len(FILTERS)) if not s & (1 << f)]
    edge = F.explode(F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(1 << f).alias("next")) for s, f in lattice])).alias("edge")
    rows = counted.select("*", edge).select("part", "bits", "good", "toxic", "n", "edge.*")
    reaches, fails = F.col("bits").bitwiseAND(F.col("applied")) == 0, F.col("bits").bitwiseAND(F.col("next")) != 0
    held = {"kept": reaches & ~fails, "removed": reaches & fails, "redundant": ~reaches & fails, "unique_fails": F.col("bits") == F.col("next"), "good_lost": reaches & fails & F.col("good"), "toxic_lost": reaches & fails & F.col("toxic")}
    return rows.groupBy("part", "applied", "next").agg(*[F.sum(F.when(held[c], F.col("n")).otherwise(F.lit(0).cast("bigint"))).alias(c) for c in COUNTS])


def with_shapley(edged: DataFrame) -> DataFrame:
    """Add shapley: the removals of the edge's filter over all orders, each edge as often as orders pass it."""
    n = len(FILTERS)
    passed = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), (F.bit_count("applied") + 1).cast("int"))
    return edged.withColumn("shapley", F.sum(F.col("removed") * passed).over(Window.partitionBy("part", "next")))  # 16 edges each


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (lang, null as empty), order of the five filters and step: part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley; zeros included.

    A null text is empty, so it fails A; no text is too long, as each is looked at alone. Rows that are equal in all
    columns count each. An id with several labels is good or toxic if any says so. Other columns, and their names, do not
    matter; without documents there are no parts and no rows, without labels nothing is good or toxic. The steps are a
    fixed table of 600 rows; the edges are 80 for each part.
    """
    steps = [("".join(o), i + 1, sum(1 << FILTERS.index(x) for x in o[:i]), 1 << FILTERS.index(o[i])) for o in permutations(FILTERS) for i in range(len(FILTERS))]
    paths = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, next int")
    edged = with_shapley(edges(patterns(docs, labels)))
    return edged.join(F.broadcast(paths), ["applied", "next"]).select("part", "filter_order", "step", *COUNTS, "shapley")  # 600 rows


ORACLE_SQL = r"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w LEFT JOIN g USING (doc_id)),
n AS (SELECT part, good, toxic, [a, b, c, d, e] AS fails, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [p.i, q.i, r.i, s.i, u.i] AS o FROM l p, l q, l r, l s, l u WHERE len(list_distinct([p.i, q.i, r.i, s.i, u.i])) = 5),
x AS (SELECT part, o, k.i AS step, n.n, good, toxic, fails[o[k.i]] AS failing, len(list_filter(o[1:k.i - 1], lambda y: fails[y])) > 0 AS gone, len(list_filter(fails, lambda y: y)) AS n_failed FROM n, o, l k),
y AS (SELECT part, o, step, sum(n) FILTER (WHERE NOT failing AND NOT gone) AS kept, sum(n) FILTER (WHERE failing AND NOT gone) AS removed, sum(n) FILTER (WHERE failing AND gone) AS redundant, sum(n) FILTER (WHERE failing AND n_failed = 1) AS unique_fails,
sum(n) FILTER (WHERE failing AND NOT gone AND good = 1) AS good_lost, sum(n) FILTER (WHERE failing AND NOT gone AND toxic = 1) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, o[step]))::BIGINT AS shapley FROM y"""
