"""Exact dedup against a persistent digest index.

The index is a table of text digests, bucketed and sorted by digest, with a partition for each batch. A batch is reduced to
one row per digest before any join; those rows meet the index in a sort-merge anti-join, and the ones that it lacks are
written as the batch's own partition. The index side is never shuffled: its files already lie by bucket. A batch that runs
again, after a failure or not, does not see its own partition and overwrites it, so it decides as it did before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import BitFilter, fresh_path, staged, tasks_for, without

WHITESPACE = " \t\n\x0b\x0c\r"
BUCKET_BYTES = 64 << 20  #: of index rows that a bucket is made for
ROW_BYTES = 96  #: of an index row, about


def digest_of(text: F.Column) -> F.Column:
    """Lowercase hex SHA-256 of the text without ASCII white space; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITESPACE, "").cast("binary"), 256)


class DigestIndex:
    """Digests seen so far below a path in shared storage: (digest, keep_id, batch), in buckets by digest, sorted within each.

    Another session opens it by its path; the number of buckets is part of the folder's name. It is set when the index is
    made, for the rows expected in all, and by compacted, which also brings each bucket back to one file.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, expected: int = 0, buckets: int | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "digests")
        found = self._found()
        self.buckets = found or buckets or tasks_for(spark, expected * ROW_BYTES, BUCKET_BYTES)
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest string, keep_id bigint, batch string) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/buckets-{self.buckets}'"
        )
        if found:
            spark.sql(f"MSCK REPAIR TABLE {self.table}")

    def _found(self) -> int | None:
        """The bucket count of the index that is at the path already."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in store.listStatus(top)] if store.exists(top) else []
        return next((int(n.split("-")[1]) for n in sorted(names) if n.startswith("buckets-")), None)

    def read(self, but: str | None = None) -> DataFrame:
        """The index, less the rows of one batch."""
        rows = self.spark.table(self.table)
        return rows if but is None else rows.filter(F.col("batch") != but)

    def missing(self, digests: DataFrame, batch: str | None = None) -> DataFrame:
        return digests.join(self.read(batch).select("digest").hint("merge"), "digest", "left_anti")

    def put(self, entries: DataFrame, batch: str) -> None:
        """Write entries (digest, keep_id) as the batch's partition, in the place of what it wrote before."""
        view = f"batch_{uuid.uuid4().hex}"
        entries.select("digest", "keep_id").repartition(self.buckets, "digest").createOrReplaceTempView(view)
        quoted = batch.replace("'", "''")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION (batch = '{quoted}') SELECT digest, keep_id FROM {view}")
        self.spark.catalog.dropTempView(view)
        self.spark.catalog.refreshTable(self.table)

    def compacted(self, path: str, batch: str = "compacted") -> DigestIndex:
        """A new index at path with the same digests, as one batch, in as many buckets as their number asks for; this one is left as it is."""
        rows = self.read().groupBy("digest").agg(F.min("keep_id").alias("keep_id"))
        out = DigestIndex(self.spark, path, self.read().count())
        out.put(rows, batch)
        return out

    def close(self) -> None:
        """Forget the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _decided(docs: DataFrame, index: DigestIndex | None, batch: str | None, id_col: str, text_col: str) -> DataFrame:
    """exact_dedup's rows, with th, the hash of the text."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.length(text).alias("__len"), F.xxhash64(text).alias("th"), digest_of(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("__rid"))
    rows = staged(rows, "exact-rows")
    best = F.min(F.struct((-F.col("__len")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__rid").alias("rid"))).alias("best")
    groups = staged(rows.groupBy("digest").agg(best, F.count("*").alias("group_size")).select("digest", F.col("best.id").alias("keep_id"), F.col("best.rid").alias("rid"), "group_size"), "exact-groups")
    own = index is None
    index = index or DigestIndex(spark, expected=groups.count())
    batch = batch or uuid.uuid4().hex
    new = staged(index.missing(groups, batch), "exact-new")
    index.put(new, batch)
    known = groups.drop("keep_id", "rid").join(index.read(batch).select("digest", "keep_id").hint("merge"), "digest").select("digest", "keep_id", F.lit(-1).cast("bigint").alias("rid"), "group_size")
    owners = staged(new.select("digest", "keep_id", "rid", "group_size").unionByName(known).withColumnRenamed("digest", "text_sha256"), "exact-owners")
    if own:
        index.close()
    kept = (F.col("__rid") == F.col("rid")).alias("kept")
    return rows.withColumnRenamed("digest", "text_sha256").join(owners, "text_sha256").select("doc_id", "keep_id", "group_size", kept, "text_sha256", "th")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Decide each row of docs against the index and the rest of the batch, and add the new digests to the index.

    Returns doc_id, keep_id, group_size (rows of this batch with that text), kept, text_sha256, one row per input row.
    Of equal new texts the row with most code points in the original stays, then the smallest id; one of rows that are
    equal in id and text too. A text that the index has from another batch is dropped for the indexed id. Give a batch that
    may run again a name: its second run decides like the first. Nulls and empty texts are one group. A null id loses to
    any other and is kept only where its group has no other. Other columns are ignored. An empty table gives no rows and
    adds none. Very long texts are digested whole. Hot texts: the batch is aggregated by digest map-side first, and the
    final join, rows by digest, is one that adaptive execution may split.
    """
    return _decided(docs, index, batch, id_col, text_col).drop("th")


def deduplicated(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of docs that stay, with their own columns: one for each text, also of rows that are equal in every column.

    Decided as by exact_dedup, nulls, empty texts and repeated ids as there; an empty table stays empty. Only rows that may
    have to go are shuffled, found by bit filters over the hashes of id and text.
    """
    rows = _decided(docs, index, batch, "doc_id", "text")
    by_row = staged(rows.groupBy("doc_id", "th").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "exact-decisions")
    out = without(docs, by_row.filter("NOT kept").select("doc_id", "th"), "exact")
    twice = staged(by_row.filter("kept AND n > 1").select("doc_id", "th"), "exact-repeated")
    if twice.isEmpty():
        return out
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    marked = BitFilter(twice.select(F.xxhash64("doc_id", "th")), "repeated").mark(out.withColumn("__t", th), F.xxhash64(F.col("doc_id").cast("bigint"), F.col("__t")), "__may")
    again = marked.filter("__may").dropDuplicates(["doc_id", "__t"])
    return again.select(*docs.columns).unionByName(marked.filter("NOT __may").select(*docs.columns))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS len, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
