"""Repositories as a stored table that an update rewrites only where it changes something.

Rows lie in parts (by a hash of the id), each with its rows bucketed by id. An update reads and overwrites the parts that
its rows fall into; the others keep their files. Within them, the stored side is already partitioned by id, so only the
update's rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "__part"


class Store:
    """A table name of the session's catalogue, its key column, and its number of parts and of buckets in each part.

    parts bounds how finely updates pick what they rewrite, buckets how many tasks a part is read by; both are fixed when
    the table is made. One writer at a time: two updates of one part at once would overwrite each other.
    """

    def __init__(self, spark: SparkSession, name: str, key: str, parts: int = 64, buckets: int = 4):
        self.spark, self.name, self.key, self.parts, self.buckets = spark, name, key, parts, buckets

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def create(self, rows: DataFrame) -> None:
        """Make the table of rows, one for each key."""
        self._bucketed(rows.withColumn(PART, self._part())).write.partitionBy(PART).bucketBy(self.buckets, self.key).sortBy(self.key).format("parquet").saveAsTable(self.name)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        """One task for each bucket, so that a bucket of a part is one file."""
        return rows.repartition(self.buckets, self.key)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).drop(PART)

    def touched(self, delta: DataFrame) -> list[int]:
        """The parts that the rows of delta fall into: at most all of them, as numbers."""
        return sorted(r[0] for r in delta.select(self._part().alias("p")).distinct().collect())

    def stored(self, parts: list[int]) -> DataFrame:
        return self.spark.table(self.name).filter(F.col(PART).isin(*parts) if parts else F.lit(False))

    def joined(self, delta: DataFrame, parts: list[int], how: str = "full") -> DataFrame:
        """The stored rows of these parts beside delta's (one for each key) as structs old and new, with the key and part."""
        old = self.stored(parts)
        new = delta.select(F.struct(*delta.columns).alias("new"), F.col(self.key).alias("__k")).hint("shuffle_merge")
        both = old.select(F.struct(*[c for c in old.columns if c != PART]).alias("old"), F.col(self.key)).join(new, F.col(self.key) == F.col("__k"), how)
        return both.select(F.coalesce(self.key, "__k").alias(self.key), "old", "new").withColumn(PART, self._part())

    def update(self, delta: DataFrame, change: Callable[[str], Column | None], insert: bool = True) -> dict[str, int]:
        """Apply delta, one row for each key; parts_rewritten and parts in all.

        change gives a column's new value from old.* and new.*, structs that are null on the side that has no row; None
        keeps the old value and takes the new one where there is no old row. With insert, keys that are not stored are
        added; without, they are passed over. Columns that delta lacks stay, null in added rows.
        """
        parts = self.touched(delta)
        if parts:
            columns = [c for c in self.spark.table(self.name).columns if c not in (PART, self.key)]
            given = set(delta.columns)
            value = lambda c: made if (made := change(c)) is not None else F.when(F.col("old").isNull(), F.col(f"new.{c}") if c in given else F.lit(None)).otherwise(F.col(f"old.{c}"))
            both = self.joined(delta, parts, "full" if insert else "left")
            out = both.select(F.col(self.key), *[value(c).alias(c) for c in columns], PART).select(*self.spark.table(self.name).columns)
            before = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
            try:
                self._bucketed(out).write.mode("overwrite").insertInto(self.name)
            finally:
                self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
        return {"parts_rewritten": len(parts), "parts": self.parts}


def added(c: str) -> Column:
    """old + new of a counter, either side missing as zero."""
    return F.coalesce(F.col(f"old.{c}"), F.lit(0)) + F.coalesce(F.col(f"new.{c}"), F.lit(0))


def upsert(store: Store, delta: DataFrame, counters: list[str], add_to_set: tuple[str, ...] = ()) -> dict[str, int]:
    """Add delta's counters and set members to the stored rows, insert what is not stored; other columns are set on insert."""

    def change(c: str) -> Column | None:
        if c in counters:
            return added(c)
        if c in add_to_set:
            none = F.array().cast(delta.schema[c].dataType)
            return F.array_sort(F.array_distinct(F.concat(F.coalesce(F.col(f"old.{c}"), none), F.coalesce(F.col(f"new.{c}"), none))))
        return None

    return store.update(delta, change)


def set_where(store: Store, delta: DataFrame, columns: list[str], holds: Column) -> dict[str, int]:
    """Set columns from delta's rows where holds, a condition on old.* and new.*, is true of the stored row (compare and
    set: a claim, a settlement, a promotion); nothing is inserted."""
    met = F.col("new").isNotNull() & F.coalesce(holds, F.lit(False))
    return store.update(delta, lambda c: F.when(met, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) if c in columns else F.col(f"old.{c}"), insert=False)
