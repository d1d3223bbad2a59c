"""Helpers that the training-data operators share: shared storage, staged tables, row keys and deterministic ranks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Arrow batches of so many bytes instead of Spark's default, as a batch is held by the JVM and by a Python worker at once.
BATCH_SETTING, DEFAULT_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, "2097152b"


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to BATCH_BYTES, unless its owner has set another size."""
    if spark.conf.get(BATCH_SETTING).rstrip("b") == str(DEFAULT_BATCH):
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's spark.checkpoint.dir; one of our own only where that is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or (sc._jsc.sc().getCheckpointDir().getOrElse(None) if sc._jsc.sc().getCheckpointDir().isDefined() else None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="siltstone-shared-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/siltstone/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors and fixes generated ids."""
    spark = df.sparkSession
    small_batches(spark)
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession, n_bytes: int, per_task: int) -> int:
    """Partitions of per_task bytes each, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // per_task))


def with_rank(df: DataFrame, keys: list[str], order: list, rank: str, label: str) -> DataFrame:
    """Add a gapless rank from 0 within keys (over everything if keys is empty), without bringing a key's rows together.

    Range-partitions by keys and order, numbers each partition's rows per key, and adds the prefix sum of the counts of
    earlier partitions. Only the counts, one row for each key and partition that holds it, meet by key.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part, at = f"__{rank}_part", f"__{rank}_at"
    ranged = df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn(part, F.spark_partition_id())
    by_part = Window.partitionBy(part, *keys).orderBy(*order)
    numbered = staged(ranged.withColumn(at, F.row_number().over(by_part) - 1), label)
    counts = numbered.groupBy(*keys, part).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(part).alias("__p"), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__base"))
    on = F.col(part) == F.col("__p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return numbered.join(base, on).withColumn(rank, F.col(at) + F.col("__base")).drop(part, at, "__p", "__base", *[f"__k{i}" for i in range(len(keys))])


LEAST_WORDS, MOST_WORDS = 1 << 12, 1 << 21  #: 64-bit words of a bit filter: 32 KB to 16 MB


class BitFilter:
    """Which hashes may be among some: a bit set of about 16 bits for each, at most 16 MB, that the executors get by a
    broadcast join. It says no only of hashes that are not among them; beyond some 8 million hashes it says yes too often,
    never wrongly no, and what it lets through must still be looked up."""

    def __init__(self, hashes: DataFrame, label: str):
        """hashes: one bigint column."""
        held = staged(hashes.toDF("__h").distinct(), f"{label}-hashes")
        n = held.count()
        words = LEAST_WORDS
        while words < min(MOST_WORDS, n // 4):
            words *= 2
        self.words = words
        spot = F.pmod("__h", F.lit(64 * words))
        self.bits = staged(held.groupBy(self._word(spot).alias("__w")).agg(F.bit_or(self._bit(spot)).alias("__b")), f"{label}-filter")

    @staticmethod
    def _bit(spot):
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(spot, F.lit(64)).cast("int"))

    @staticmethod
    def _word(spot):
        return F.floor(spot / 64).cast("int")

    def mark(self, df: DataFrame, h, name: str) -> DataFrame:
        """df with the flag name: whether the hash h (a column that is not null) may be among them."""
        spot = F.pmod(h, F.lit(64 * self.words))
        hit = df.withColumn("__spot", spot).join(F.broadcast(self.bits), self._word(F.col("__spot")) == F.col("__w"), "left")  # at most MOST_WORDS rows
        return hit.withColumn(name, F.coalesce(F.col("__b").bitwiseAND(self._bit(F.col("__spot"))) != 0, F.lit(False))).drop("__spot", "__w", "__b")


def without(docs: DataFrame, dropped: DataFrame, label: str) -> DataFrame:
    """docs less the rows whose (doc_id, xxhash64 of the text, null as empty) is in dropped (doc_id, th; distinct). Only rows that a bit
    filter flags are shuffled; the others stay where they are."""
    dropped = staged(dropped.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")), f"{label}-dropped")
    marked = BitFilter(dropped.select(F.xxhash64("__id", "__th")), label).mark(docs.withColumn("__t", F.xxhash64(F.coalesce("text", F.lit("")))), F.xxhash64(F.col("doc_id").cast("bigint"), F.col("__t")), "__may")
    some = marked.filter("__may").join(dropped, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__th")), "left_anti")
    return some.select(*docs.columns).unionByName(marked.filter("NOT __may").select(*docs.columns))


def each_row(batch, step: int = 128):
    """The rows of an Arrow batch as tuples, a few at a time, so that a batch of long texts is not copied whole."""
    for at in range(0, batch.num_rows, step):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, step).columns))


CACHES: list = []  #: what operators keep between tasks in this Python worker


def drop_caches(keep=None) -> None:
    """For an operator that needs the worker's memory: forget what others keep; they fill their caches again when they run."""
    for cache in CACHES:
        if cache is not keep:
            cache.clear()
    trim_memory()


def trim_memory() -> None:
    """Give freed arrays back to the system: reused Python workers share an executor's memory with its JVM."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
