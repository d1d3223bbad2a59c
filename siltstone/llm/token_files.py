"""Flat token files: unsigned integers, and 64-bit document offsets beside them, for memory mapping.

Texts are encoded where they lie; only packed ids, 16 bits wide where the vocabulary allows, else 32, are dealt to shards by
ranges of document ids, cut by a sample, and sorted. A shard is three files: NNNNN.bin, the ids of its documents one after
another; NNNNN.idx, little-endian 64-bit offsets in ids, one more than documents; and NNNNN.doc, their ids. A manifest
(Parquet) holds each shard's counts; its prefix sums are the shards' bases. A shard is written under a name of its attempt
and renamed when whole, so a repeated or speculative task leaves the same files.
"""

from __future__ import annotations

import uuid
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import each_row, fresh_path, staged, tasks_for
from siltstone.llm.tokens import encoder, file_of

END = 1
NO_ID = -(1 << 63)  #: stands for a null id in .doc files


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


SAMPLE = 20  #: ids sampled for each shard, to cut the ranges
MOST_SHARDS = 1 << 16  #: beyond so many, shards grow with the corpus, so that the driver gets at most some 2 * SAMPLE * MOST_SHARDS ids (21 MB)


def kind_of(vocabulary: int, end_id: int) -> np.dtype:
    return np.dtype("<u2") if vocabulary <= 1 << 16 and end_id < 1 << 16 else np.dtype("<u4")


def range_ends(ids: DataFrame, shards: int) -> np.ndarray:
    """Where the ranges of shards begin, ascending, from a sample of doc_id; an id that holds many rows comes repeatedly."""
    share = min(1.0, 2 * SAMPLE * shards / max(1, ids.count()))
    got = ids.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("d")).sample(share, seed=5) if share < 1 else ids.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"))
    found = np.sort(got.toArrow().column(0).to_numpy().astype(np.int64))  # some 2 * SAMPLE for each of at most MOST_SHARDS
    return found[(np.arange(1, shards) * len(found)) // shards] if len(found) else found


def shards_of(ids: np.ndarray, spots: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The shard of each id; an id at which several ranges begin is dealt to them in the order of spots (32 bits)."""
    low, high = np.searchsorted(ends, ids, "left"), np.searchsorted(ends, ids, "right")
    return low + ((spots * (high - low + 1)) >> 32)


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END, shard_bytes: int = 64 << 20) -> DataFrame:
    """Encode docs into shards for about shard_bytes of text each, but at most MOST_SHARDS, under path; returns the manifest: shard, n_docs, n_tokens,
    base (ids in earlier shards), doc_base, dtype."""
    spark = docs.sparkSession
    tokenizer = tokenizer or file_of("word_bpe_49k.json")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MOST_SHARDS, tasks_for(spark, total, shard_bytes))
    ends = spark.sparkContext.broadcast(range_ends(rows.select("doc_id"), n))  # 8 bytes for each shard

    def encoded(batches):
        e = encoder(tokenizer)
        kind, end = kind_of(e.tokenizer.get_vocab_size(), end_id), np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            packed = [np.frombuffer(x + end, dtype="<u4").astype(kind).tobytes() for x in e.encode_all(text for _, text in each_row(b))]
            spots = np.array([xxhash.xxh32_intdigest(x) for x in packed], dtype=np.int64)
            ids = b.column(0).fill_null(NO_ID).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(shards_of(ids, spots, ends.value).astype(np.int32)), pa.array(ids), pa.array(spots), pa.array(packed, pa.binary())], ["shard", "doc_id", "spot", "ids"])

    ids = rows.mapInArrow(encoded, "shard int, doc_id bigint, spot bigint, ids binary")
    ordered = ids.repartition(n, "shard").sortWithinPartitions("shard", "doc_id", "spot", "ids")

    def write(batches):
        store, top = _store(path)
        kind = kind_of(encoder(tokenizer).tokenizer.get_vocab_size(), end_id)
        for shard, part in groupby((row for b in batches for row in each_row(b)), key=lambda r: r[0]):
            ids, lengths, name = [], [], f"{top}/_tmp-{shard:05d}-{uuid.uuid4().hex}"
            with store.open_output_stream(f"{name}.bin") as out:
                for _, doc_id, _, packed in part:
                    out.write(packed)
                    ids.append(doc_id)
                    lengths.append(len(packed) // kind.itemsize)
            for end_of, values in (("idx", np.concatenate([[0], np.cumsum(lengths)])), ("doc", np.array(ids))):
                with store.open_output_stream(f"{name}.{end_of}") as out:
                    out.write(values.astype("<i8").tobytes())
            for end_of in ("bin", "idx", "doc"):
                store.move(f"{name}.{end_of}", f"{top}/{shard:05d}.{end_of}")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(ids)], "n_tokens": [int(sum(lengths))], "dtype": [kind.str]})

    store, top = _store(path)
    store.create_dir(top, recursive=True)
    shards = staged(ordered.mapInArrow(write, "shard bigint, n_docs bigint, n_tokens bigint, dtype string"), "shards")
    w = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    manifest = shards.withColumn("base", before("n_tokens")).withColumn("doc_base", before("n_docs"))
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def mapped(path: str, name: str, dtype: str) -> np.ndarray:
    """A file of the shards as an array: memory-mapped where the store is a mounted folder, else read."""
    store, top = _store(path)
    if store.type_name == "local":
        return np.memmap(f"{top}/{name}", dtype=dtype, mode="r")
    with store.open_input_file(f"{top}/{name}") as f:
        return np.frombuffer(f.read(), dtype=dtype)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and the ids)."""
    manifest = spark.read.parquet(f"{path}/manifest")

    def run(batches):
        for b in batches:
            for shard, base, dtype in zip(*(b.column(c).to_pylist() for c in ("shard", "base", "dtype"))):
                ids, at, doc = mapped(path, f"{shard:05d}.bin", dtype), mapped(path, f"{shard:05d}.idx", "<i8"), mapped(path, f"{shard:05d}.doc", "<i8")
                for k in range(0, len(doc), 1000):
                    each = [ids[at[i] : at[i + 1]].astype("<u4") for i in range(k, min(k + 1000, len(doc)))]
                    cols = {"doc_id": [None if d == NO_ID else int(d) for d in doc[k : k + 1000]], "start": [int(base + a) for a in at[k : k + len(each)]], "n_tokens": [len(x) for x in each], "ids_crc32": [crc32(x.tobytes()) for x in each]}
                    if with_ids:
                        cols["ids"] = [x.tolist() for x in each]
                    yield pa.RecordBatch.from_pydict(cols, schema=pa.schema([(c, pa.list_(pa.int64()) if c == "ids" else pa.int64()) for c in cols]))

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    n = max(1, manifest.count())
    return manifest.repartition(n, "shard").mapInArrow(run, schema)


def token_files(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write docs as token files and read them back.

    A null or empty text is its end id alone. Documents lie in ascending id, nulls first, repeated ids in the order of a
    hash of their token ids; equal rows are written as often as they come. A very long text is one row and lies in one
    shard. An empty table gives no shards and no rows. Other columns are ignored. One id that many rows share is spread by
    the hash unless the texts are equal too.
    """
    path = path or fresh_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, **options)
    return read_token_files(docs.sparkSession, path)
