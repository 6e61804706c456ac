"""Jump consistent hashing: stable keys to shards without a ring table.

Each row's shard follows from its key and the number of shards alone. Going from n to n + 1 shards moves a
row only into the new shard, about 1 / (n + 1) of all rows. Slots number the rows of a shard from 0 without
gaps: a task counts its own rows by shard, and the small table of counts gives each task its first slot, so no
shard is ever gathered in one task.

Defined cases: a null key is the key 0 for integers and the empty string otherwise, so it has a shard; a null
text has size 1 and the CRC of no bytes; repeated rows share their shard and have slots of their own; an empty
table gives no rows; input columns named like an output (or `_part`, `_nth`) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import small, table, written

SHARDS = 8
_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Lamping and Veach's jump hash of 64-bit keys, all keys at once."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    key = keys.astype(np.uint64).copy()
    bucket = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    jump = np.zeros(len(key), np.int64)
    while len(live):
        bucket[live] = jump
        key[live] = key[live] * _STEP + np.uint64(1)
        scale = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
        jump = np.floor((bucket[live] + 1) * (float(1 << 31) / scale)).astype(np.int64)
        go = jump < shards
        live, jump = live[go], jump[go]
    return bucket


def _placer(shards: int, schema_names: list[str]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        used = np.zeros(shards, np.int64)
        for b in batches:
            keys = b.column("_key").to_numpy(zero_copy_only=False).view(np.uint64)
            shard = jump_hash(keys, shards)
            grown = jump_hash(keys, shards + 1)
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=shards)
            nth = np.empty(len(shard), np.int64)
            nth[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts, counts)
            nth += used[shard]
            used += counts
            kept = [b.column(n) for n in schema_names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(shard, pa.int32()), pa.array(grown, pa.int32()), pa.array(np.full(len(shard), part), pa.int64()), pa.array(nth)],
                [*schema_names, "shard", "grown_shard", "_part", "_nth"],
            )

    return place


def shard_rows(df: DataFrame, key: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """df with shard, grown_shard (with one shard more) and slot. Python sees what df holds, so narrow df first."""
    df = df.drop("shard", "grown_shard", "slot", "_part", "_nth", "_key")
    c = F.col(key)
    whole = isinstance(df.schema[key].dataType, T.IntegralType)
    keyed = df.withColumn("_key", F.coalesce(c.cast("long"), F.lit(0)) if whole else F.xxhash64(F.coalesce(c.cast("string"), F.lit(""))))
    schema = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("grown_shard", T.IntegerType()), T.StructField("_part", T.LongType()), T.StructField("_nth", T.LongType())])
    placed = written(keyed.mapInArrow(_placer(shards, df.columns), schema), "placed")
    counts = placed.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    first = counts.withColumn("_first", F.sum("_n").over(W.partitionBy("shard").orderBy("_part")) - F.col("_n")).drop("_n")
    return placed.join(small(first), ["shard", "_part"]).withColumn("slot", F.col("_first") + F.col("_nth")).drop("_first", "_part", "_nth")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int = SHARDS) -> None:
    """The rows as Parquet folders shard=0 .. shard=n-1 below path, several files a shard."""
    shard_rows(df, key, shards).drop("grown_shard", "slot").write.partitionBy("shard").parquet(path)


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_rows(narrow).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _oracle() -> str:
    """Slots by the table's order, which is the ids' order where one task reads it. Keys are unsigned 64-bit numbers."""
    crc = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        crc.append(n)
    steps = "[" + ", ".join(f"{n}::UINTEGER" for n in crc) + "]"
    digit = "CAST(instr('0123456789ABCDEF', substr(h, {}, 1)) - 1 AS UINTEGER)"
    hashed = "(key * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT"
    return f"""
WITH RECURSIVE j AS (
  SELECT doc_id, n, CAST(doc_id AS UHUGEINT) AS key, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM documents, (VALUES ({SHARDS}), ({SHARDS + 1})) v(n)
  UNION ALL
  SELECT doc_id, n, k, j, CAST(floor((j + 1) * (CAST(2147483648 AS DOUBLE) / (CAST(k // 8589934592::UHUGEINT AS DOUBLE) + 1))) AS BIGINT) FROM (SELECT doc_id, n, j, {hashed} AS k FROM j WHERE j < n)),
s AS (SELECT doc_id, max(b) FILTER (WHERE n = {SHARDS}) AS shard, max(b) FILTER (WHERE n = {SHARDS + 1}) AS grown_shard FROM j WHERE j >= n GROUP BY doc_id),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size FROM documents),
l AS (SELECT doc_id, size, list_transform(generate_series(1, length(h) // 2), lambda i: {digit.format("2 * i - 1")} * 16 + {digit.format("2 * i")}) AS bytes FROM h)
SELECT doc_id, size, CAST(xor(list_reduce(list_prepend(4294967295::UINTEGER, list_transform(bytes, lambda x: x::UINTEGER)), lambda a, x: xor(a >> 8, list_extract({steps}, (xor(a, x) & 255) + 1))), 4294967295::UINTEGER) AS BIGINT) AS text_crc32,
  'key' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(grown_shard AS INT) AS grown_shard
FROM l JOIN s USING (doc_id)
"""


ORACLE = _oracle()
