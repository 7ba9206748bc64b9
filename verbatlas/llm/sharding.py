"""Sharding by jump consistent hashing.

The shard of a row follows from its stable key and the number of shards alone (law `key`): no table of
ring positions is kept, and when a shard is appended, rows move only into it, in the necessary share.
Equal texts are no group under this law; rows of one key always share a shard.

Slots number the rows of a shard from 0 without gaps, in the order of key, size and CRC. No shard is
gathered in one task: rows are cut into ranges of that order, these blocks count their rows by shard,
running sums of the counts give each block's first slot, and each block numbers its own rows.

Defined cases: a null key counts as the key 0 with another salt; null text has size 8 and the CRC of no
bytes, 0; rows with one key (repeated rows too) share a shard and get slots of their own; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from verbatlas.session import ship, stash, table

SHARDS = 24
#: Rows of a block, about.
BLOCK_ROWS = 65_536


def mixed(keys: np.ndarray, salt: int = 0) -> np.ndarray:
    """Well spread unsigned 64-bit values of integer keys."""
    z = keys.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def jump(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of each unsigned 64-bit value: a shard from 0 to shards - 1.

    A value jumps to ever larger shards by draws of its own generator and stays at the last one
    below the count; a larger count thus only adds later jumps.
    """
    if shards < 1:
        raise ValueError("there must be one shard at least")
    state = hashes.astype(np.uint64).copy()
    at = np.zeros(len(state), np.int64)
    to = np.zeros(len(state), np.int64)
    open_ = np.arange(len(state))
    while len(open_):
        at[open_] = to[open_]
        s = state[open_] * np.uint64(2862933555777941757) + np.uint64(1)
        state[open_] = s
        draw = (s >> np.uint64(33)).astype(np.float64) + 1.0
        to[open_] = np.floor((at[open_] + 1) * (2147483648.0 / draw)).astype(np.int64)
        open_ = open_[to[open_] < shards]
    return at.astype(np.int32)


def placed(df: DataFrame, key_col: str, counts: dict[str, int]) -> DataFrame:
    """df with a column for each of counts: the shard of the integer key among that many shards."""
    ship(df.sparkSession)
    extra = list(counts)
    names = df.columns
    at = names.index(key_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            keys = mixed(column.fill_null(0).to_numpy(zero_copy_only=False))
            gone = column.is_null().to_numpy(zero_copy_only=False)
            keys[gone] = mixed(np.zeros(1, np.int64), 1)[0]
            made = [pa.array(jump(keys, counts[c])) for c in extra]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, *extra])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{c}` int" for c in extra]
    return df.mapInArrow(work, ", ".join(fields))


def with_slots(df: DataFrame, shard_col: str = "shard", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df (narrow: it is written once) with slot, the number of each row in its shard, from 0 without gaps.

    Slots follow the order of df's columns, first to last. Blocks are ranges of that order; equal rows are
    told apart by their place, so that many of them make many blocks.
    """
    own = df.columns
    rows = stash(df.withColumn("_at", F.monotonically_increasing_id()))
    blocks = max(1, -(-rows.count() // block_rows))
    rows = stash(rows.repartitionByRange(blocks, *own, "_at").withColumn("_block", F.spark_partition_id()))
    first = (
        rows.groupBy(shard_col, "_block")
        .agg(F.count("*").alias("_n"))
        .withColumn("_first", F.sum("_n").over(W.partitionBy(shard_col).orderBy("_block")) - F.col("_n"))
        .drop("_n")
    )
    number = F.row_number().over(W.partitionBy(shard_col, "_block").orderBy(*own, "_at")) - 1
    return rows.withColumn("_own", number).join(first, [shard_col, "_block"]).select(*own, (F.col("_first") + F.col("_own")).cast("long").alias("slot"))


def shard(docs: DataFrame, shards: int = SHARDS, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard (with one shard more) of each row."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(key_col).cast("long").alias(key_col), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32")
    )
    out = with_slots(placed(narrow, key_col, {"shard": shards, "grown_shard": shards + 1}))
    return out.select(key_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The law and the numbers in SQL: 64-bit products by 128-bit integers, the CRC byte by byte, jumps by recursion."""
    low = lambda x: f"CAST(({x}) % 18446744073709551616::UHUGEINT AS UBIGINT)"
    times = lambda x, m: low(f"CAST({x} AS UHUGEINT) * {m}::UHUGEINT")
    step = low("CAST(s AS UHUGEINT) * 2862933555777941757::UHUGEINT + 1::UHUGEINT")
    to = "CAST(floor((place + 1) * (2147483648.0 / CAST((s >> 33) + 1 AS DOUBLE))) AS BIGINT)"

    def jump(name: str, shards: int) -> str:
        return f"""
{name}_j(h, s, place, hop) AS (
  SELECT h, {step.replace('(s AS', '(h AS')}, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM hs
  UNION ALL SELECT h, {step}, {to}, hop + 1 FROM {name}_j WHERE {to} < {shards}),
{name} AS (SELECT h, CAST(arg_max(place, hop) AS INT) AS shard FROM {name}_j GROUP BY h)"""

    return f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, x)) AS t),
d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (
  SELECT rid, doc_id, length(x) // 2 + 8 AS size,
    xor(4294967295, list_reduce(list_transform(regexp_extract_all(x, '..'), lambda p: 16 * (unicode(p) - CASE WHEN unicode(p) > 64 THEN 55 ELSE 48 END) + unicode(right(p, 1)) - CASE WHEN unicode(right(p, 1)) > 64 THEN 55 ELSE 48 END), lambda a, b: xor(t[1 + (xor(a, b) & 255)], a >> 8), 4294967295)) AS crc
  FROM d, tab),
z0 AS (SELECT *, {low("CASE WHEN doc_id IS NULL THEN 0::UHUGEINT ELSE CAST((CAST(doc_id AS HUGEINT) + 18446744073709551616) % 18446744073709551616 AS UHUGEINT) END + CASE WHEN doc_id IS NULL THEN 4354685564936845354 ELSE 11400714819323198485 END::UHUGEINT")} AS z FROM c),
z1 AS (SELECT * EXCLUDE (z), {times('xor(z, z >> 30)', 0xBF58476D1CE4E5B9)} AS z FROM z0),
z2 AS (SELECT * EXCLUDE (z), {times('xor(z, z >> 27)', 0x94D049BB133111EB)} AS z FROM z1),
k AS (SELECT rid, doc_id, CAST(size AS BIGINT) AS size, CAST(CASE WHEN size = 8 THEN 0 ELSE crc END AS BIGINT) AS text_crc32, xor(z, z >> 31) AS h FROM z2),
hs AS (SELECT DISTINCT h FROM k),{jump('a', SHARDS)},{jump('b', SHARDS + 1)}
SELECT doc_id, size, text_crc32, 'key' AS law, a.shard, CAST(row_number() OVER (PARTITION BY a.shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS BIGINT) AS slot, b.shard AS grown_shard
FROM k JOIN a ON k.h = a.h JOIN b ON k.h = b.h
"""


QUERIES = {"op4_sharding": op4_sharding}
ORACLE_SQL = {"op4_sharding": _oracle()}
