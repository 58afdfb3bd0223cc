"""Sharding by jump consistent hashing.

A stable key and the number of shards decide a row's shard; there is no ring
table.  When a shard is appended, a row either stays or moves into the new one.
Texts never move: only keys, sizes and checksums are shuffled, to number slots.

A null key is one more key value (all such rows share a shard).  A null text
counts as empty; a very long one is only measured.  Repeat rows, and rows that tie in
id, size and checksum, share a shard and get slots of their own.  An empty table gives
no rows.  `assign` ignores extra columns; `write_shards` writes all, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .base import fresh, parts, table

ROW_BYTES = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The jump consistent hash of uint64 keys over a whole array at once."""
    key = keys.astype(np.uint64).copy()
    at, nxt = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = nxt[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        nxt[live] = ((at[live] + 1) * step).astype(np.int64)
        live = live[nxt[live] < shards]
    return at


def _jump_udf(shards: int):
    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy().view(np.uint64), shards).astype(np.int32))

    return shard


def shard_of(shards: int, *keys: str):
    """The shard of a row by its key columns."""
    return _jump_udf(shards)(F.xxhash64(*keys))


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df with a gapless number from 0 within each value of `group`.

    Each group is cut into blocks by a hash of the order columns; blocks are
    numbered on their own and shifted by the rows of the blocks before them, so
    no task holds a whole group."""
    blocks = max(16, parts(df.sparkSession))
    df = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = df.groupBy(group, "_block").count().select(group, "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    own = Window.partitionBy(group, "_block").orderBy(*order)
    df = df.withColumn("_at", F.row_number().over(own) - 1).join(shift, [group, "_block"])
    return df.withColumn(name, F.col("_at") + F.col("_shift")).drop("_block", "_at", "_shift")


def assign(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of docs."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("shard", shard_of(shards, "doc_id")).withColumn("grown_shard", shard_of(shards + 1, "doc_id"))
    rows = numbered(rows, "shard", ["doc_id", "text_crc32", "size"], "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int, *keys: str) -> None:
    """Writes docs as one folder per shard. Rows go to writers by shard and a
    salt, so a shard is written by several tasks and each task opens one folder. The
    folders are named by `shard`, or by shard_ where docs has a column of that name."""
    salt = F.pmod(F.xxhash64(*[f"`{c}`" for c in docs.columns]), F.lit(max(1, parts(docs.sparkSession) // shards + 1)))
    shard = fresh(docs.columns, "shard")
    part = fresh([*docs.columns, shard], "salt")
    out = docs.withColumn(shard, shard_of(shards, *keys)).withColumn(part, salt)
    out.repartition(shard, part).drop(part).write.partitionBy(shard).mode("overwrite").parquet(path)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"), 40)
