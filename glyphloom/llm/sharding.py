"""Operator 2: jump consistent hashing of stable keys to shards, with a gapless slot in each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import copies_of, pieces_for, written

#: Rows that one task numbers, and rows that a group of equal rows is counted in, at most.
BLOCK_ROWS, PARTS = 50_000, 64


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The jump consistent hash of uint64 keys (Lamping and Veach, 2014): no table, and n + 1 shards move 1 / (n + 1) of the keys, all into the new one."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key, b, j = keys.astype(np.uint64).copy(), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        b[live] = j[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        j[live] = ((b[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        live = live[j[live] < shards]
    return b


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a long column; null is a key of its own."""

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return of(F.coalesce(F.xxhash64(key), F.lit(0)))


def shard(docs: DataFrame, shards: int = 16, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per row of docs (doc_id, text).

    doc_id and the number of shards alone decide the shard, so equal doc_ids share it. A null doc_id is one more key.
    A null text counts as empty: size 1, crc 0; texts may be of any length. Slots follow no order that means anything; repeated rows get slots of their own.
    Any shard, and any doc_id, may be large: rows that agree in doc_id, size and crc travel as one row with their number, these are numbered in
    hashed blocks of about block_rows, and a table of block sizes gives each block's first slot. The texts are read once.
    No rows give no rows. Other columns of docs are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # Equal rows are counted apart by where they were read, so that a group of any size is several rows.
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part")
    equal = rows.select("*", part).groupBy("doc_id", "size", "text_crc32", "part").agg(F.count("*").alias("many"))
    equal = written(equal.withColumns({"shard": jump_shard(F.col("doc_id"), shards), "grown_shard": jump_shard(F.col("doc_id"), shards + 1)}), "keys")
    blocks = pieces_for(equal.count(), block_rows * shards)
    dealt = equal.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "part"), F.lit(blocks)).cast("int"))
    ahead = lambda w, x: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = dealt.groupBy("shard", "block").agg(F.sum("many").alias("rows")).select("shard", "block", ahead(Window.partitionBy("shard").orderBy("block"), "rows").alias("first"))
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32", "part")
    placed = dealt.withColumn("before", ahead(within, "many")).join(first, ["shard", "block"]).withColumn("start", F.col("first") + F.col("before"))
    if equal.agg(F.max("many")).first()[0] not in (None, 1):
        placed = copies_of(written(placed, "slots"), "many", "nth")
    else:
        placed = placed.withColumn("nth", F.lit(0))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("nth")).alias("slot"), "grown_shard")
