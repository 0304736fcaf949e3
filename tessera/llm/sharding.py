"""Operator 7: sharding by jump consistent hashing.

The shard of a row depends on its id and the number of shards alone, without any table of
ring positions; with one more shard a row either stays or moves into the new shard. The id
itself is the 64-bit key (the method's linear congruential steps do the mixing).

Slots number the rows of a shard without gaps. They follow a range partitioning that is
written once with its partition number, so an offset per (shard, partition) - as many rows
as shards times partitions - makes local numbers global and no shard meets in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.common import materialise, parallelism, prepare

SHARDS = 16
STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key; all keys take their jumps together."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    at = np.full(len(key), -1, np.int64)
    to = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = to[live]
        key[live] = key[live] * STEP + np.uint64(1)
        draw = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
        to[live] = ((at[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[to[live] < shards]
    return at


def jump_shard(shards: int):
    """Column function: long key -> shard. A null key counts as zero."""
    @F.pandas_udf("int")
    def shard(key: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(key.fillna(0).to_numpy(dtype=np.int64), shards), dtype="int32")

    return shard


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    ``size`` is the text's UTF-8 bytes plus one (null: one), ``text_crc32`` the unsigned crc32 of
    the text (null: that of the empty text), ``slot`` counts the shard's rows from 0 in the order of id, crc32 and
    size, ``grown_shard`` is the shard among one more. Rows with a null id go where id 0 goes.
    Repeated rows get a slot each. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark, 50_000)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                         F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("_row"))
    order = ["doc_id", "text_crc32", "size", "_row"]
    ranged = narrow.repartitionByRange(parallelism(spark), *order).withColumn("_part", F.spark_partition_id())
    marked = materialise(ranged.select("*", jump_shard(shards)(F.coalesce("doc_id", F.lit(0))).alias("shard"),
                                       jump_shard(shards + 1)(F.coalesce("doc_id", F.lit(0))).alias("grown_shard")), "shards")
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = marked.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy("shard", "_part").orderBy(*order))
    return marked.withColumn("_local", local).join(offsets, ["shard", "_part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_offset") + F.col("_local") - 1).cast("long").alias("slot"), "grown_shard")

