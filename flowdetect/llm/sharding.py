"""Sharding by jump consistent hashing (operator 2).

A row's shard depends on its key and the number of shards alone. Going from n
to n + 1 shards moves a row only into the new shard, and about 1 / (n + 1) of
the rows move. No ring or table of ranges is kept.

Defined cases: a null text has size 8 and the checksum of the empty text; rows
with a null key share one fixed key, so one shard; repeated rows share their
shard and get slots of their own; an empty table gives an empty result. Extra
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowdetect.llm.blocks import numbered
from flowdetect.llm.common import crc32_long, mix

SHARDS = 24
#: Bytes that a row takes besides its text.
ROW_BYTES = 8


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each uint64 key: jump ahead to the next shard count at which the key moves, until past ``shards``."""
    key = keys.copy()
    shard = np.zeros(len(key), dtype=np.int64)
    left = np.arange(len(key))
    jump = np.zeros(len(key), dtype=np.int64)
    while len(left):
        shard[left] = jump
        key = key * np.uint64(2862933555777941757) + np.uint64(1)
        draw = ((key >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        jump = ((shard[left] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        more = jump < shards
        left, key, jump = left[more], key[more], jump[more]
    return shard


def shard_of(key: str, shards: int):
    """Column: the shard (0 .. shards - 1) of an integer key column; null keys share one shard."""

    @F.pandas_udf("int")
    def assign(values: pd.Series, null: pd.Series) -> pd.Series:
        marked = values.to_numpy(dtype=np.int64).view(np.uint64) ^ (null.to_numpy(dtype=np.uint64) * np.uint64(0xA5A5A5A5A5A5A5A5))
        return pd.Series(jump_hash(mix(marked), shards).astype(np.int32))

    column = F.col(key).cast("long")
    return assign(F.coalesce(column, F.lit(0)), column.isNull())


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard, slot and grown_shard (the shard with one more shard) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        crc32_long(text).alias("text_crc32"),
    )
    placed = sized.withColumn("shard", shard_of("doc_id", shards)).withColumn("grown_shard", shard_of("doc_id", shards + 1))
    return numbered(placed, "shard", "slot", "shards", order=["doc_id", "text_crc32"])


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id") -> None:
    """Write every column of ``docs`` under ``path``, one folder ``shard=k`` per shard (no shuffle)."""
    (
        docs.withColumn("shard", shard_of(id_col, shards))
        .write.partitionBy("shard").option("maxRecordsPerFile", 1_000_000).parquet(path)
    )
