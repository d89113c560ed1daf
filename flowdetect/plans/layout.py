"""Partition layout of the forest's input.

Spark's forest draws its bootstrap per partition in row order, and every tree
level sends one split histogram per partition and node. Rows are therefore
always placed by a hash of their key into buckets, one partition each, and
sorted by the key inside: the same rows and seed give the same forest from any input
layout, on any number of cores or executors, after any recomputation. How many
buckets there are follows from the number of rows alone: a power of two, so
that a bucket holds at most ``BUCKET_ROWS`` rows, between ``FOREST_PARTITIONS``
and ``MAX_BUCKETS`` (beyond it, buckets grow: each sends its own histograms). A
caller may name another number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewest and most buckets of the forest's input, and the rows that one may hold before there are more.
FOREST_PARTITIONS, MAX_BUCKETS = 8, 16_384
BUCKET_ROWS = 250_000


def forest_buckets(rows: int) -> int:
    """Buckets for that many rows: 8, doubled until a bucket holds at most ``BUCKET_ROWS`` of them."""
    buckets = FOREST_PARTITIONS
    while buckets < MAX_BUCKETS and rows > buckets * BUCKET_ROWS:
        buckets *= 2
    return buckets


def place_by_key(df: DataFrame, keys: Sequence[str] = ("event_id",), partitions: int = FOREST_PARTITIONS) -> DataFrame:
    """``df`` in ``partitions`` hash partitions, each sorted, by the key columns that it has.

    Without a key, a hash of the whole row stands in for one (identical rows
    may trade places, which changes nothing downstream).
    """
    present = [k for k in keys if k in df.columns]
    if present:
        return df.repartition(partitions, *present).sortWithinPartitions(*present)
    h = "_row_hash"
    hashed = df.withColumn(h, F.xxhash64(*[F.col(c) for c in df.columns]))
    return hashed.repartition(partitions, h).sortWithinPartitions(h).drop(h)
