"""Train/test split.

The default split is a hash of a row key: a row's side depends on its key
only, not on partitioning, task order or a re-run after a lost executor, and
needs no sort. The first 8 hex digits of ``md5(key)`` are compared with
``fraction * 2^32`` written the same way, so the train share is ``fraction``
to within 2^-32, and the rule reads the same in SQL.

Without a key column the key is the row's own content (JSON of its flow
columns), so identical rows fall on the same side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowdetect.schema import FLOW_COLS, TRAIN_FRACTION

PART_COL = "part"
TRAIN = "train"
TEST = "test"


def split_threshold(fraction: float) -> str:
    """``fraction`` of the 32-bit range as 8 lowercase hex digits (0.7 -> b3333333)."""
    if not 0.0 < fraction < 1.0:
        raise ValueError("train fraction must be strictly between 0 and 1")
    return format(round(fraction * 2**32), "08x")


def _key_expr(df: DataFrame, key: str | None, salt: str) -> Column:
    if key and key in df.columns:
        text = F.col(key).cast("string")
    else:
        text = F.to_json(F.struct(*[c for c in FLOW_COLS if c in df.columns]))
    if salt:
        text = F.concat(F.lit(f"{salt}:"), text)
    return text


def split_part(
    df: DataFrame, *, key: str | None = "event_id", fraction: float = TRAIN_FRACTION, salt: str = ""
) -> Column:
    bucket = F.substring(F.md5(_key_expr(df, key, salt)), 1, 8)
    return F.when(bucket < F.lit(split_threshold(fraction)), F.lit(TRAIN)).otherwise(F.lit(TEST))


def with_split(
    df: DataFrame, *, key: str | None = "event_id", fraction: float = TRAIN_FRACTION, salt: str = ""
) -> DataFrame:
    """``df`` with a ``part`` column, ``train`` or ``test``."""
    return df.withColumn(PART_COL, split_part(df, key=key, fraction=fraction, salt=salt))


def split_by_key(
    df: DataFrame, *, key: str | None = "event_id", fraction: float = TRAIN_FRACTION, salt: str = ""
) -> tuple[DataFrame, DataFrame]:
    marked = with_split(df, key=key, fraction=fraction, salt=salt)
    return (
        marked.where(F.col(PART_COL) == TRAIN).drop(PART_COL),
        marked.where(F.col(PART_COL) == TEST).drop(PART_COL),
    )


def random_split(df: DataFrame, weights: Sequence[float] = (0.7, 0.3), seed: int = 42) -> list[DataFrame]:
    """Spark's seeded ``randomSplit``: Bernoulli sampling per partition.

    Stable only for the same input partitioning; Spark sorts each partition
    to keep the parts disjoint on recomputation.
    """
    return df.randomSplit(list(weights), seed)
