"""Embedding tables: rows whose vector can take part, and vectors as numpy blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors handled by one numpy pass.
BLOCK_ROWS = 2048


def finite_rows(df: DataFrame, id_col: str, vector_col: str, nonzero: bool = False) -> tuple[DataFrame, int]:
    """(id, vector) of the rows whose vector is neither null nor empty and has finite entries only, and its length.

    Vectors of one length take part: the commonest, of equally common ones the
    longest; the length is 0 where there is no such row. ``nonzero`` leaves out zero vectors.
    """
    v = F.col(vector_col)
    number = lambda c: c.cast("double")
    good = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(number(c)) & (F.abs(number(c)) != float("inf")))
    if nonzero:
        good = good & F.exists(v, lambda c: c != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where(F.coalesce(good, F.lit(False)) & (F.size("vector") > 0))
    most = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    width = most["d"] if most else 0
    rows = rows.where(F.size("vector") == width)
    if rows.schema["vector"].dataType.simpleString() != "array<float>":  # floats stay as they are: half the bytes
        rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    return rows, width


def blocks(column: pa.Array, width: int, rows: int = BLOCK_ROWS):
    """(first row, rows x width doubles) for bounded runs of a column of equally long vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)
    for lo in range(0, len(flat), rows):
        yield lo, flat[lo : lo + rows]


def vector_array(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).ravel()))
