"""Driver-side reads of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row


def collect_bounded(df: DataFrame, max_rows: int) -> list[Row] | None:
    """The rows of ``df`` if there are at most ``max_rows`` of them, else None.

    Only ``max_rows + 1`` rows ever reach the driver.
    """
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None
