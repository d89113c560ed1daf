"""Flow statistics per day and tag.

One scan and one aggregation on (day, Tag) with map-side partial counts: the
shuffle carries at most (tasks x days x tags) rows whatever the input size.
The share per day is computed from the aggregated rows only: a day's tag
rows are gathered as an array (one entry per tag), totalled, and unfolded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowdetect.schema import DAY_COL, LABEL_COL


def flow_count(flows: DataFrame) -> DataFrame:
    """Number of flows per day (A1)."""
    return flows.groupBy(DAY_COL).agg(F.count(F.lit(1)).alias("flows"))


def tag_counts(flows: DataFrame, label_col: str = LABEL_COL) -> DataFrame:
    """Rows per tag and day (A2); ``count(Tag)``, so a null-tag group counts 0."""
    return flows.groupBy(DAY_COL, label_col).agg(F.count(label_col).alias("count"))


def _per_day(grouped: DataFrame, label_col: str, fields: list[str]) -> DataFrame:
    """Each day's (tag, counts) rows as one array: a day has one entry per tag."""
    return grouped.groupBy(DAY_COL).agg(F.collect_list(F.struct(label_col, *fields)).alias("items"))


def _sum_of(field: str) -> Column:
    return F.aggregate(F.col("items"), F.lit(0).cast("bigint"), lambda acc, x: acc + x[field])


def tag_share(flows: DataFrame, label_col: str = LABEL_COL) -> DataFrame:
    """Tag counts with each tag's share of the day's tagged flows (A3).

    The day's total is taken over that day's aggregated tag rows (gathered as
    an array), so no window partitions rows by day.
    """
    days = _per_day(tag_counts(flows, label_col), label_col, ["count"])
    rows = days.select(DAY_COL, _sum_of("count").alias("_tagged"), F.explode("items").alias("x"))
    return rows.select(
        DAY_COL,
        F.col("x")[label_col].alias(label_col),
        F.col("x.count").alias("count"),
        (F.col("x.count") / F.nullif(F.col("_tagged"), F.lit(0))).cast("double").alias("share"),
    )


def flow_stats(flows: DataFrame, label_col: str = LABEL_COL) -> DataFrame:
    """The statistics program (W1): per day and tag the count, the day's flows, the share."""
    grouped = flows.groupBy(DAY_COL, label_col).agg(
        F.count(label_col).alias("count"), F.count(F.lit(1)).alias("_rows")
    )
    days = _per_day(grouped, label_col, ["count", "_rows"])
    rows = days.select(
        DAY_COL, _sum_of("_rows").alias("flows"), _sum_of("count").alias("_tagged"), F.explode("items").alias("x")
    )
    return rows.select(
        DAY_COL,
        F.col("x")[label_col].alias(label_col),
        F.col("x.count").alias("count"),
        "flows",
        (F.col("x.count") / F.nullif(F.col("_tagged"), F.lit(0))).cast("double").alias("share"),
    )
