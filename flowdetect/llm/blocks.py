"""Gapless numbering without a sort of the whole group.

Rows of a written table are numbered by (file, block of rows): the count of
each group in each block is one small row, running sums over the blocks give
each block its first number, and inside a block the rows are counted. No task
holds more than one block, however large a group is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowdetect.llm.common import stored

BLOCK_ROWS = 50_000
#: Blocks whose counts are summed by one task of the running sum's lower level.
BLOCKS_PER_RUN = 2_000


def numbered(df: DataFrame, group: str, out: str, name: str, order: list[str] | None = None) -> DataFrame:
    """``df`` written once, with ``out``: a gapless number from 0 inside each value of ``group``.

    ``group`` must not be null. The numbers depend on the written file order,
    which is fixed once the table is written, so a recomputed task agrees.
    """
    keep = df.columns
    table = stored(df, name).select(
        *keep,
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    ).withColumn("_block", F.floor(F.col("_row") / BLOCK_ROWS).cast("long"))
    counts = stored(table.groupBy(group, "_file", "_block").agg(F.count(F.lit(1)).alias("_n")), f"{name}-counts")
    starts = block_starts(counts, group)
    inside = Window.partitionBy(group, "_file", "_block").orderBy(*(order or []), "_row")
    ranked = table.withColumn("_inside", (F.row_number().over(inside) - 1).cast("long"))
    return (
        ranked.join(starts.hint("merge"), [group, "_file", "_block"])  # it grows with the rows: no broadcast
        .withColumn(out, F.col("_start") + F.col("_inside"))
        .select(*keep, out)
    )


def block_starts(counts: DataFrame, group: str) -> DataFrame:
    """First number of each (group, file, block): running sums in two levels, by file and across files."""
    runs = counts.withColumn("_run", F.pmod(F.xxhash64("_file"), F.lit(BLOCKS_PER_RUN)))
    by_run = runs.groupBy(group, "_run").agg(F.sum("_n").alias("_n"))
    before_run = Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    run_start = by_run.select(group, "_run", F.coalesce(F.sum("_n").over(before_run), F.lit(0)).alias("_run_start"))
    before = Window.partitionBy(group, "_run").orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    return (
        runs.withColumn("_in_run", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .join(run_start.hint("merge"), [group, "_run"])
        .select(group, "_file", "_block", (F.col("_run_start") + F.col("_in_run")).alias("_start"))
    )
