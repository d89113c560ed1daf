"""Frequency indices as a table (F1, F2), for columns with more values than a driver should hold.

``StringIndexer`` keeps every value on the driver. Here the ranks of all columns are one
written table (col, value, n, idx): counts are aggregated in the tasks, sorted by
(column, most frequent first, value) over range partitions, and numbered by file:
a file's first number is the count of the rows before it, so no task and no
driver holds a column. Rows get their indices by a join on (column, value).
The driver holds a path.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowdetect.operators.prepare import index_col
from flowdetect.session import scratch_path

#: Values of a column, from the most frequent on, that travel to the tasks of ``encode``; a value that would
#: make a join partition hot is among them.
HOT_VALUES = 10_000

SCHEMA = "col string, value string, n long, idx double"


@dataclass
class IndexTable:
    """The written ranks: most frequent first, ties by value, from 0 in each column."""

    spark: SparkSession
    path: str
    cols: list[str]

    def table(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def encode(self, df: DataFrame, hot_values: int = HOT_VALUES) -> DataFrame:
        """``df`` with ``<c>_index`` for every column; a value that the fit did not see (or null) has a null index.

        Frequent values (at most ``hot_values`` a column) are broadcast, so a hot value never lands in one
        task; only rows with other values are joined by shuffle, a column at a time.
        """
        ranks = self.table()
        for c in self.cols:
            mine = ranks.where(F.col("col") == c)
            hot = mine.where(F.col("idx") < hot_values).select(F.col("value").alias("_hot"), F.col("idx").alias("_hot_idx"))
            cold = mine.where(F.col("idx") >= hot_values).select(F.col("value").alias("_cold"), F.col("idx").alias("_cold_idx"))
            df = df.join(F.broadcast(hot), F.col(c) == F.col("_hot"), "left")
            rest = F.when(F.col("_hot_idx").isNull(), F.col(c))
            # rows that are done get a key of their own each, which meets nothing
            df = df.withColumn("_key", F.coalesce(F.concat(F.lit("="), rest), F.concat(F.lit("!"), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)).cast("string"))))
            cold = cold.withColumn("_cold", F.concat(F.lit("="), F.col("_cold")))
            df = df.join(cold, F.col("_key") == F.col("_cold"), "left")
            df = df.withColumn(index_col(c), F.coalesce("_hot_idx", "_cold_idx")).drop("_hot", "_hot_idx", "_key", "_cold", "_cold_idx")
        return df


def fit_index_table(df: DataFrame, cols: Sequence[str]) -> IndexTable:
    """Rank the values of some text columns by frequency (nulls aside)."""
    spark = df.sparkSession
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("value")) for c in cols])).alias("c")
    counts = df.select(cells).select("c.*").where("value is not null").groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))
    sorted_path, path = scratch_path(spark, "ranked-values"), scratch_path(spark, "index-table")
    order = [F.col("col"), F.col("n").desc(), F.col("value")]
    counts.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(sorted_path)
    rows = spark.read.schema("col string, value string, n long").parquet(sorted_path)
    rows = rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    # a column's rows stand together in each file; files are named in the order of their ranges
    parts = rows.groupBy("col", "file").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("first"))
    before = Window.partitionBy("col").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one short row a file
    starts = parts.select("col", "file", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    numbered = rows.join(starts, ["col", "file"])
    numbered.select("col", "value", "n", (F.col("start") + F.col("row") - F.col("first")).cast("double").alias("idx")).write.parquet(path)
    return IndexTable(spark, path, list(cols))
