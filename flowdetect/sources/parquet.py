"""Flow tables in Parquet, partitioned by day.

Reading the XML once and keeping the rows as Parquet partitioned by ``day``
means every later step prunes to its day directories and reads only the
columns it needs; it also cuts the lineage back to the XML, so a lost
executor recomputes from Parquet rather than re-parsing text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowdetect.schema import DAY_COL
from flowdetect.session import unsorted_folders


def write_flows_by_day(
    flows: DataFrame,
    path: str,
    *,
    mode: str = "errorifexists",
    max_records_per_file: int = 5_000_000,
) -> str:
    """Write ``flows`` partitioned by day.

    Every task writes its own rows per day, one open file a day and unsorted, so no
    shuffle is needed, a large day does not land on one task and no task holds its rows;
    ``maxRecordsPerFile`` bounds file size.
    """
    with unsorted_folders(flows.sparkSession):
        (
            flows.write.mode(mode)
            .option("maxRecordsPerFile", max_records_per_file)
            .partitionBy(DAY_COL)
            .parquet(path)
        )
    return path


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """Read a day-partitioned flow table; ``day`` comes from the folder names."""
    return spark.read.option("basePath", path).parquet(path)
