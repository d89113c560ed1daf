"""CSV sink for the prepared table (S5), with a header line, one folder per day.

Spark's CSV writer takes no vector columns, so each vector is written as the
text of its array (``[1.0, 0.0, 80.0]``). With default options an empty
string is written as ``""`` and a null as nothing, but both read back as
null; with ``null_value`` set (say ``\\N``) on both the writer and the
reader, empty text and null stay apart.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdetect.schema import DAY_COL
from flowdetect.session import unsorted_folders


def csv_ready(df: DataFrame) -> DataFrame:
    """Cast vector columns to text; other columns pass through."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, VectorUDT):
            out.append(vector_to_array(F.col(f.name)).cast("string").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def write_prepared_csv(
    prepared: DataFrame,
    path: str,
    *,
    mode: str = "errorifexists",
    by_day: bool = True,
    null_value: str | None = None,
) -> str:
    """Write under ``path``, one ``day=<day>`` folder per day.

    No task sorts its rows by day: it keeps one file a day open, so its memory does not grow with its rows.
    With ``by_day=False`` the ``day`` column is dropped and ``path`` itself is
    meant to be one day's folder (``<base>/day=<day>``), so each day is its
    own write and days can be written independently, even at the same time.
    """
    if not by_day:
        prepared = prepared.drop(DAY_COL)
    writer = csv_ready(prepared).write.mode(mode).option("header", True)
    if null_value is not None:
        writer = writer.option("nullValue", null_value)
    if DAY_COL in prepared.columns:
        writer = writer.partitionBy(DAY_COL)
    with unsorted_folders(prepared.sparkSession):
        writer.csv(path)
    return path


def csv_schema_of(prepared: DataFrame) -> T.StructType:
    """The schema to read a written table back with (vectors as text, day last)."""
    fields = [
        T.StructField(f.name, T.StringType() if isinstance(f.dataType, VectorUDT) else f.dataType, True)
        for f in prepared.schema.fields
        if f.name != DAY_COL
    ]
    if DAY_COL in prepared.columns:
        fields.append(T.StructField(DAY_COL, T.StringType(), True))
    return T.StructType(fields)


def read_prepared_csv(
    spark: SparkSession, path: str, schema: T.StructType, *, null_value: str | None = None
) -> DataFrame:
    reader = spark.read.option("header", True).schema(schema)
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    return reader.csv(path)
