"""The batch operators on a stream of flow files.

New day files (Parquet with the flow schema, as written by the ingest step)
are picked up as they arrive; the tag counts are a streaming aggregation with
state per (day, Tag), and a forest fitted in batch scores each micro-batch.
No new operator: the same expressions and the same fitted models.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from flowdetect.operators.coarsen import prepare_flows
from flowdetect.operators.forest import PREDICTED_LABEL_COL, PREDICTION_COL
from flowdetect.operators.prepare import Preparation
from flowdetect.operators.stats import tag_counts
from flowdetect.schema import DAY_COL, LABEL_COL


def read_flow_stream(
    spark: SparkSession, path: str, schema: T.StructType, *, max_files_per_trigger: int | None = None
) -> DataFrame:
    """A streaming DataFrame over Parquet flow files arriving under ``path``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def stream_tag_counts(stream: DataFrame) -> DataFrame:
    """Rows per tag and day, kept up to date (output mode ``update`` or ``complete``)."""
    return tag_counts(stream)


def score_stream(stream: DataFrame, preparation: Preparation, forest: PipelineModel) -> DataFrame:
    """Coarsen, prepare and score each arriving flow with models fitted in batch.

    A preparation fitted with ``handle_invalid="error"`` stops the stream at
    the first text value it has not seen; for open-ended streams fit it with
    ``"keep"`` (as ``fit_on="train"`` does), which gives unseen values an
    index of their own.
    """
    prepared = preparation.transform(prepare_flows(stream))
    scored = forest.transform(prepared)
    keys = [c for c in ("event_id", DAY_COL) if c in scored.columns]
    return scored.select(*keys, LABEL_COL, PREDICTION_COL, PREDICTED_LABEL_COL)
