"""Prediction quality (E1, A6) as grouped aggregations over scored rows.

Accuracy is the share of rows whose prediction equals the label, which is
what Spark's ``MulticlassClassificationEvaluator(metricName="accuracy")``
reports; the test error is one minus it. Both are partial aggregations per
group, so a scored table of any size reduces to one row per day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowdetect.schema import DAY_COL


def accuracy(
    scored: DataFrame, label_col: str, prediction_col: str, by: Sequence[str] = (DAY_COL,)
) -> DataFrame:
    """(by..., n, accuracy, test_error)."""
    hit = F.avg((F.col(prediction_col) == F.col(label_col)).cast("double"))
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), hit.alias("accuracy"), (F.lit(1.0) - hit).alias("test_error")
    )


def confusion(
    scored: DataFrame, label_col: str, prediction_col: str, by: Sequence[str] = (DAY_COL,)
) -> DataFrame:
    """(by..., label, prediction, n): the confusion counts."""
    return scored.groupBy(*by, label_col, prediction_col).agg(F.count(F.lit(1)).alias("n"))


def evaluator_accuracy(scored: DataFrame, label_col: str = "indexedLabel", prediction_col: str = "prediction") -> float:
    """The same number through Spark ML's evaluator (a single value to the driver)."""
    return MulticlassClassificationEvaluator(
        labelCol=label_col, predictionCol=prediction_col, metricName="accuracy"
    ).evaluate(scored)
