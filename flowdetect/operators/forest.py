"""Random forest training, scoring, decoding (M1-M4) and the node table (M7, M5).

Training is Spark ML's distributed forest: per tree level, one pass that
aggregates split statistics per (node, feature, bin) across tasks. The fitted
forest is written with Spark's model writer to the shared scratch folder; its
``data`` table (one row per node) is then read back as a DataFrame. The
feature importances are the model's own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import IndexToString
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowdetect.operators.prepare import INDEXED_FEATURES_COL, LABEL_INDEX_COL
from flowdetect.schema import MAX_BINS_ALL_DAYS, MAX_BINS_ONE_DAY, NUM_TREES  # noqa: F401

PREDICTION_COL = "prediction"
PREDICTED_LABEL_COL = "predictedLabel"


def forest_pipeline(
    labels: Sequence[str],
    *,
    num_trees: int = NUM_TREES,
    max_bins: int = MAX_BINS_ONE_DAY,
    max_depth: int = 5,
    seed: int = 42,
    subsampling_rate: float = 1.0,
    feature_subset: str = "auto",
    bootstrap: bool = True,
    rf_params: dict | None = None,
) -> Pipeline:
    """Forest on the indexed label and re-coded features (M1), decoded by the fit's labels (M4).

    ``rf_params`` sets further ``RandomForestClassifier`` parameters, e.g.
    ``{"maxMemoryInMB": 1024}`` (more nodes per pass over the data) or
    ``{"cacheNodeIds": True, "checkpointInterval": 10}`` (with the session's
    checkpoint folder) for deeper trees.
    """
    rf = RandomForestClassifier(
        labelCol=LABEL_INDEX_COL,
        featuresCol=INDEXED_FEATURES_COL,
        predictionCol=PREDICTION_COL,
        numTrees=num_trees,
        maxBins=max_bins,
        maxDepth=max_depth,
        seed=seed,
        subsamplingRate=subsampling_rate,
        featureSubsetStrategy=feature_subset,
        bootstrap=bootstrap,
    )
    if rf_params:
        rf.setParams(**rf_params)
    decode = IndexToString(inputCol=PREDICTION_COL, outputCol=PREDICTED_LABEL_COL, labels=list(labels))
    return Pipeline(stages=[rf, decode])


def forest_of(model: PipelineModel) -> RandomForestClassificationModel:
    return model.stages[0]


def save_forest(model: RandomForestClassificationModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def forest_nodes(spark, path: str, feature_names: Sequence[str]) -> DataFrame:
    """The saved forest as one row per node (M7), readable in SQL.

    For a split node: the feature slot and name, the threshold (continuous:
    go left when value <= threshold) or the left categories (nominal), the
    impurity gain; for every node: prediction, impurity, class counts.
    """
    data = spark.read.parquet(f"{path.rstrip('/')}/data")
    n = F.col("nodeData")
    split = n.getField("split")
    fidx = split.getField("featureIndex")
    is_split = n.getField("leftChild") >= 0
    continuous = split.getField("numCategories") < 0
    names = F.array(*[F.lit(x) for x in feature_names])
    return data.select(
        F.col("treeID").alias("tree"),
        n.getField("id").alias("node"),
        is_split.alias("is_split"),
        F.when(is_split, fidx).alias("slot"),
        F.when(is_split, F.element_at(names, fidx + 1)).alias("feature"),
        F.when(is_split & continuous, F.element_at(split.getField("leftCategoriesOrThreshold"), 1)).alias(
            "threshold"
        ),
        F.when(is_split & ~continuous, split.getField("leftCategoriesOrThreshold")).alias("left_categories"),
        F.when(is_split, n.getField("gain")).alias("gain"),
        n.getField("leftChild").alias("left_child"),
        n.getField("rightChild").alias("right_child"),
        n.getField("prediction").alias("prediction"),
        n.getField("impurity").alias("impurity"),
        n.getField("impurityStats").alias("class_counts"),
        n.getField("rawCount").alias("raw_count"),
    )


def importances_table(spark, model: RandomForestClassificationModel, feature_names: Sequence[str], scope: str) -> DataFrame:
    """(day, slot, feature, importance, rank) of a fitted forest (M5): one row per feature, ties by slot."""
    values = model.featureImportances.toArray().tolist()
    order = sorted(range(len(feature_names)), key=lambda i: (-values[i], i))
    rows = [(scope, i, feature_names[i], float(values[i]), rank) for rank, i in enumerate(order, 1)]
    return spark.createDataFrame(rows, "day string, slot int, feature string, importance double, rank int")
