"""Feature preparation with Spark ML stages (F1-F5) and reports on it (A4, A5).

One multi-column ``StringIndexer`` indexes the label and the nine text
features in a single pass (its fit is a distributed ``groupBy(column, value)``
count; only the distinct values per column reach the driver, which the model
must hold anyway). ``VectorAssembler`` builds the 15-slot vector in the same
projection, and ``VectorIndexer`` re-codes slots with at most ``maxCategories``
distinct values in one more pass, sending at most ``maxCategories + 1`` values
per slot per task through a tree of merges. ``check_arity`` counts the
distinct values per column first, so no unbounded list is gathered.

The label is never a feature. Text features keep their nominal attribute
(arity = number of values) through the vector indexer, so the forest's
``maxBins`` must be at least the largest arity.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Bucketizer, StringIndexer, StringIndexerModel, VectorAssembler, VectorIndexer, VectorIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowdetect.schema import LABEL_COL, MAX_CATEGORIES, feature_columns

LABEL_INDEX_COL = "indexedLabel"
FEATURES_COL = "features"
INDEXED_FEATURES_COL = "indexedFeatures"


def index_col(c: str) -> str:
    return f"{c}_index"


def preparation_pipeline(
    text_cols: Sequence[str],
    long_cols: Sequence[str],
    *,
    label_col: str = LABEL_COL,
    max_categories: int = MAX_CATEGORIES,
    handle_invalid: str = "error",
    keep_unseen: bool = False,
) -> Pipeline:
    """Label index (F1), feature indices (F2), assembly (F3), small-domain re-coding.

    Index order is most frequent first, ties in ascending text order.
    ``handle_invalid``: ``error`` (default) raises on unseen text or null
    numbers; ``skip`` drops such rows. ``keep_unseen`` gives text and small-domain
    values that the fit did not see an extra index instead (needed when the
    preparation is fitted on training rows only); null numbers still follow
    ``handle_invalid``.
    """
    if handle_invalid not in ("error", "skip"):
        raise ValueError("handle_invalid must be 'error' or 'skip'")
    indexer = StringIndexer(
        inputCols=[label_col, *text_cols],
        outputCols=[LABEL_INDEX_COL, *[index_col(c) for c in text_cols]],
        stringOrderType="frequencyDesc",
        handleInvalid="keep" if keep_unseen else handle_invalid,
    )
    assembler = VectorAssembler(
        inputCols=[*[index_col(c) for c in text_cols], *long_cols],
        outputCol=FEATURES_COL,
        handleInvalid=handle_invalid,
    )
    vindexer = VectorIndexer(
        inputCol=FEATURES_COL,
        outputCol=INDEXED_FEATURES_COL,
        maxCategories=max_categories,
        handleInvalid="keep" if keep_unseen else handle_invalid,
    )
    return Pipeline(stages=[indexer, assembler, vindexer])


@dataclass
class Preparation:
    """A fitted preparation: the pipeline model and the feature layout."""

    model: PipelineModel
    text_cols: list[str]
    long_cols: list[str]
    label_col: str = LABEL_COL

    @property
    def string_indexer(self) -> StringIndexerModel:
        return self.model.stages[0]

    @property
    def vector_indexer(self) -> VectorIndexerModel:
        return self.model.stages[2]

    @property
    def labels(self) -> list[str]:
        """Tag values by index: the decoding table for predictions."""
        return list(self.string_indexer.labelsArray[0])

    @property
    def feature_names(self) -> list[str]:
        return [*self.text_cols, *self.long_cols]

    @property
    def categorical_slots(self) -> list[int]:
        return sorted(int(k) for k in self.vector_indexer.categoryMaps)

    def max_arity(self) -> int:
        """Largest number of values of a nominal slot (text features and re-coded slots).

        With ``handleInvalid="keep"`` every text feature has one more value
        (the index given to unseen text).
        """
        extra = 1 if self.string_indexer.getHandleInvalid() == "keep" else 0
        text = [len(v) + extra for v in self.string_indexer.labelsArray[1:]]
        recoded = [len(v) for v in self.vector_indexer.categoryMaps.values()]
        return max([2, *text, *recoded])

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


def fit_preparation(
    coarse: DataFrame,
    *,
    label_col: str = LABEL_COL,
    max_categories: int = MAX_CATEGORIES,
    handle_invalid: str = "error",
    keep_unseen: bool = False,
) -> Preparation:
    """Fit F1-F4 on ``coarse`` (F5). Features are chosen by type."""
    text_cols, long_cols = feature_columns(coarse.schema, label_col)
    check_arity(coarse, [label_col, *text_cols])
    pipeline = preparation_pipeline(
        text_cols,
        long_cols,
        label_col=label_col,
        max_categories=max_categories,
        handle_invalid=handle_invalid,
        keep_unseen=keep_unseen,
    )
    return Preparation(pipeline.fit(coarse), text_cols, long_cols, label_col)


#: Values of one text column that the fitted indexer, which holds them all on the driver, may have.
MAX_TEXT_VALUES = 5_000_000


def check_arity(df: DataFrame, cols: Sequence[str], limit: int = MAX_TEXT_VALUES) -> None:
    """Raise when a text column has more values than an indexer should hold (one distributed count, rows stay put)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("value")) for c in cols]))
    counts = df.select(pairs.alias("p")).groupBy("p.col", "p.value").agg(F.lit(1).alias("_")).groupBy("col").agg(F.count(F.lit(1)).alias("n"))
    for row in counts.collect():  # one row per column
        if row["n"] > limit:
            raise ValueError(f"column {row['col']!r} has {row['n']} values, more than {limit}; fold rare values (max_categories)")


# ------------------------------------------------ every day in one pass


def write_day_values(coarse: DataFrame, day_col: str, path: str, *, label_col: str = LABEL_COL, max_categories: int = MAX_CATEGORIES) -> None:
    """What the preparations of all days need, from one pass over all rows, written by day.

    (day, kind, col, value, n, rank): every text value of a column with its rank on that day (most
    frequent first, ties by value), and of every integer column its smallest values, one more than make
    it a small domain. Both rank filters work on aggregated rows; an integer
    column's is applied in every task before the shuffle.
    """
    text_cols, long_cols = feature_columns(coarse.schema, label_col)
    known = lambda c, kind: F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("col"), F.col(c).cast("string").alias("value"))
    cells = F.explode(F.array(*[known(c, "text") for c in (label_col, *text_cols)], *[known(c, "number") for c in long_cols])).alias("c")
    by = [day_col, "kind", "col"]
    cells = coarse.select(day_col, cells).select(day_col, "c.*")
    texts = cells.where("kind = 'text' and value is not null").groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
    texts = texts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), "value")))
    smallest = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("value").cast("long")))
    numbers = cells.where("kind = 'number' and value is not null").distinct().withColumn("rank", smallest).where(F.col("rank") <= max_categories + 1)
    texts.unionByName(numbers.withColumn("n", F.lit(None).cast("long"))).write.partitionBy(day_col).parquet(path)


#: Values of all columns of a day that are handed to an indexer one by one.
MAX_LISTED_VALUES = 100_000


def _indexer_of(labels: Sequence[Sequence[str]], cols: Sequence[str], spark) -> StringIndexerModel:
    """An indexer of given labels. (``from_arrays_of_labels`` fills shorter lists up with nulls.)"""
    gateway = spark.sparkContext._gateway
    text = gateway.jvm.java.lang.String
    arrays = gateway.new_array(text, len(labels), 1)
    for i, values in enumerate(labels):
        one = gateway.new_array(text, len(values))
        for k, value in enumerate(values):
            one[k] = value
        arrays[i] = one
    model = StringIndexerModel._create_from_java_class("org.apache.spark.ml.feature.StringIndexerModel", arrays)
    outputs = [LABEL_INDEX_COL, *[index_col(c) for c in cols[1:]]]
    return model.setInputCols(list(cols)).setOutputCols(outputs).setHandleInvalid("error")


def preparation_of_day(
    values: DataFrame,
    schema,
    *,
    label_col: str = LABEL_COL,
    max_categories: int = MAX_CATEGORIES,
) -> Preparation | None:
    """The preparation that ``fit_preparation`` would fit on one day's rows, from that day's part of ``write_day_values``.

    None without rows, and where there are more than ``MAX_LISTED_VALUES`` values: fit it on the rows then.

    The string indexer takes the ranked values as they are. The vector indexer
    decides by the number and values of small domains only, so it is fitted on a
    few rows that hold the listed values of every column.
    """
    spark = values.sparkSession
    text_cols, long_cols = feature_columns(schema, label_col)
    if values.count() > MAX_LISTED_VALUES:
        return None
    listed: dict[str, list] = {c: [] for c in [label_col, *text_cols, *long_cols]}
    for row in values.orderBy("col", "rank").collect():
        listed[row["col"]].append(row["value"] if row["kind"] == "text" else int(row["value"]))
    if not listed[label_col]:
        return None
    indexer = _indexer_of([listed[c] for c in (label_col, *text_cols)], [label_col, *text_cols], spark)
    _, assembler, vindexer = preparation_pipeline(text_cols, long_cols, label_col=label_col, max_categories=max_categories).getStages()
    names = [label_col, *text_cols, *long_cols]
    height = max_categories + 1
    few = [tuple(listed[c][k % len(listed[c])] if listed[c] else None for c in names) for k in range(height)]
    kinds = ", ".join(f"`{c}` {'long' if c in long_cols else 'string'}" for c in names)
    sample = assembler.transform(indexer.transform(spark.createDataFrame(few, kinds)))
    return Preparation(PipelineModel([indexer, assembler, vindexer.fit(sample)]), text_cols, long_cols, label_col)


# ------------------------------------------------------ numeric buckets

#: Rank error of a quantile, as a share of one bucket.
QUANTILE_ERROR = 0.1


def bucket_numbers(df: DataFrame, buckets: int, *, fit_on: DataFrame | None = None, label_col: str = LABEL_COL) -> DataFrame:
    """Integer features replaced by the number of their quantile bucket (at most ``buckets`` each).

    The limits are approximate quantiles of all rows of ``fit_on``: one
    pass of mergeable summaries, of which every task holds some ``buckets / QUANTILE_ERROR``
    numbers a feature. The forest's own search for thresholds then meets at most
    ``buckets`` values a feature, whatever the number of rows. A column with no
    more values than buckets keeps its order exactly (each value of
    enough weight is a bucket of its own). Nulls stay null.
    """
    if buckets < 2:
        raise ValueError("buckets must be at least 2")
    _, long_cols = feature_columns(df.schema, label_col)
    shares = [k / buckets for k in range(1, buckets)]
    source = fit_on if fit_on is not None else df
    accuracy = int(buckets / QUANTILE_ERROR)
    limits = source.agg(*[F.percentile_approx(c, shares, accuracy).alias(c) for c in long_cols]).first()
    cuts = {c: [float("-inf"), *[float(v) for v in sorted(set(limits[c] or []))], float("inf")] for c in long_cols}
    number = lambda c: f"_{c}_bucket"
    # a bucket begins above its limit, so that a limit that many rows share closes its bucket
    negated = df.select("*", *[(-F.col(c).cast("double")).alias(number(c)) for c in long_cols])
    back = {c: [-v for v in reversed(cuts[c])] for c in long_cols}
    placed = Bucketizer(
        inputCols=[number(c) for c in long_cols], outputCols=[f"{number(c)}_at" for c in long_cols],
        splitsArray=[back[c] for c in long_cols], handleInvalid="keep",
    ).transform(negated)
    order = lambda c: F.when(F.col(c).isNotNull(), (F.lit(len(back[c]) - 2) - F.col(f"{number(c)}_at")).cast("long")).alias(c)
    return placed.select(*[order(c) if c in long_cols else F.col(c) for c in df.columns])


OTHER_VALUE = "__other__"


def top_values(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """(col, value, n, r): the ``k`` most frequent values of each column, ties by value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("value")) for c in cols]))
    counts = df.select(pairs.alias("p")).groupBy("p.col", "p.value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("col").orderBy(F.col("n").desc(), F.col("value")))
    return counts.select("col", "value", "n", rank.alias("r")).where(F.col("r") <= k)


def fold_rare_values(
    df: DataFrame,
    cols: Sequence[str],
    max_values: int,
    *,
    other: str = OTHER_VALUE,
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Keep the ``max_values - 1`` most frequent values of each text column, fold the rest.

    Off by default in the programs because it changes results; it bounds the
    arity of every nominal feature (and so the forest's ``maxBins``) when a
    column such as an address prefix has more values than bins. Frequencies
    are one distributed count per (column, value), ranked within each column
    on the aggregated rows; the filter on the rank becomes a partial group
    limit before the shuffle, so a column's group holds at most
    ``max_values`` rows per task, whatever its number of values. Only the kept
    values (at most ``max_values`` per column) reach the driver, and rows are
    rewritten with a hash-set lookup. The frequencies come from ``fit_on``
    (say, the training rows) when given, else from ``df``.
    """
    if max_values < 2:
        raise ValueError("max_values must be at least 2")
    kept_rows = top_values(fit_on if fit_on is not None else df, cols, max_values - 1).collect()
    kept: dict[str, list[str]] = {c: [] for c in cols}
    for row in kept_rows:
        kept[row["col"]].append(row["value"])
    out = []
    for c in df.columns:
        if c in kept:
            out.append(F.when(F.col(c).isin(kept[c]), F.col(c)).otherwise(F.lit(other)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


# ---------------------------------------------------------------- reports


def label_index_report(prepared: DataFrame, label_col: str = LABEL_COL, by: Sequence[str] = ()) -> DataFrame:
    """Each tag, its index and its number of rows (F1 as a table)."""
    return prepared.groupBy(*by, label_col, LABEL_INDEX_COL).agg(F.count(F.lit(1)).alias("n"))


def feature_index_report(prepared: DataFrame, text_cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(feature, value, idx, n) for every text feature value (F2 and its counts, A4).

    One pass: each row is fanned out to one (feature, value, idx) row per text
    column and counted with a map-side partial aggregation.
    """
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"), F.col(index_col(c)).alias("idx"))
                for c in text_cols
            ]
        )
    ).alias("p")
    return (
        prepared.select(*by, pairs)
        .groupBy(*by, "p.feature", "p.value", "p.idx")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _slot_name(names: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col("slot") + 1)


def distinct_per_feature(prepared: DataFrame, prep: Preparation) -> DataFrame:
    """(slot, feature, n_distinct, categorical) over the assembled vectors (A5).

    ``categorical`` is the vector indexer's decision (at most ``maxCategories``
    values); ``n_distinct`` the exact count, a two-phase distinct aggregation.
    """
    slots = prepared.select(F.posexplode(vector_to_array(F.col(FEATURES_COL))).alias("slot", "value"))
    counts = slots.groupBy("slot").agg(F.countDistinct("value").alias("n_distinct"))
    return counts.select(
        F.col("slot"),
        _slot_name(prep.feature_names).alias("feature"),
        F.col("n_distinct"),
        F.col("slot").isin(prep.categorical_slots).alias("categorical"),
    )


def vector_slots(prepared: DataFrame, key: str = "event_id") -> DataFrame:
    """One row per (row, slot): assembled value and re-coded value (F3, F4 as rows)."""
    zipped = F.arrays_zip(
        vector_to_array(F.col(FEATURES_COL)).alias("value"),
        vector_to_array(F.col(INDEXED_FEATURES_COL)).alias("indexed_value"),
    )
    return prepared.select(key, F.posexplode(zipped).alias("slot", "z")).select(
        key, "slot", F.col("z.value").alias("value"), F.col("z.indexed_value").alias("indexed_value")
    )
