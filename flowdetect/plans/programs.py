"""The forest programs as one parameterised pipeline (W2-W4), the ingest (W0), W1.

A run: coarsen the flows of its scope (one day, or all) and persist them, so
the source is read once; fit the preparation on all of them (as the original
programs do: before the split), mark the key-hash split, keep a slim
persisted copy of the prepared rows, fit the forest on the training part,
score the test part. Nothing stays persisted when a run fails.

For every day (W3, a few days at a time), the coarse rows are written once by
day, each day reads its own part, and its results are written to
the output folder as soon as that day is done and its cached rows released;
the returned tables aggregate those files, so the lineage of the final tables
is a Parquet scan, not six pipelines, and a lost executor never forces a day
to be retrained.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdetect.operators import forest as fo
from flowdetect.operators.coarsen import prepare_flows
from flowdetect.operators.metrics import accuracy, confusion
from flowdetect.operators.prepare import (
    FEATURES_COL,
    INDEXED_FEATURES_COL,
    LABEL_INDEX_COL,
    Preparation,
    bucket_numbers,
    fit_preparation,
    fold_rare_values,
    preparation_of_day,
    write_day_values,
)
from flowdetect.operators.split import PART_COL, TEST, TRAIN, random_split, with_split
from flowdetect.operators.stats import flow_stats
from flowdetect.plans.bounded import collect_bounded
from flowdetect.plans.layout import forest_buckets, place_by_key
from flowdetect.schema import DAY_COL, DAYS, LABEL_COL, TRAIN_FRACTION, feature_columns
from flowdetect.session import remove_path, scratch_path, unsorted_folders
from flowdetect.sources.csv import write_prepared_csv
from flowdetect.sources.parquet import read_flows, write_flows_by_day
from flowdetect.sources.xml import read_flow_days

ALL_DAYS = "all"
MAX_DAYS = 100_000
MAX_DAY_THREADS = 8

__all__ = [
    "EachDayResult",
    "ForestRun",
    "flow_stats",
    "ingest_days",
    "train_all_days",
    "train_day",
    "train_each_day",
    "train_on",
]


@dataclass
class ForestRun:
    """One trained forest with its preparation, scored test rows and outputs."""

    scope: str
    preparation: Preparation
    model: PipelineModel
    prepared: DataFrame
    predictions: DataFrame
    max_bins: int
    model_path: str | None = field(default=None)

    @property
    def forest(self) -> fo.RandomForestClassificationModel:
        return fo.forest_of(self.model)

    @property
    def feature_names(self) -> list[str]:
        return self.preparation.feature_names

    def scored(self) -> DataFrame:
        """Test rows with the true tag, its index, the prediction and its decoded tag (M3, M4)."""
        keys = [c for c in ("event_id", DAY_COL) if c in self.predictions.columns]
        return self.predictions.select(
            *keys, LABEL_COL, LABEL_INDEX_COL, fo.PREDICTION_COL, fo.PREDICTED_LABEL_COL
        )

    def sample(self, n: int = 5) -> DataFrame:
        """A few scored rows to look at (S6): decoded prediction, tag, assembled features.

        The first ``n`` test rows by key, so the sample is the same every run;
        a top-n over the key runs as a per-task top-n and one small merge.
        """
        keys = [c for c in ("event_id", DAY_COL) if c in self.predictions.columns]
        order = keys or [LABEL_COL]
        features = vector_to_array(F.col(FEATURES_COL))
        return (
            self.predictions.select(*keys, fo.PREDICTED_LABEL_COL, LABEL_COL, features.alias("features"))
            .orderBy(*order)
            .limit(n)
        )

    def test_error(self) -> DataFrame:
        """(day, n, accuracy, test_error) for the run's scope."""
        out = accuracy(self.predictions, LABEL_INDEX_COL, fo.PREDICTION_COL, by=())
        return out.select(F.lit(self.scope).alias(DAY_COL), "*")

    def confusion(self) -> DataFrame:
        out = confusion(self.predictions, LABEL_COL, fo.PREDICTED_LABEL_COL, by=())
        return out.select(F.lit(self.scope).alias(DAY_COL), "*")

    def save(self, path: str) -> str:
        """Write the fitted preparation and forest pipelines (shared storage).

        ``<path>/preparation`` and ``<path>/forest`` reload with
        ``PipelineModel.load`` to score new flows of the same layout; the
        node table is then read from the saved forest stage.
        """
        self.preparation.model.write().overwrite().save(f"{path}/preparation")
        self.model.write().overwrite().save(f"{path}/forest")
        self.model_path = f"{path}/forest/stages/0_*"
        return path

    @property
    def forest_path(self) -> str:
        """Where the forest model is saved; saves the forest alone if not yet saved."""
        if self.model_path is None:
            target = scratch_path(self.prepared.sparkSession, f"forest-{self.scope}")
            self.model_path = fo.save_forest(self.forest, target)
        return self.model_path

    def nodes(self) -> DataFrame:
        """The forest as one row per node, with the run's scope (M7)."""
        nodes = fo.forest_nodes(self.prepared.sparkSession, self.forest_path, self.feature_names)
        return nodes.select(F.lit(self.scope).alias(DAY_COL), "*")

    def importances(self) -> DataFrame:
        """(day, slot, feature, importance, rank) (M5)."""
        return fo.importances_table(self.prepared.sparkSession, self.forest, self.feature_names, self.scope)

    def n_rows(self) -> int:
        """Rows of the scope that were prepared (training and test together)."""
        return self.prepared.count()

    def release(self) -> None:
        self.prepared.unpersist()


def _resolve_bins(max_bins: int | str, prep: Preparation) -> int:
    """The forest's maxBins: given, raised to the largest nominal arity where needed.

    ``"auto"``: max(32, largest nominal arity). Split histograms, and so each
    tree level's shuffle, grow with maxBins; a small value makes the threshold
    grid of the numeric features coarser and costs accuracy.
    """
    return max(32 if max_bins == "auto" else int(max_bins), prep.max_arity())


def ingest_days(
    spark: SparkSession,
    xml_base: str,
    out_path: str,
    *,
    mode: str = "errorifexists",
    extra_fields=(),
) -> DataFrame:
    """Parse the day XML files once and keep them as Parquet by day.

    Returns the Parquet table; later programs prune to their days from it.
    """
    raw = read_flow_days(spark, xml_base, extra_fields=extra_fields)
    write_flows_by_day(raw, out_path, mode=mode)
    return read_flows(spark, out_path)


def train_on(
    coarse: DataFrame,
    scope: str,
    *,
    num_trees: int = fo.NUM_TREES,
    max_bins: int | str = fo.MAX_BINS_ONE_DAY,
    max_depth: int = 5,
    seed: int = 42,
    subsampling_rate: float = 1.0,
    feature_subset: str = "auto",
    bootstrap: bool = True,
    partitions: int | None = None,
    rf_params: dict | None = None,
    train_fraction: float = TRAIN_FRACTION,
    split_key: str | None = "event_id",
    split_salt: str = "",
    split: str = "key",
    fit_on: str = "all",
    handle_invalid: str = "error",
    max_categories: int | None = None,
    numeric_buckets: int | None = None,
    preparation: Preparation | None = None,
    csv_path: str | None = None,
    csv_mode: str = "errorifexists",
    csv_by_day: bool = True,
) -> ForestRun:
    """Train and score one forest on already coarsened rows (``prepare_flows``).

    ``fit_on="all"`` fits the preparation on every row before the split, as
    the original programs do; ``"train"`` fits it on training rows only and
    gives unseen test values their own index.

    ``split="key"`` (default) marks the sides by a hash of ``split_key`` (a
    ``split_salt`` draws another split); ``split="random"`` uses Spark's
    seeded ``randomSplit`` on the cached rows, as the original programs did
    (unseeded there).

    ``max_bins`` is raised to the largest nominal arity where that is larger;
    ``"auto"`` is max(32, that arity): faster, at some cost in accuracy, since numeric
    features get fewer thresholds. ``partitions``: partitions of the forest's
    input, part of what the forest depends on; by default they follow from the
    number of rows (``plans.layout.forest_buckets``).
    ``subsampling_rate`` < 1 trains each tree on that share of the training rows;
    ``rf_params`` passes further forest parameters through.
    ``handle_invalid="skip"`` drops rows with a null number instead of failing;
    ``n_rows`` of the run counts the rest. ``max_categories`` (off by default) folds the rarest
    text values of each feature into one bucket so that no nominal feature
    has more values than that. ``numeric_buckets`` (off by default) replaces each
    integer feature by its quantile bucket, so that the search for thresholds
    meets no more values than that. ``preparation``: one that is already fitted for these rows; ``coarse`` is
    then a written table, read once.
    """
    if split not in ("key", "random"):
        raise ValueError("split must be 'key' or 'random'")
    if fit_on not in ("all", "train"):
        raise ValueError("fit_on must be 'all' or 'train'")
    if split == "random" and fit_on == "train":
        raise ValueError("fit_on='train' needs split='key' (the split comes before the fit)")
    if preparation is not None and (fit_on != "all" or max_categories or numeric_buckets):
        raise ValueError("a given preparation goes with none of fit_on='train', max_categories, numeric_buckets")
    rows = coarse if preparation is not None else coarse.persist(StorageLevel.MEMORY_AND_DISK)  # the source is read once, while this fills
    prepared = None
    try:
        n_rows = rows.count()
        if not n_rows:
            raise ValueError(f"no flows to train on for {scope!r}")
        marked_rows = with_split(rows, key=split_key, fraction=train_fraction, salt=split_salt)
        if preparation is None:
            seen = marked_rows.where(F.col(PART_COL) == TRAIN).drop(PART_COL) if fit_on == "train" else rows
            if max_categories:
                text_cols, _ = feature_columns(rows.schema)
                marked_rows = fold_rare_values(marked_rows, text_cols, max_categories, fit_on=seen)
            if numeric_buckets:
                marked_rows = bucket_numbers(marked_rows, numeric_buckets, fit_on=seen)
            if max_categories or numeric_buckets:
                seen = (marked_rows.where(F.col(PART_COL) == TRAIN) if fit_on == "train" else marked_rows).drop(PART_COL)
            prep = fit_preparation(seen, handle_invalid=handle_invalid, keep_unseen=fit_on == "train")
        else:
            prep = preparation
        bins = _resolve_bins(max_bins, prep)
        marked = prep.transform(marked_rows)
        if csv_path:
            write_prepared_csv(marked.drop(PART_COL), csv_path, mode=csv_mode, by_day=csv_by_day)
        keys = [c for c in ("event_id", DAY_COL) if c in marked.columns]
        # The forest reads its input several times before caching its own binned
        # copy, and the test part is scored and evaluated: keep the slim columns only.
        slim = marked.select(*keys, LABEL_COL, LABEL_INDEX_COL, FEATURES_COL, INDEXED_FEATURES_COL, PART_COL)
        placed = place_by_key(slim, [split_key] if split_key else (), partitions or forest_buckets(n_rows))
        prepared = placed.persist(StorageLevel.MEMORY_AND_DISK)
        prepared.count()  # fills the slim copy, so the coarse rows can go
        if preparation is None:
            rows.unpersist()
        if split == "random":
            # sides drawn per row by Spark's sampler over the cached, key-sorted rows
            train, test = random_split(prepared.drop(PART_COL), (train_fraction, 1.0 - train_fraction), seed)
        else:
            train = prepared.where(F.col(PART_COL) == TRAIN)
            test = prepared.where(F.col(PART_COL) == TEST)
        pipeline = fo.forest_pipeline(
            prep.labels,
            num_trees=num_trees,
            max_bins=bins,
            max_depth=max_depth,
            seed=seed,
            subsampling_rate=subsampling_rate,
            feature_subset=feature_subset,
            bootstrap=bootstrap,
            rf_params=rf_params,
        )
        model = pipeline.fit(train)
    except BaseException:
        if prepared is not None:
            prepared.unpersist()
        if preparation is None:
            rows.unpersist()
        raise
    return ForestRun(scope, prep, model, prepared, model.transform(test), bins)


def train_day(flows: DataFrame, day: str, **kwargs) -> ForestRun:
    """The one-day program (W2): one day's flows (pruned to that day at the scan).

    ``flows`` are raw flow rows; the program coarsens them once (coarsening is
    not idempotent: the hour of an hour text is empty).
    """
    return train_on(prepare_flows(flows.where(F.col(DAY_COL) == day)), day, **kwargs)


def train_all_days(flows: DataFrame, **kwargs) -> ForestRun:
    """The all-days program (W4): the bag union of every day, one forest.

    ``flows`` are raw flow rows, as for ``train_day``.

    maxBins defaults to 20000 here (10000 for one day).
    """
    kwargs.setdefault("max_bins", fo.MAX_BINS_ALL_DAYS)
    return train_on(prepare_flows(flows), ALL_DAYS, **kwargs)


@dataclass
class EachDayResult:
    """Per-day outputs of W3, computed from the written per-day tables.

    Each day wrote its scored test rows, its forest's node table and its
    forest model (with ``save_models``, its pipelines) under ``path``; the
    reports below aggregate those files (one scan each), never the pipelines
    that produced them.
    """

    spark: SparkSession
    path: str
    days: list[str]
    feature_names: list[str]
    max_bins: dict[str, int]

    def _read(self, kind: str) -> DataFrame:
        # only this run's days (partition pruning): an output folder reused for
        # other days may hold folders of an earlier run
        table = self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(f"{self.path}/{kind}")
        return table.where(F.col(DAY_COL).isin(self.days))

    def scored(self) -> DataFrame:
        return self._read("scored")

    def nodes(self) -> DataFrame:
        return self._read("nodes")

    def test_error(self) -> DataFrame:
        """(day, n, accuracy, test_error) per day (E1 for every day)."""
        return accuracy(self.scored(), LABEL_INDEX_COL, fo.PREDICTION_COL, by=(DAY_COL,))

    def confusion(self) -> DataFrame:
        """(day, Tag, predictedLabel, n) per day."""
        return confusion(self.scored(), LABEL_COL, fo.PREDICTED_LABEL_COL, by=(DAY_COL,))

    def importances(self) -> DataFrame:
        """(day, slot, feature, importance, rank) per day (M6)."""
        return self._read("importances").select(DAY_COL, "slot", "feature", "importance", "rank")

    def importances_wide(self) -> DataFrame:
        """One row per day, one column per feature (M6 as the original printed it)."""
        return self.importances().groupBy(DAY_COL).pivot("feature", self.feature_names).agg(F.first("importance"))


def _days_of(flows: DataFrame) -> list[str]:
    rows = collect_bounded(flows.select(DAY_COL).distinct(), MAX_DAYS)
    if rows is None:
        raise ValueError(f"more than {MAX_DAYS} days")
    found = {r[0] for r in rows}
    if None in found:
        raise ValueError("some flows have no day; give them one, or name the days to train")
    known = [d for d in DAYS if d in found]
    return known + sorted(found - set(known))


def train_each_day(
    flows: DataFrame,
    days: Iterable[str] | None = None,
    *,
    out_path: str | None = None,
    csv_path: str | None = None,
    csv_mode: str = "errorifexists",
    parallelism: int | None = None,
    save_models: bool = False,
    **kwargs,
) -> EachDayResult:
    """A forest for every day (W3); each day's results written under ``out_path``.

    The coarse rows are written once to a scratch table by day (removed at the
    end), so the source is read once and each day reads its own part. One pass over that
    table gives what every day's preparation needs (``write_day_values``), so a day's
    rows are read once more only, when they are prepared. A row
    without a day is an error unless ``days`` names the days to train.
    ``csv_mode``: what to do when a day's CSV folder exists (an error by default).

    Days are independent, so up to ``parallelism`` of them (default: all, at
    most 8) are trained at the same time: each is a series of distributed
    jobs submitted from its own driver thread, and Spark runs their tasks
    side by side. Cached rows (and the forest's binned copy) of those days
    are held at once -- with every day, no more than the all-days program
    holds; use 1 to hold a single day. Every day writes only its own ``day=<day>`` folders:
    its scored test rows, its forest's node table, its forest model, and with
    ``save_models=True`` its preparation and forest pipelines (reloadable
    with ``PipelineModel.load``).
    """
    spark = flows.sparkSession
    out = (out_path or scratch_path(spark, "each-day")).rstrip("/")
    scratch = scratch_path(spark, "coarse-by-day")
    coarse = prepare_flows(flows)
    if days is not None:
        coarse = coarse.where(F.col(DAY_COL).isin(list(days)))
    with unsorted_folders(spark):
        coarse.write.partitionBy(DAY_COL).parquet(scratch)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in coarse.schema.fields])
    table = spark.read.schema(schema).parquet(scratch).select(*coarse.columns)
    day_list = list(days) if days is not None else _days_of(table)
    # what all days' preparations need, in one pass; other settings are fitted day by day
    together = not any(kwargs.get(k) for k in ("max_categories", "numeric_buckets")) and kwargs.get("fit_on", "all") == "all"
    together = together and kwargs.get("handle_invalid", "error") == "error"
    values_path = scratch_path(spark, "day-values")
    if together:
        write_day_values(table, DAY_COL, values_path)
    values = spark.read.schema(f"kind string, col string, value string, n long, rank int, {DAY_COL} string").parquet(values_path) if together else None

    def one(day: str) -> tuple[int, list[str]]:
        part = f"{DAY_COL}={day}"
        prep = None
        if values is not None:
            prep = preparation_of_day(values.where(F.col(DAY_COL) == day).drop(DAY_COL), coarse.schema)
        run = train_on(
            table.where(F.col(DAY_COL) == day),
            day,
            preparation=prep,
            csv_path=f"{csv_path.rstrip('/')}/{part}" if csv_path else None,
            csv_mode=csv_mode,
            csv_by_day=False,
            **kwargs,
        )
        try:
            if save_models:
                run.save(f"{out}/pipelines/{part}")
            else:
                run.model_path = fo.save_forest(run.forest, f"{out}/forests/{part}")
            run.scored().drop(DAY_COL).write.mode("overwrite").parquet(f"{out}/scored/{part}")
            nodes = fo.forest_nodes(spark, run.forest_path, run.feature_names)
            nodes.write.mode("overwrite").parquet(f"{out}/nodes/{part}")
            run.importances().drop(DAY_COL).write.mode("overwrite").parquet(f"{out}/importances/{part}")
            return run.max_bins, run.feature_names
        finally:
            run.release()

    try:
        workers = max(1, min(parallelism or MAX_DAY_THREADS, len(day_list)))
        if workers == 1:
            done = [one(d) for d in day_list]
        else:
            with ThreadPoolExecutor(max_workers=workers) as pool:
                done = list(pool.map(inheritable_thread_target(spark)(one), day_list))
    finally:
        remove_path(spark, scratch)
        remove_path(spark, values_path)
    names = done[0][1] if done else []
    return EachDayResult(spark, out, day_list, names, {d: b for d, (b, _) in zip(day_list, done)})
