"""Registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the ``events`` table of ``sf_dir`` (flows are derived from
it row by row) and runs over all of it. Queries that write (XML, CSV,
Parquet round trips, saved forests) write under the session's checkpoint
folder. Forest runs are shared between the queries that report on them.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdetect.functions.text import address_prefix, hour_text
from flowdetect.operators.coarsen import fill_missing, min_max_scale, prepare_flows, select_flows
from flowdetect.operators.metrics import accuracy, confusion
from flowdetect.operators.index_table import fit_index_table
from flowdetect.operators.prepare import (
    distinct_per_feature,
    feature_index_report,
    fit_preparation,
    index_col,
    label_index_report,
    vector_slots,
)
from flowdetect.operators.split import PART_COL, TEST, with_split
from flowdetect.operators.stats import flow_count, flow_stats, tag_counts, tag_share
from flowdetect.plans import programs
from flowdetect.schema import DAY_COL, DAYS, FLOW_COLS, LABEL_COL, feature_columns
from flowdetect.session import scratch_path
from flowdetect.sources.csv import csv_schema_of, read_prepared_csv, write_prepared_csv
from flowdetect.sources.events import read_event_flows
from flowdetect.sources.parquet import read_flows, write_flows_by_day
from flowdetect.sources.xml import read_flow_days, write_flow_days

Query = Callable[[SparkSession, str], DataFrame]
ONE_DAY = "Jun14"  # the one-day program's day (third capture day)

_REGISTRY: dict[str, Query] = {}
_RUNS: dict[tuple, object] = {}
_RUNS_LOCK = threading.RLock()  # builds may use other shared runs


def query(name: str):
    def register(fn: Query) -> Query:
        _REGISTRY[name] = fn
        return fn

    return register


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_event_flows(spark, sf_dir)


def _memo(spark: SparkSession, kind: str, sf_dir: str, build: Callable[[], object]):
    """Build a shared result once per session and state of the table (also when queries run from several threads).

    What is kept are fitted models and written tables, never cached rows.
    """
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    state = (files.getFileStatus(folder).getModificationTime(), files.getContentSummary(folder).getLength())
    full = (spark.sparkContext.applicationId, kind, path, state)
    with _RUNS_LOCK:
        if full not in _RUNS:
            _RUNS[full] = build()
        return _RUNS[full]


# ------------------------------------------------------------- rows and text


@query("flow_rows")
def q_flow_rows(spark, sf_dir):
    return select_flows(_flows(spark, sf_dir))


@query("fill_missing")
def q_fill_missing(spark, sf_dir):
    return fill_missing(select_flows(_flows(spark, sf_dir)))


@query("address_prefix")
def q_address_prefix(spark, sf_dir):
    f = _flows(spark, sf_dir)
    return f.select(
        "event_id", address_prefix("destination").alias("destination"), address_prefix("source").alias("source")
    )


@query("hour_text")
def q_hour_text(spark, sf_dir):
    f = _flows(spark, sf_dir)
    return f.select(
        "event_id", hour_text("startDateTime").alias("startDateTime"), hour_text("stopDateTime").alias("stopDateTime")
    )


@query("coarsen_flows")
def q_coarsen_flows(spark, sf_dir):
    return prepare_flows(_flows(spark, sf_dir))


def _edge_numbers(spark, sf_dir):
    """Numbers near 2^60 in days of which one is null and one has no number at all."""
    f = _flows(spark, sf_dir)
    day = F.when(F.col(DAY_COL) != "Jun13", F.col(DAY_COL))
    value = F.when(F.col(DAY_COL) != "Jun12", F.lit(1 << 60) + F.col("totalDestinationBytes") * 1_000_003)
    return f.select("event_id", day.alias(DAY_COL), value.alias("totalDestinationBytes"))


@query("min_max_null_day")
def q_min_max_null_day(spark, sf_dir):
    """Min-max scaling with a null day, a day without numbers and numbers near 2^60."""
    return min_max_scale(_edge_numbers(spark, sf_dir), "totalDestinationBytes", by=(DAY_COL,))


@query("min_max")
def q_min_max(spark, sf_dir):
    f = _flows(spark, sf_dir).select("event_id", DAY_COL, "totalDestinationBytes")
    return min_max_scale(f, "totalDestinationBytes", by=(DAY_COL,))


# ------------------------------------------------------------ sources, sinks


@query("union_days")
def q_union_days(spark, sf_dir):
    """The six day tables, each its own input, unioned lazily (U1). Another day is an error."""
    flows = select_flows(_flows(spark, sf_dir))
    day = F.col(DAY_COL)
    known = flows.withColumn(DAY_COL, F.when(day.isin(DAYS), day).otherwise(F.raise_error(F.concat(F.lit("no such day: "), day))))
    return _union([known.where(F.col(DAY_COL) == d) for d in DAYS]).select("event_id", DAY_COL, *FLOW_COLS)


@query("xml_days")
def q_xml_days(spark, sf_dir):
    """Flows written as six XML day files (indented), read back with their row tags."""
    base = scratch_path(spark, "xml-days")
    flows = select_flows(_flows(spark, sf_dir))
    write_flow_days(flows, base, columns=["event_id", *FLOW_COLS])
    back = read_flow_days(spark, base, extra_fields=[T.StructField("event_id", T.LongType(), True)])
    return back.select("event_id", DAY_COL, *FLOW_COLS)


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _csv_written(spark, sf_dir):
    """The prepared table written once as CSV with a header, by day (S5), and read back."""

    def build():
        prep, prepared = _prepared_all(spark, sf_dir)
        path = write_prepared_csv(prepared, scratch_path(spark, "prepared-csv"))
        return prep, read_prepared_csv(spark, path, csv_schema_of(prepared))

    return _memo(spark, "csv", sf_dir, build)


@query("csv_roundtrip")
def q_csv_roundtrip(spark, sf_dir):
    """The flow columns of the prepared table, read back from the CSV sink."""
    _, back = _csv_written(spark, sf_dir)
    return back.select("event_id", DAY_COL, *FLOW_COLS)


@query("csv_prepared")
def q_csv_prepared(spark, sf_dir):
    """What the CSV sink adds, read back: label index, feature indices, features as text."""
    prep, back = _csv_written(spark, sf_dir)
    return back.select(
        "event_id", DAY_COL, "indexedLabel", *[f"{c}_index" for c in prep.text_cols], "features"
    )


# -------------------------------------------------------------- statistics


@query("flow_count")
def q_flow_count(spark, sf_dir):
    return flow_count(_flows(spark, sf_dir))


@query("tag_counts")
def q_tag_counts(spark, sf_dir):
    return tag_counts(_flows(spark, sf_dir))


@query("tag_share")
def q_tag_share(spark, sf_dir):
    return tag_share(_flows(spark, sf_dir))


@query("flow_stats")
def q_flow_stats(spark, sf_dir):
    return flow_stats(_flows(spark, sf_dir))


# ------------------------------------------------------------- preparation


def _prepared_all(spark, sf_dir):
    def build():
        coarse = prepare_flows(_flows(spark, sf_dir))
        prep = fit_preparation(coarse)
        return prep, prep.transform(coarse)

    return _memo(spark, "prepared", sf_dir, build)


@query("label_index")
def q_label_index(spark, sf_dir):
    _, prepared = _prepared_all(spark, sf_dir)
    return label_index_report(prepared)


def _prepared_by_day(spark, sf_dir):
    """Each day's own preparation (fitted per day, as W2/W3 do) on its part of one written table."""

    def build():
        path = write_flows_by_day(select_flows(_flows(spark, sf_dir)), scratch_path(spark, "flows-by-day"))
        coarse = prepare_flows(read_flows(spark, path))

        def one(d):
            day_rows = coarse.where(F.col(DAY_COL) == d)
            prep = fit_preparation(day_rows)
            return d, prep, prep.transform(day_rows)

        with ThreadPoolExecutor(max_workers=3) as pool:
            return list(pool.map(inheritable_thread_target(spark)(one), DAYS))

    return _memo(spark, "prepared_by_day", sf_dir, build)


@query("feature_index_table")
def q_feature_index_table(spark, sf_dir):
    """The text-feature indices as a written table, for columns larger than a driver should hold."""
    coarse = prepare_flows(_flows(spark, sf_dir))
    text_cols, _ = feature_columns(coarse.schema)
    ranks = _memo(spark, "index_table", sf_dir, lambda: fit_index_table(coarse, text_cols))
    return ranks.table().select(F.col("col").alias("feature"), "value", "idx", "n")


@query("feature_codes")
def q_feature_codes(spark, sf_dir):
    """Every row's label and feature indices, joined from the written table."""
    coarse = prepare_flows(_flows(spark, sf_dir))
    text_cols, _ = feature_columns(coarse.schema)
    ranks = _memo(spark, "index_table_label", sf_dir, lambda: fit_index_table(coarse, [LABEL_COL, *text_cols]))
    coded = ranks.encode(coarse.select("event_id", DAY_COL, LABEL_COL, *text_cols))
    return coded.select("event_id", DAY_COL, *[index_col(c) for c in (LABEL_COL, *text_cols)])


@query("label_index_by_day")
def q_label_index_by_day(spark, sf_dir):
    """The label index of each day's own preparation."""
    return _union([label_index_report(p, by=(DAY_COL,)) for _, _, p in _prepared_by_day(spark, sf_dir)])


@query("feature_index_by_day")
def q_feature_index_by_day(spark, sf_dir):
    """The text-feature indices of each day's own preparation."""
    return _union(
        [feature_index_report(p, prep.text_cols, by=(DAY_COL,)) for _, prep, p in _prepared_by_day(spark, sf_dir)]
    )


@query("distinct_per_feature_by_day")
def q_distinct_per_feature_by_day(spark, sf_dir):
    """Distinct values per slot and the vector indexer's choice, per day."""
    return _union(
        [
            distinct_per_feature(p, prep).select(F.lit(d).alias(DAY_COL), "*")
            for d, prep, p in _prepared_by_day(spark, sf_dir)
        ]
    )


@query("feature_index")
def q_feature_index(spark, sf_dir):
    prep, prepared = _prepared_all(spark, sf_dir)
    return feature_index_report(prepared, prep.text_cols)


@query("distinct_per_feature")
def q_distinct_per_feature(spark, sf_dir):
    prep, prepared = _prepared_all(spark, sf_dir)
    return distinct_per_feature(prepared, prep)


@query("vector_slots")
def q_vector_slots(spark, sf_dir):
    _, prepared = _prepared_all(spark, sf_dir)
    return vector_slots(prepared)


@query("split_by_key")
def q_split_by_key(spark, sf_dir):
    return with_split(_flows(spark, sf_dir)).select("event_id", DAY_COL, PART_COL)


# ------------------------------------------------------------------ metrics


def _rule_scored(spark, sf_dir):
    """Test rows scored by a fixed rule (SSH flows are attacks): a known
    prediction, so the metric itself can be checked in SQL."""
    test = with_split(_flows(spark, sf_dir)).where(F.col(PART_COL) == TEST)
    rule = F.when(F.col("appName") == "SSH", "Attack").otherwise("Normal")
    return test.select(DAY_COL, LABEL_COL, rule.alias("predictedLabel"))


@query("accuracy")
def q_accuracy(spark, sf_dir):
    return accuracy(_rule_scored(spark, sf_dir), LABEL_COL, "predictedLabel", by=(DAY_COL,))


@query("confusion")
def q_confusion(spark, sf_dir):
    return confusion(_rule_scored(spark, sf_dir), LABEL_COL, "predictedLabel", by=(DAY_COL,))


# ------------------------------------------------------------------- forests


class _Written:
    """Outputs of a run as written tables; its cached rows are released."""

    def __init__(self, spark, name, run):
        try:
            base = scratch_path(spark, name)
            tables = {
                "scored": run.scored(), "sample": run.sample(5), "nodes": run.nodes(),
                "importances": run.importances(), "test_error": run.test_error(),
            }
            for kind, table in tables.items():
                table.write.parquet(f"{base}/{kind}")
            self.n_rows = run.n_rows()
        finally:
            run.release()
        self.spark, self.base = spark, base

    def read(self, kind):
        return self.spark.read.parquet(f"{self.base}/{kind}")


def _one_day(spark, sf_dir):
    build = lambda: _Written(spark, "one-day", programs.train_day(_flows(spark, sf_dir), ONE_DAY))
    return _memo(spark, "one_day", sf_dir, build)


def _each_day(spark, sf_dir):
    return _memo(spark, "each_day", sf_dir, lambda: programs.train_each_day(_flows(spark, sf_dir)))


def _all_days(spark, sf_dir):
    build = lambda: _Written(spark, "all-days", programs.train_all_days(_flows(spark, sf_dir)))
    return _memo(spark, "all_days", sf_dir, build)


@query("scored")
def q_scored(spark, sf_dir):
    return _one_day(spark, sf_dir).read("scored")


@query("scored_sample")
def q_scored_sample(spark, sf_dir):
    """Five scored rows of the one-day forest (the sample the program shows)."""
    return _one_day(spark, sf_dir).read("sample")


@query("split_and_label_one_day")
def q_split_and_label_one_day(spark, sf_dir):
    """Split and label check: which rows the one-day program tests, with the day's label index."""
    return _one_day(spark, sf_dir).read("scored").select("event_id", DAY_COL, LABEL_COL, "indexedLabel")


@query("split_count_by_day")
def q_split_count_by_day(spark, sf_dir):
    """Split check: the number of test rows of each day (the n of its test error)."""
    return _each_day(spark, sf_dir).test_error().select(DAY_COL, "n")


@query("split_and_label_by_day")
def q_split_and_label_by_day(spark, sf_dir):
    """Split and label check: each day's test rows, with that day's label index."""
    return _each_day(spark, sf_dir).scored().select("event_id", DAY_COL, LABEL_COL, "indexedLabel")


@query("importances")
def q_importances(spark, sf_dir):
    return _one_day(spark, sf_dir).read("importances")


@query("forest_nodes")
def q_forest_nodes(spark, sf_dir):
    return _one_day(spark, sf_dir).read("nodes")


@query("test_error")
def q_test_error(spark, sf_dir):
    return _one_day(spark, sf_dir).read("test_error")


@query("test_error_by_day")
def q_test_error_by_day(spark, sf_dir):
    return _each_day(spark, sf_dir).test_error()


@query("importances_by_day")
def q_importances_by_day(spark, sf_dir):
    return _each_day(spark, sf_dir).importances()


@query("importances_by_day_wide")
def q_importances_by_day_wide(spark, sf_dir):
    """One row per day, one column per feature: the per-day importances as printed originally."""
    return _each_day(spark, sf_dir).importances_wide()


@query("all_days_test_error")
def q_all_days_test_error(spark, sf_dir):
    return _all_days(spark, sf_dir).read("test_error")


@query("split_count_all_days")
def q_split_count_all_days(spark, sf_dir):
    """Split check: the number of test rows of all days together."""
    return _all_days(spark, sf_dir).read("test_error").select(DAY_COL, "n")


@query("split_and_label_all_days")
def q_split_and_label_all_days(spark, sf_dir):
    """Split and label check: the test rows of all days, with the all-days label index."""
    return _all_days(spark, sf_dir).read("scored").select("event_id", DAY_COL, LABEL_COL, "indexedLabel")


@query("all_days_importances")
def q_all_days_importances(spark, sf_dir):
    return _all_days(spark, sf_dir).read("importances")


# ------------------------------------------------------- one-split forests
# One tree of depth one on all rows and features: its split, predictions, error
# and importances can be written in SQL, so training itself has an oracle.

STUMP = dict(num_trees=1, max_depth=1, feature_subset="all", bootstrap=False)


def _stumps_by_day(spark, sf_dir):
    return _memo(spark, "stump_by_day", sf_dir, lambda: programs.train_each_day(_flows(spark, sf_dir), **STUMP))


def _stump_all_days(spark, sf_dir):
    build = lambda: _Written(spark, "stump-all-days", programs.train_all_days(_flows(spark, sf_dir), **STUMP))
    return _memo(spark, "stump_all_days", sf_dir, build)


def _stumps(spark, sf_dir, kind):
    each, every = _stumps_by_day(spark, sf_dir), _stump_all_days(spark, sf_dir)
    by_day = {"nodes": each.nodes, "scored": each.scored, "importances": each.importances, "test_error": each.test_error}[kind]()
    return by_day, every.read(kind)


@query("stump_nodes")
def q_stump_nodes(spark, sf_dir):
    """Nodes of the one-split trees of each day and of all days: split feature, counts, prediction, gain."""
    by_day, every = _stumps(spark, sf_dir, "nodes")
    nodes = by_day.unionByName(every)
    count = lambda i: F.element_at("class_counts", i).cast("long")
    return nodes.select(
        DAY_COL, "node", "slot", "feature", F.round("gain", 9).alias("gain"), "prediction",
        count(1).alias("n_first_label"), count(2).alias("n_second_label"),
    )


@query("stump_scored")
def q_stump_scored(spark, sf_dir):
    """Test rows of each day's one-split tree, with prediction and decoded tag."""
    by_day, _ = _stumps(spark, sf_dir, "scored")
    return by_day.select("event_id", DAY_COL, LABEL_COL, "indexedLabel", "prediction", "predictedLabel")


@query("stump_scored_all_days")
def q_stump_scored_all_days(spark, sf_dir):
    """Test rows of the one-split tree of all days, with prediction and decoded tag."""
    _, every = _stumps(spark, sf_dir, "scored")
    return every.select("event_id", DAY_COL, LABEL_COL, "indexedLabel", "prediction", "predictedLabel")


@query("stump_test_error")
def q_stump_test_error(spark, sf_dir):
    """Test error of the one-split trees of each day and of all days."""
    by_day, every = _stumps(spark, sf_dir, "test_error")
    names = [DAY_COL, "n", F.round("accuracy", 9).alias("accuracy"), F.round("test_error", 9).alias("test_error")]
    return by_day.select(*names).unionByName(every.select(*names))


@query("stump_importances")
def q_stump_importances(spark, sf_dir):
    """Importances of the one-split trees of each day and of all days."""
    by_day, every = _stumps(spark, sf_dir, "importances")
    return by_day.unionByName(every).select(DAY_COL, "slot", "feature", "importance", "rank")


# ----------------------------------------------------- three-level forests
# One tree of depth three on all rows and features: search at every level, the
# nodes that are put together again and the leaves are written in SQL.

TREE = dict(num_trees=1, max_depth=3, feature_subset="all", bootstrap=False)
TREE_DEPTH = 3


def _trees_by_day(spark, sf_dir):
    return _memo(spark, "tree_by_day", sf_dir, lambda: programs.train_each_day(_flows(spark, sf_dir), **TREE))


def _tree_all_days(spark, sf_dir):
    build = lambda: _Written(spark, "tree-all-days", programs.train_all_days(_flows(spark, sf_dir), **TREE))
    return _memo(spark, "tree_all_days", sf_dir, build)


def _tree_one_day(spark, sf_dir):
    """The one-day program itself."""
    build = lambda: _Written(spark, "tree-one-day", programs.train_day(_flows(spark, sf_dir), ONE_DAY, **TREE))
    return _memo(spark, "tree_one_day", sf_dir, build)


def _tree_rows(nodes):
    """Node rows told by their path from the root (L, R) instead of their number."""
    level = nodes.where("node = 0").select("*", F.lit("").alias("path"))
    out = level
    for _ in range(TREE_DEPTH):
        up = level.where("is_split").select(F.col(DAY_COL).alias("_day"), F.col("path").alias("_path"), F.col("left_child").alias("_l"), F.col("right_child").alias("_r"))
        down = nodes.join(up, (F.col(DAY_COL) == F.col("_day")) & F.col("node").isin(F.col("_l"), F.col("_r")))
        side = F.when(F.col("node") == F.col("_l"), "L").otherwise("R")
        level = down.select(*nodes.columns, F.concat("_path", side).alias("path"))
        out = out.unionByName(level)
    count = lambda i: F.element_at("class_counts", i).cast("long")
    return out.select(
        DAY_COL, "path", "is_split", "slot", "feature", "threshold", F.round("gain", 9).alias("gain"), "prediction",
        count(1).alias("n_first_label"), count(2).alias("n_second_label"),
    )


@query("tree_nodes")
def q_tree_nodes(spark, sf_dir):
    """Nodes of the three-level trees of each day and of all days: split, threshold, gain, prediction, counts."""
    nodes = _trees_by_day(spark, sf_dir).nodes()
    return _tree_rows(nodes.unionByName(_tree_all_days(spark, sf_dir).read("nodes")))


@query("tree_nodes_one_day")
def q_tree_nodes_one_day(spark, sf_dir):
    """Nodes of the one-day program's three-level tree."""
    return _tree_rows(_tree_one_day(spark, sf_dir).read("nodes"))


@query("tree_scored")
def q_tree_scored(spark, sf_dir):
    """Test rows of each day's three-level tree, with prediction and decoded tag."""
    return _trees_by_day(spark, sf_dir).scored().select("event_id", DAY_COL, LABEL_COL, "indexedLabel", "prediction", "predictedLabel")


@query("tree_scored_one_day")
def q_tree_scored_one_day(spark, sf_dir):
    """Test rows of the one-day program's three-level tree."""
    return _tree_one_day(spark, sf_dir).read("scored").select("event_id", DAY_COL, LABEL_COL, "indexedLabel", "prediction", "predictedLabel")


@query("tree_scored_all_days")
def q_tree_scored_all_days(spark, sf_dir):
    """Test rows of the three-level tree of all days."""
    return _tree_all_days(spark, sf_dir).read("scored").select("event_id", DAY_COL, LABEL_COL, "indexedLabel", "prediction", "predictedLabel")


@query("tree_sample")
def q_tree_sample(spark, sf_dir):
    """The sample that the one-day program shows: decoded prediction, tag and assembled features (a row per slot)."""
    sample = _tree_one_day(spark, sf_dir).read("sample")
    return sample.select("event_id", "predictedLabel", LABEL_COL, F.posexplode("features").alias("slot", "value"))


@query("train_rows_kept")
def q_train_rows_kept(spark, sf_dir):
    """Rows in, training rows and test rows when the preparation is fitted on training rows only."""
    def build():
        flows = _flows(spark, sf_dir)
        run = programs.train_all_days(flows, fit_on="train", num_trees=1, max_depth=1)
        try:
            path = f"{scratch_path(spark, 'train-rows')}"
            run.prepared.groupBy("part").agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
        finally:
            run.release()
        return path

    counts = spark.read.parquet(_memo(spark, "train_rows", sf_dir, build))
    total = lambda part: F.sum(F.when(F.col("part") == part, F.col("n"))).alias(f"n_{part}")
    return counts.agg(F.sum("n").alias("n_rows"), total("train"), total("test"))
