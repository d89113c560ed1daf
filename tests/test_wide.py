"""What keeps the driver and the tasks small: preparations of all days at once, index tables, numeric buckets, the forest's width."""

import random

import pytest
from pyspark.sql import functions as F

from flowdetect.operators import prepare as pr
from flowdetect.operators.coarsen import prepare_flows
from flowdetect.operators.index_table import fit_index_table
from flowdetect.plans import layout, programs
from flowdetect.schema import LONG_COLS
from flowdetect.sources.events import read_event_flows

from tests.fixtures import flows

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def _days(spark, scratch, coarse):
    path = scratch("day-values")
    pr.write_day_values(coarse, "day", path)
    return spark.read.schema("kind string, col string, value string, n long, rank int, day string").parquet(path)


def test_preparations_of_all_days_equal_the_fitted_ones(spark, scratch):
    rows = [{"day": "Jun12", "totalSourcePackets": k % 9, "sourcePort": k, "appName": f"a{k % 4}"} for k in range(30)]
    rows += [{"day": "Jun13", "totalSourcePackets": -k, "appName": None, "Tag": "Attack"} for k in range(12)] + [{"day": "Jun14"}]
    for coarse in (prepare_flows(read_event_flows(spark, SF001)), prepare_flows(flows(spark, rows))):
        values = _days(spark, scratch, coarse)
        for day in ("Jun12", "Jun13", "Jun14"):
            mine = coarse.where(F.col("day") == day)
            got, fitted = pr.preparation_of_day(values.where(F.col("day") == day).drop("day"), coarse.schema), pr.fit_preparation(mine)
            assert [list(v) for v in got.string_indexer.labelsArray] == [list(v) for v in fitted.string_indexer.labelsArray]
            assert {int(k): dict(v) for k, v in got.vector_indexer.categoryMaps.items()} == {int(k): dict(v) for k, v in fitted.vector_indexer.categoryMaps.items()}
            assert got.max_arity() == fitted.max_arity()
            a, b = got.transform(mine), fitted.transform(mine)
            assert a.schema[pr.INDEXED_FEATURES_COL].metadata == b.schema[pr.INDEXED_FEATURES_COL].metadata
            assert a.select("event_id", pr.LABEL_INDEX_COL, pr.INDEXED_FEATURES_COL).exceptAll(b.select("event_id", pr.LABEL_INDEX_COL, pr.INDEXED_FEATURES_COL)).count() == 0
        assert pr.preparation_of_day(values.where("day = 'Jul01'").drop("day"), coarse.schema) is None


def test_every_day_without_the_common_pass_is_the_same(spark, monkeypatch):
    flow_rows = read_event_flows(spark, SF001)
    one = programs.train_each_day(flow_rows, ["Jun12", "Jun14"], num_trees=2, max_depth=3)
    monkeypatch.setattr(pr, "MAX_LISTED_VALUES", 5)  # too many to list: every day fits its own
    other = programs.train_each_day(flow_rows, ["Jun12", "Jun14"], num_trees=2, max_depth=3)
    key = ["day", "tree", "node", "feature", "threshold", "gain", "prediction"]
    assert sorted(map(str, one.nodes().select(*key).collect())) == sorted(map(str, other.nodes().select(*key).collect()))
    with pytest.raises(ValueError, match="no flows"):
        programs.train_each_day(flow_rows, ["Jul01"], num_trees=1)


def test_runs_leave_nothing_cached(spark):
    spark.catalog.clearCache()
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = held()
    flow_rows = read_event_flows(spark, SF001)
    programs.train_each_day(flow_rows, ["Jun12", "Jun14"], num_trees=1, max_depth=1)
    run = programs.train_day(flow_rows, "Jun14", num_trees=1, max_depth=1)
    assert held() > before  # the prepared rows, until they are released
    run.release()
    assert held() == before
    with pytest.raises(ValueError):
        programs.train_day(flow_rows, "Jul01")
    assert held() == before


def test_width_follows_the_rows():
    assert [layout.forest_buckets(n) for n in (0, 4_000_000, 4_000_001, 10_000_000, 1 << 60)] == [8, 16, 32, 64, layout.MAX_BUCKETS]


def test_same_wide_forest_from_any_layout(spark, monkeypatch):
    monkeypatch.setattr(layout, "BUCKET_ROWS", 20)
    flow_rows = read_event_flows(spark, SF001)
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    seen = set()
    for width, parts in (("3", 1), ("8", 40), ("200", 7)):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        try:
            run = programs.train_all_days(flow_rows.repartition(parts), num_trees=3, max_depth=3)
            assert run.prepared.rdd.getNumPartitions() == 64  # 1,000 rows of 20 a bucket
            seen.add(run.forest.toDebugString.split("\n", 1)[1])
            run.release()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    assert len(seen) == 1


def test_numeric_buckets(spark):
    values = [*range(100), *[7] * 50, None]
    df = prepare_flows(flows(spark, [{"totalSourceBytes": v, "sourcePort": 3} for v in values]))
    got = {(r["totalSourceBytes"]): r["b"] for r in pr.bucket_numbers(df.withColumn("keep", F.col("totalSourceBytes")), 10).select(F.col("keep").alias("totalSourceBytes"), F.col("totalSourceBytes").alias("b")).collect()}
    assert got.pop(None) is None
    order = [got[v] for v in range(100)]
    assert order == sorted(order) and order[0] == 0 and len(set(order)) <= 10
    assert got[7] < got[8]  # a heavy value closes its bucket
    assert pr.bucket_numbers(df, 10).select("sourcePort").distinct().count() == 1


def test_forest_on_numeric_buckets_is_about_as_right(spark):
    flow_rows = read_event_flows(spark, SF01)
    errors = []
    for buckets in (None, 64):
        run = programs.train_all_days(flow_rows, num_trees=8, numeric_buckets=buckets)
        errors.append(run.test_error().first()["test_error"])
        if buckets:
            widest = run.prepared.select(F.posexplode(programs.vector_to_array(pr.FEATURES_COL)).alias("slot", "v")).where(f"slot >= {15 - len(LONG_COLS)}")
            assert widest.groupBy("slot").agg(F.countDistinct("v").alias("n")).agg(F.max("n")).first()[0] <= 64
        run.release()
    assert errors[1] <= errors[0] + 0.01


def test_index_table_equals_the_indexer(spark):
    rng = random.Random(3)
    rows = [{"appName": "hot" if rng.random() < 0.4 else f"v{rng.randrange(300)}", "direction": rng.choice("LRé"), "event_id": k} for k in range(3_000)]
    coarse = prepare_flows(flows(spark, rows))
    ranks = fit_index_table(coarse, ["appName", "direction"])
    fitted = pr.fit_preparation(coarse)
    for c, labels in zip(["Tag", *fitted.text_cols], fitted.string_indexer.labelsArray):
        if c in ranks.cols:
            got = ranks.table().where(F.col("col") == c).orderBy("idx").collect()
            assert [r["value"] for r in got] == list(labels) and [r["idx"] for r in got] == [float(i) for i in range(len(labels))]
    expected = fitted.transform(coarse).select("event_id", "appName_index", "direction_index")
    for hot in (2, 10_000):
        coded = ranks.encode(coarse, hot_values=hot).select("event_id", "appName_index", "direction_index")
        assert coded.count() == 3_000 and coded.exceptAll(expected).count() == 0
    unseen = ranks.encode(spark.createDataFrame([("new", None), ("hot", "L")], "appName string, direction string"), hot_values=0)
    assert {(r["appName"], r["appName_index"] is None, r["direction_index"] is None) for r in unseen.collect()} == {("new", True, True), ("hot", False, False)}
    assert fit_index_table(coarse.limit(0), ["appName"]).table().count() == 0
