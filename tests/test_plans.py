"""Scale properties of the physical plans (what .explain shows)."""

import re

from pyspark.sql import functions as F

from flowdetect.operators.coarsen import min_max_scale, prepare_flows
from flowdetect.operators.prepare import feature_index_report, fit_preparation
from flowdetect.operators.stats import flow_stats, tag_counts
from flowdetect.plans.layout import place_by_key
from flowdetect.sources.events import read_event_flows

SF = "/root/testdata/sf0.01"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> list[str]:
    return re.findall(r"Exchange (\w+\([^)]*\)|SinglePartition)", text)


def test_stats_one_shuffle_on_aggregated_rows(spark):
    text = plan(tag_counts(read_event_flows(spark, SF)))
    assert len(exchanges(text)) == 1
    assert "partial_count" in text  # map-side combine before the shuffle
    read = text.split("ReadSchema: ")[1].split("\n")[0]
    assert "props" not in read and "user_id" not in read  # only the columns needed


def test_flow_stats_shares_from_aggregated_rows(spark):
    from pyspark.sql import functions as F

    text = plan(flow_stats(read_event_flows(spark, SF)))
    assert "Window" not in text and "Join" not in text
    assert "partial_count" in text
    # a constant day (one day's file) needs no window either
    one_day = read_event_flows(spark, SF).withColumn("day", F.lit("Jun12"))
    assert "Window" not in plan(flow_stats(one_day))


def test_min_max_never_shuffles_rows_on_day(spark):
    f = read_event_flows(spark, SF).select("event_id", "day", "totalDestinationBytes")
    text = plan(min_max_scale(f))
    assert "BroadcastHashJoin" in text
    assert not any("hashpartitioning(day" in e for e in exchanges(text))


def test_feature_frequencies_partial_aggregation(spark):
    coarse = prepare_flows(read_event_flows(spark, SF))
    prep = fit_preparation(coarse)
    text = plan(feature_index_report(prep.transform(coarse), prep.text_cols))
    assert "partial_count" in text
    assert "PythonUDF" not in text and "EvalPython" not in text


def test_rows_are_placed_by_key_alone(spark):
    placed = []
    for n in (1, 20, 300):
        df = place_by_key(spark.range(0, 1000, numPartitions=n).withColumnRenamed("id", "event_id"), partitions=8)
        assert df.rdd.getNumPartitions() == 8
        placed.append([[r[0] for r in part] for part in df.rdd.glom().collect()])
    assert placed[0] == placed[1] == placed[2]


def test_union_of_days_prunes_partitions(spark, scratch):
    from flowdetect.operators.coarsen import select_flows
    from flowdetect.sources.parquet import read_flows, write_flows_by_day

    path = write_flows_by_day(select_flows(read_event_flows(spark, "/root/testdata/sf0.001")), scratch("prune"))
    one = read_flows(spark, path).where(F.col("day") == "Jun13").select("event_id")
    text = plan(one)
    assert "PartitionFilters" in text and "Jun13" in text
    assert "ReadSchema: struct<event_id:bigint>" in text


def test_top_values_limit_groups_before_shuffle(spark):
    from flowdetect.operators.prepare import top_values

    coarse = prepare_flows(read_event_flows(spark, SF))
    text = plan(top_values(coarse, ["source", "destination"], 4))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_collect_bounded(spark):
    from flowdetect.plans.bounded import collect_bounded

    df = spark.range(0, 10)
    assert len(collect_bounded(df, 10)) == 10
    assert collect_bounded(df, 9) is None  # never more than max_rows + 1 rows are fetched
