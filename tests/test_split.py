from pyspark.sql import functions as F

from flowdetect.operators.split import PART_COL, split_threshold, with_split
from flowdetect.sources.events import read_event_flows


def test_threshold():
    assert split_threshold(0.7) == "b3333333"
    assert split_threshold(0.5) == "80000000"


def test_split_share_and_layout_independence(spark):
    flows = read_event_flows(spark, "/root/testdata/sf0.01")
    a = {r["event_id"]: r[PART_COL] for r in with_split(flows).select("event_id", PART_COL).collect()}
    shuffled = flows.repartition(13, "user_id").sortWithinPartitions(F.rand(7))
    b = {r["event_id"]: r[PART_COL] for r in with_split(shuffled).select("event_id", PART_COL).collect()}
    assert a == b
    share = sum(v == "train" for v in a.values()) / len(a)
    assert 0.68 < share < 0.72


def test_split_without_key_uses_row_content(spark):
    flows = read_event_flows(spark, "/root/testdata/sf0.001").drop("event_id")
    key = lambda r: tuple(str(x) for x in r)
    a = sorted(map(tuple, with_split(flows, key=None).collect()), key=key)
    b = sorted(map(tuple, with_split(flows.repartition(5), key=None).collect()), key=key)
    assert a == b


def test_salt_draws_another_split(spark):
    flows = read_event_flows(spark, "/root/testdata/sf0.001")
    a = {r["event_id"]: r[PART_COL] for r in with_split(flows).collect()}
    b = {r["event_id"]: r[PART_COL] for r in with_split(flows, salt="2").collect()}
    assert a != b
    assert 0.6 < sum(v == "train" for v in b.values()) / len(b) < 0.8
