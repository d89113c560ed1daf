"""The original workflow end to end: XML day files -> Parquet by day -> statistics -> forests."""

import math

from pyspark.sql import functions as F

from flowdetect.operators.coarsen import select_flows
from flowdetect.operators.stats import flow_stats
from flowdetect.plans import programs
from flowdetect.schema import DAYS, FLOW_COLS
from flowdetect.sources.events import read_event_flows
from flowdetect.sources.xml import write_flow_days


def test_xml_to_forests(spark, scratch):
    source = select_flows(read_event_flows(spark, "/root/testdata/sf0.001"))
    xml_base = scratch("e2e-xml")
    write_flow_days(source, xml_base, columns=FLOW_COLS)  # the dataset's layout: no key column

    flows = programs.ingest_days(spark, xml_base, scratch("e2e-parquet"))
    assert flows.count() == source.count()

    stats = {(r["day"], r["Tag"]): r["count"] for r in flow_stats(flows).collect()}
    expected = {(r["day"], r["Tag"]): r["count"] for r in flow_stats(source).collect()}
    assert stats == expected

    res = programs.train_each_day(flows, num_trees=4, split_key=None)
    errors = {r["day"]: r for r in res.test_error().collect()}
    assert set(errors) == set(DAYS)
    assert sum(r["n"] for r in errors.values()) > 0
    sums = res.importances().groupBy("day").agg(F.sum("importance").alias("s")).collect()
    assert all(math.isclose(r["s"], 1.0, abs_tol=1e-9) or r["s"] == 0.0 for r in sums)
