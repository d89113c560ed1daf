"""flowdetect: network-flow classification on Spark DataFrames and Spark ML."""

from flowdetect.operators.coarsen import fill_missing, min_max_scale, prepare_flows, select_flows
from flowdetect.operators.prepare import fit_preparation, fold_rare_values
from flowdetect.operators.split import split_by_key, with_split
from flowdetect.operators.stats import flow_count, flow_stats, tag_counts, tag_share
from flowdetect.plans.programs import ingest_days, train_all_days, train_day, train_each_day, train_on
from flowdetect.sources import (
    flows_from_events,
    read_flow_day,
    read_flow_days,
    read_flows,
    write_flows_by_day,
    write_prepared_csv,
)

__version__ = "0.1.0"

__all__ = [
    "fill_missing",
    "fit_preparation",
    "flow_count",
    "flow_stats",
    "flows_from_events",
    "fold_rare_values",
    "ingest_days",
    "min_max_scale",
    "prepare_flows",
    "read_flow_day",
    "read_flow_days",
    "read_flows",
    "select_flows",
    "split_by_key",
    "tag_counts",
    "tag_share",
    "train_all_days",
    "train_day",
    "train_each_day",
    "train_on",
    "with_split",
    "write_flows_by_day",
    "write_prepared_csv",
]
