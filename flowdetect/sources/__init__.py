"""Sources and sinks: derived flows, XML day files, Parquet by day, CSV."""

from flowdetect.sources.csv import csv_ready, read_prepared_csv, write_prepared_csv
from flowdetect.sources.events import flows_from_events, read_event_flows
from flowdetect.sources.parquet import read_flows, write_flows_by_day
from flowdetect.sources.xml import read_flow_day, read_flow_days, write_flow_days

__all__ = [
    "csv_ready",
    "flows_from_events",
    "read_event_flows",
    "read_flow_day",
    "read_flow_days",
    "read_flows",
    "read_prepared_csv",
    "write_flow_days",
    "write_flows_by_day",
    "write_prepared_csv",
]
