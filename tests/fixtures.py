"""Small flow tables built in tests (edge cases), in the flow schema."""

from __future__ import annotations

from flowdetect.schema import DAY_COL, FLOW_COLS, FLOW_SCHEMA
from pyspark.sql import types as T

BASE = {
    "Tag": "Normal",
    "appName": "HTTPWeb",
    "destination": "10.0.0.1",
    "destinationPort": 80,
    "destinationTCPFlagsDescription": "S,A",
    "direction": "L2R",
    "protocolName": "tcp_ip",
    "source": "192.168.1.1",
    "sourcePort": 1024,
    "sourceTCPFlagsDescription": "S,A",
    "startDateTime": "2010-06-12T07:01:02",
    "stopDateTime": "2010-06-12T08:01:09",
    "totalDestinationBytes": 100,
    "totalDestinationPackets": 1,
    "totalSourceBytes": 10,
    "totalSourcePackets": 1,
}

SCHEMA = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField(DAY_COL, T.StringType()), *FLOW_SCHEMA.fields]
)


def flows(spark, rows: list[dict], day: str = "Jun12"):
    data = []
    for i, r in enumerate(rows):
        full = {**BASE, **r}
        data.append((full.get("event_id", i), full.get(DAY_COL, day), *[full[c] for c in FLOW_COLS]))
    return spark.createDataFrame(data, SCHEMA)
