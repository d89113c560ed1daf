"""Flow records derived from the ``events`` table.

The flow dataset itself is external; the test tables carry an ``events``
stream, from which a flow record of the same sixteen columns is derived row by
row (a pure projection: no shuffle, filters and pruning reach the scan).
The tag follows the event type and value, plus a 2 % override on the id, so a
forest can learn it but not perfectly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowdetect.schema import DAY_COL, FLOW_COLS

# Event type -> application, destination port.
APP_BY_EVENT = {
    "click": "HTTPWeb",
    "view": "HTTPImageTransfer",
    "error": "SSH",
    "signup": "DNS",
}
APP_OTHER = "IRC"
PORT_BY_EVENT = {"click": 80, "view": 80, "error": 22, "signup": 53}
PORT_OTHER = 6667


def _case(col: str, mapping: dict, other) -> Column:
    expr = None
    for key, value in mapping.items():
        cond = F.col(col) == F.lit(key)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr.otherwise(F.lit(other))


def _iso_text(ts: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss of a local date-time, fractional seconds dropped.

    Cut from the text of the value, so no time zone is involved.
    """
    text = ts.cast("string")
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8))


def flows_from_events(events: DataFrame) -> DataFrame:
    """``event_id``, ``day`` and the sixteen flow columns, one flow per event."""
    eid = F.col("event_id")
    uid = F.col("user_id")
    etype = F.col("event_type")
    value = F.col("value")
    ts = F.col("ts")
    s = lambda c: c.cast("string")

    cols = {
        DAY_COL: F.concat(F.lit("Jun"), s(F.lit(12) + F.dayofmonth(ts) % 6)),
        "Tag": F.when(((etype == "error") & (value > 10)) | (eid % 50 == 0), "Attack").otherwise("Normal"),
        "appName": _case("event_type", APP_BY_EVENT, APP_OTHER),
        "destination": F.concat(F.lit("10."), s(uid % 5), F.lit(".0."), s(eid % 200)),
        "destinationPort": _case("event_type", PORT_BY_EVENT, PORT_OTHER).cast("bigint"),
        "destinationTCPFlagsDescription": F.when(eid % 7 == 0, F.lit(None).cast("string"))
        .when(eid % 7 < 4, "S,P,A")
        .otherwise("F,S,A"),
        "direction": F.when(eid % 3 == 0, "L2R").when(eid % 3 == 1, "L2L").otherwise("R2L"),
        "protocolName": F.when(etype == "signup", "udp_ip").otherwise("tcp_ip"),
        "source": F.concat(
            s(F.lit(131) + uid % 40), F.lit(".202."), s(uid % 8), F.lit("."), s(uid % 200)
        ),
        "sourcePort": (F.lit(1024) + eid % 4096).cast("bigint"),
        "sourceTCPFlagsDescription": F.when(eid % 9 == 0, F.lit(None).cast("string")).otherwise("S,A"),
        "startDateTime": _iso_text(ts),
        "stopDateTime": _iso_text(F.timestamp_add("SECOND", F.lit(90), ts)),
        "totalDestinationBytes": F.floor(value * 100).cast("bigint"),
        "totalDestinationPackets": (eid % 7).cast("bigint"),
        "totalSourceBytes": F.floor(value * 10).cast("bigint"),
        "totalSourcePackets": (eid % 5).cast("bigint"),
    }
    return events.select(eid.alias("event_id"), *[cols[c].alias(c) for c in [DAY_COL, *FLOW_COLS]])


def read_event_flows(spark, sf_dir: str) -> DataFrame:
    """Flows derived from ``<sf_dir>/events.parquet``."""
    return flows_from_events(spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet"))
