"""Flow record schema, day names and the feature split."""

from __future__ import annotations

from pyspark.sql import types as T

LABEL_COL = "Tag"
DAY_COL = "day"

# The sixteen flow columns, in the order the pipeline projects them.
FLOW_COLS = [
    "Tag",
    "appName",
    "destination",
    "destinationPort",
    "destinationTCPFlagsDescription",
    "direction",
    "protocolName",
    "source",
    "sourcePort",
    "sourceTCPFlagsDescription",
    "startDateTime",
    "stopDateTime",
    "totalDestinationBytes",
    "totalDestinationPackets",
    "totalSourceBytes",
    "totalSourcePackets",
]

# The columns read as 64-bit integers; every other flow column is text.
LONG_COLS = [
    "destinationPort",
    "sourcePort",
    "totalDestinationBytes",
    "totalDestinationPackets",
    "totalSourceBytes",
    "totalSourcePackets",
]

# The six capture files, in dataset order. The file is <name>.xml,
# its row element <name>Flows, and the day label the name without its first
# ten characters ("TestbedSatJun12" -> "Jun12").
DAY_FILES = [
    "TestbedSatJun12",
    "TestbedSunJun13",
    "TestbedMonJun14",
    "TestbedTueJun15",
    "TestbedWedJun16",
    "TestbedThuJun17",
]
DAY_LABEL_OFFSET = 10

# The pipeline settings the results depend on.
FILLER = "N/A"  # text written for a missing text field
ADDRESS_PARTS = 2  # dotted parts kept of an address
HOUR_START, HOUR_LENGTH = 12, 2  # 1-based position of the hour in yyyy-MM-ddTHH:mm:ss
MAX_CATEGORIES = 10  # slots with at most this many values are re-coded as categories
TRAIN_FRACTION = 0.7  # share of rows in the training part
NUM_TREES = 32
MAX_BINS_ONE_DAY = 10_000  # the original fixed bin count for one day, raised where a text column has more values
MAX_BINS_ALL_DAYS = 20_000  # the same for all days together

# Times and addresses are kept as text: the hour is cut from the text and the
# address coarsened on its dotted parts, so no type inference may turn them
# into timestamps.
FLOW_SCHEMA = T.StructType(
    [
        T.StructField(c, T.LongType() if c in LONG_COLS else T.StringType(), True)
        for c in FLOW_COLS
    ]
)


def day_label(file_name: str) -> str:
    return file_name[DAY_LABEL_OFFSET:]


DAYS = [day_label(n) for n in DAY_FILES]


def feature_columns(schema: T.StructType, label_col: str = LABEL_COL) -> tuple[list[str], list[str]]:
    """Split the flow columns present in ``schema`` into (text, integer) features.

    The split goes by type, in flow-column order; the label is never a feature,
    and columns outside the flow record (keys, day) are never features.
    """
    types = {f.name: f.dataType for f in schema.fields}
    present = [c for c in FLOW_COLS if c in types and c != label_col]
    text = [c for c in present if isinstance(types[c], T.StringType)]
    integer = [c for c in present if isinstance(types[c], T.IntegralType)]
    return text, integer
