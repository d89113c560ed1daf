"""Projection, filling and coarsening of flow rows (P1-P5), min-max scaling.

All of it is one projection of built-in expressions: no shuffle, whole-stage
codegen, and the scan reads only the sixteen flow columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdetect.functions.text import address_prefix, hour_text
from flowdetect.schema import DAY_COL, FILLER, FLOW_COLS
from flowdetect.session import scratch_path

KEY_COLS = ("event_id", DAY_COL)
ADDRESS_COLS = ("destination", "source")
TIME_COLS = ("startDateTime", "stopDateTime")


def select_flows(df: DataFrame, keep: Sequence[str] = KEY_COLS) -> DataFrame:
    """The sixteen flow columns in order, after any key columns present."""
    keys = [c for c in keep if c in df.columns]
    return df.select(*keys, *FLOW_COLS)


def _text_flow_cols(df: DataFrame) -> list[str]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in FLOW_COLS if c in types and isinstance(types[c], T.StringType)]


def fill_missing(df: DataFrame, value: str = FILLER) -> DataFrame:
    """Null text in the flow columns becomes ``N/A``; null numbers stay null."""
    return df.na.fill(value, subset=_text_flow_cols(df))


def coarsen(df: DataFrame) -> DataFrame:
    """Addresses to their first two parts (P4), date-times to the hour (P5)."""
    out = []
    for c in df.columns:
        if c in ADDRESS_COLS:
            out.append(address_prefix(c).alias(c))
        elif c in TIME_COLS:
            out.append(hour_text(c).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def prepare_flows(df: DataFrame, keep: Sequence[str] = KEY_COLS) -> DataFrame:
    """P1, P2 and P3 in the pipeline's order: project, fill, coarsen."""
    return coarsen(fill_missing(select_flows(df, keep)))


def min_max_scale(
    df: DataFrame,
    col: str = "totalDestinationBytes",
    by: Sequence[str] = (DAY_COL,),
    out_col: str | None = None,
) -> DataFrame:
    """``(v - min) / (max - min)`` per group, scaled to 0..1.

    The per-group bounds are a partial aggregation, written as a small table
    (one row per group) and joined null-safely, so rows of a null group are
    scaled too. Spark broadcasts the table when its measured size allows and
    shuffles otherwise. A group with max = min, or without any number, gives null.
    """
    out_col = out_col or f"{col}_scaled"
    keys = list(by)
    bounds = df.groupBy(*keys).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    if not keys:
        # one global pair of bounds: applied as constants, no join
        (row,) = bounds.collect()
        lo, hi = F.lit(row["_lo"]), F.lit(row["_hi"])
        scaled = (F.col(col) - lo) / F.nullif(hi - lo, F.lit(0))
        return df.select(*df.columns, scaled.cast("double").alias(out_col))
    path = scratch_path(df.sparkSession, "bounds")
    bounds.select(*[F.col(k).alias(f"_by_{k}") for k in keys], "_lo", "_hi").write.parquet(path)
    bounds = df.sparkSession.read.parquet(path)
    same = [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in keys]
    joined = df.join(bounds, same, "inner")
    scaled = (F.col(col) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0))
    return joined.select(*df.columns, scaled.cast("double").alias(out_col))
