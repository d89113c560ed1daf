"""Text coarsening as built-in Column expressions (stay inside codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowdetect.schema import ADDRESS_PARTS, HOUR_LENGTH, HOUR_START


def address_prefix(col: str | Column, parts: int = ADDRESS_PARTS) -> Column:
    """The first ``parts`` dot-separated parts of an address.

    Splitting on dots and dropping trailing empty parts, then re-joining the
    first two: ``192.168.1.1`` -> ``192.168``, ``a.`` -> ``a``, ``a..b`` -> ``a.``,
    ``...`` -> ``""``; text without dots (``N/A``, ``fe80::1``) stays whole.
    Trailing dots are trimmed first, which is what dropping trailing empty
    parts amounts to.
    """
    if isinstance(col, str):
        # the SQL form of a right trim of dots (the same expression as the
        # two-argument rtrim, whose function-call form is deprecated)
        trimmed = F.expr(f"trim(TRAILING '.' FROM `{col}`)")
    else:
        trimmed = F.rtrim(col, F.lit("."))
    return F.substring_index(trimmed, ".", parts)


def hour_text(col: str | Column) -> Column:
    """Characters 12-13 of a ``yyyy-MM-ddTHH:mm:ss`` text: the hour (P5).

    Shorter text gives ``""`` (the ``N/A`` filler becomes empty).
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.substring(c, HOUR_START, HOUR_LENGTH)
