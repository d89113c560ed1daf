"""Column expressions for the per-row rewrites."""

from flowdetect.functions.text import address_prefix, hour_text

__all__ = ["address_prefix", "hour_text"]
