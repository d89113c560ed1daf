"""Streaming forms of the batch operators (statistics, scoring)."""

from flowdetect.streaming.flows import read_flow_stream, score_stream, stream_tag_counts

__all__ = ["read_flow_stream", "score_stream", "stream_tag_counts"]
