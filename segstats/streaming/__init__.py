"""Incremental (Structured Streaming) forms of the counting operators.

The reference processes one static table and has no streaming; these are not
new operators but the same per-value and per-segment counts maintained over a
stream, for tables that keep growing.
"""

from segstats.streaming.counts import stream_rate_by_value, stream_segment_counts

__all__ = ["stream_rate_by_value", "stream_segment_counts"]
