"""Structured Streaming pipelines."""

from phasegrid.streaming.live import (
    live_points,
    read_windowed_mean,
    stop,
    stream_seconds,
    write_live,
    write_seconds,
)
from phasegrid.streaming.metrics import StreamMetrics, read_stream_metrics

__all__ = [
    "StreamMetrics",
    "live_points",
    "read_stream_metrics",
    "read_windowed_mean",
    "stop",
    "stream_seconds",
    "write_live",
    "write_seconds",
]
