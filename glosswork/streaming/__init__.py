"""Structured Streaming jobs."""

from glosswork.streaming.best import stream_best
from glosswork.streaming.prepare import read_text_stream, stream_prepare
from glosswork.streaming.replay import stream_replay
from glosswork.streaming.rollup import stream_metric_rollup, windowed_means

__all__ = ["stream_best", "read_text_stream", "stream_metric_rollup", "stream_prepare", "stream_replay", "windowed_means"]
