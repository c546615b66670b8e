"""Streaming extension of the window operator."""

from candlespark.streaming.windows import stream_windows

__all__ = ["stream_windows"]
