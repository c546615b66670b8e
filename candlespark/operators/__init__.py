"""Operators on candle and window frames."""
