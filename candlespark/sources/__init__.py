"""Declared sources, strict readers and validation that reports instead of repairing."""
