"""Logging for the library: standard loggers below ``candlespark``, set up from the environment.

CANDLESPARK_LOG_LEVEL picks the level, CANDLESPARK_LOG_JSON=1 serialises records, and
CANDLESPARK_LOG_FILE adds a file.
"""

from __future__ import annotations

import json
import logging
import os
import sys


class _JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()})


def get_logger(name: str) -> logging.Logger:
    """The logger for ``name``; the root handler is installed on first use."""
    root = logging.getLogger("candlespark")
    if not root.handlers:
        handlers: list[logging.Handler] = [logging.StreamHandler(sys.stderr)]
        if path := os.environ.get("CANDLESPARK_LOG_FILE"):
            handlers.append(logging.FileHandler(path))
        plain = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
        for handler in handlers:
            handler.setFormatter(_JsonFormatter() if os.environ.get("CANDLESPARK_LOG_JSON") == "1" else plain)
            root.addHandler(handler)
        root.setLevel(os.environ.get("CANDLESPARK_LOG_LEVEL", "WARNING").upper())
        root.propagate = False
    return root if name == "candlespark" else root.getChild(name.removeprefix("candlespark."))
