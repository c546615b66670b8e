"""Error taxonomy: three unrelated roots, so a caller can tell its own mistake from bad data."""

from __future__ import annotations

from enum import Enum
from typing import TypeVar

_E = TypeVar("_E", bound=Enum)
ECHO_LIMIT = 80


class ConfigError(ValueError):
    """The call is wrong: parameters, schemas, names. Raised before any job runs where possible."""


class DataValidationError(Exception):
    """The data break a stated contract."""


class CoverageError(Exception):
    """The data are well-formed but too sparse for the stated policy."""


def bounded_echo(value: object, limit: int = ECHO_LIMIT) -> str:
    """``repr`` of untrusted input for a message, cut to ``limit`` characters with a note of its length."""
    shown = repr(value)
    return shown if len(shown) <= limit else f"{shown[:limit]}... ({len(shown)} characters)"


def enum_member(kind: type[_E], value: object, label: str) -> _E:
    """``value`` as a member of ``kind``; a member passes, its value is looked up, all else is refused."""
    if isinstance(value, kind):
        return value
    if not isinstance(value, str):
        raise ConfigError(f"{label} must be a str, got {type(value).__name__}")
    try:
        return kind(value)
    except ValueError:
        raise ConfigError(f"unknown {label} {bounded_echo(value)}; known: {[m.value for m in kind]}") from None
