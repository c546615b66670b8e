"""Durations: exact whole seconds with a compact spelling such as ``1h15m``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from candlespark.errors import ConfigError, bounded_echo

#: Unit letters in descending order, with their seconds.
UNITS = {"w": 604_800, "d": 86_400, "h": 3_600, "m": 60, "s": 1}
_SPELLING = re.compile("".join(rf"(?:([0-9]+){u})?" for u in UNITS))
_LOOSE = re.compile(r"(?:[0-9]+[wdhms])+")
_MAX_DIGITS = 4000


@dataclass(frozen=True, order=True)
class Duration:
    """A non-negative number of whole seconds; ordered and hashable."""

    total_seconds: int

    def __post_init__(self) -> None:
        if isinstance(self.total_seconds, bool) or not isinstance(self.total_seconds, int):
            raise ConfigError(f"a duration holds whole seconds as an int, got {type(self.total_seconds).__name__}")
        if self.total_seconds < 0:
            raise ConfigError(f"a duration cannot be negative, got {bounded_echo(self.total_seconds)}")

    @classmethod
    def parse(cls, text: str) -> Duration:
        """Components in strictly descending units, each once: ``<digits><unit>``, ASCII, case-sensitive."""
        if not isinstance(text, str):
            raise ConfigError(f"duration text must be a str, got {type(text).__name__}")
        match = _SPELLING.fullmatch(text) if text else None
        if match is None:
            if _LOOSE.fullmatch(text):
                raise ConfigError(f"duration units must be strictly descending (w>d>h>m>s), got {bounded_echo(text)}")
            raise ConfigError(f"invalid duration {bounded_echo(text)}")
        amounts = [a or "0" for a in match.groups()]
        if max(map(len, amounts)) > _MAX_DIGITS:
            raise ConfigError(f"duration amount has too many digits: {bounded_echo(text)}")
        return cls(sum(int(a) * s for a, s in zip(amounts, UNITS.values())))

    def __str__(self) -> str:
        rest, parts = self.total_seconds, []
        for unit, seconds in UNITS.items():
            n, rest = divmod(rest, seconds)
            if n:
                parts.append(f"{n}{unit}")
        return "".join(parts) or "0s"


def coerce_duration(value: Duration | str, label: str = "duration") -> Duration:
    """A :class:`Duration` or its spelling; a bare number is refused, since its unit would be a guess."""
    if isinstance(value, Duration):
        return value
    if isinstance(value, str):
        return Duration.parse(value)
    raise ConfigError(f"{label} must be a Duration or a duration string, got {type(value).__name__}")


def positive_duration(value: Duration | str, label: str) -> Duration:
    """A duration of at least one second."""
    out = coerce_duration(value, label)
    if out.total_seconds == 0:
        raise ConfigError(f"{label} must be longer than zero, got {out}")
    return out


def validate_window_duration(value: Duration | str) -> Duration:
    return positive_duration(value, "window")


def validate_horizon_duration(value: Duration | str) -> Duration:
    return positive_duration(value, "horizon")


def validate_cadence(value: Duration | str) -> Duration:
    return positive_duration(value, "cadence")
