"""Emit grids: schedule resolution and tick arithmetic on epoch-anchored grids."""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from candlespark.duration import Duration, coerce_duration
from candlespark.errors import ConfigError, bounded_echo
from candlespark.sources.profile import SourceProfile


class MaterializationRule(Enum):
    """Which ticks are emitted."""

    SKIP_WARMUP = "skip_warmup"


@dataclass(frozen=True)
class ExplicitRange:
    """Ticks in the half-open range [start, end) of Unix seconds; an empty range is legal."""

    start: int
    end: int

    def __post_init__(self) -> None:
        for name in ("start", "end"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int):
                raise ConfigError(f"range {name} must be an int of Unix seconds, got {type(value).__name__}")
        if self.end < self.start:
            raise ConfigError(f"range end {self.end} is before its start {self.start}")


Materialization = MaterializationRule | ExplicitRange


def coerce_materialization(value: Materialization | str) -> Materialization:
    if isinstance(value, (MaterializationRule, ExplicitRange)):
        return value
    if isinstance(value, str) and value in {m.value for m in MaterializationRule}:
        return MaterializationRule(value)
    raise ConfigError(f"unknown materialization {bounded_echo(value)}; use an ExplicitRange or one of {[m.value for m in MaterializationRule]}")


@dataclass(frozen=True)
class ResolvedSchedule:
    """A checked (window, emit cadence, anchor) over a source, in seconds; the anchor lies in [0, emit)."""

    window: int
    emit: int
    anchor: int
    cadence: int
    phase: int

    @property
    def pane(self) -> int:
        """Seconds whose candles all belong to the same windows."""
        return math.gcd(self.window, self.emit)

    def exploded(self, candles: int) -> float:
        """Rows that so many candles explode to, those of a pane taken together."""
        return candles * self.cadence / self.pane * max(1, self.window / self.emit)

    def first_tick_at_or_after(self, bound: int) -> int:
        return bound + (self.anchor - bound) % self.emit

    def last_tick_at_or_before(self, bound: int) -> int:
        return bound - (bound - self.anchor) % self.emit

    def count_ticks(self, start: int, end: int) -> int:
        first = self.first_tick_at_or_after(start)
        return max(0, -((first - end) // self.emit))

    def tick_at_or_after(self, bound: Column) -> Column:
        return bound + F.pmod(F.lit(self.anchor) - bound, F.lit(self.emit))

    def tick_at_or_before(self, bound: Column) -> Column:
        return bound - F.pmod(bound - F.lit(self.anchor), F.lit(self.emit))


def resolve_schedule(profile: SourceProfile, *, window: Duration | str, emit_every: Duration | str, anchor: Duration | str = "0s") -> ResolvedSchedule:
    """Check a schedule against a source: both at least the cadence and multiples of it, anchor on the source grid."""
    w, e = coerce_duration(window, "window"), coerce_duration(emit_every, "emit_every")
    a, d = coerce_duration(anchor, "anchor").total_seconds, profile.cadence.total_seconds
    for label, value in (("window", w), ("emit_every", e)):
        if value.total_seconds < d:
            raise ConfigError(f"{label} {value} is shorter than the source cadence {profile.cadence}")
    for label, value in (("window", w), ("emit_every", e)):
        if value.total_seconds % d:
            raise ConfigError(f"{label} {value} is no multiple of the source cadence {profile.cadence}")
    a %= e.total_seconds
    if (a - profile.phase_seconds) % d:
        raise ConfigError(f"anchor {Duration(a)} puts ticks off the source grid (cadence {profile.cadence}, phase {profile.phase_seconds}s)")
    return ResolvedSchedule(w.total_seconds, e.total_seconds, a, d, profile.phase_seconds)
