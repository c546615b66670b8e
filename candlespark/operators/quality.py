"""Quality policies over window frames: exact coverage thresholds, as a filter, a gate or a record."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum
from fractions import Fraction
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlespark.columns import LONG, ROW, require_types
from candlespark.duration import Duration, validate_window_duration
from candlespark.errors import ConfigError, CoverageError, bounded_echo, enum_member


class QualityMode(Enum):
    PASS_THROUGH = "pass_through"
    FILTER = "filter"
    GATE = "gate"


class GateMode(Enum):
    STRICT = "strict"
    REPORT = "report"


_KEYS = ("mode", "min_coverage", "min_traded_seconds", "gate_mode")


@dataclass(frozen=True)
class WindowQualityPolicy:
    """What a window must reach: a share of its length covered, and seconds traded."""

    mode: QualityMode
    min_coverage: float = 1.0
    min_traded_seconds: int = 0
    gate_mode: GateMode = GateMode.STRICT

    def __post_init__(self) -> None:
        if not isinstance(self.mode, QualityMode) or not isinstance(self.gate_mode, GateMode):
            raise ConfigError("mode and gate_mode must be QualityMode and GateMode members")
        share = self.min_coverage
        if isinstance(share, bool) or not isinstance(share, (int, float)) or not math.isfinite(share) or not 0 <= share <= 1:
            raise ConfigError(f"min_coverage must be a number from 0 to 1, got {bounded_echo(share)}")
        object.__setattr__(self, "min_coverage", float(share))
        seconds = self.min_traded_seconds
        if isinstance(seconds, bool) or not isinstance(seconds, int) or seconds < 0:
            raise ConfigError(f"min_traded_seconds must be a non-negative int, got {bounded_echo(seconds)}")

    def to_dict(self) -> dict[str, object]:
        return {"mode": self.mode.value, "min_coverage": self.min_coverage, "min_traded_seconds": self.min_traded_seconds, "gate_mode": self.gate_mode.value}

    @classmethod
    def from_dict(cls, data: dict[str, object]) -> WindowQualityPolicy:
        """Read :meth:`to_dict`; a record from before traded seconds were stated has none required."""
        if not isinstance(data, dict):
            raise ConfigError("a policy is read from a mapping")
        data = {"min_traded_seconds": 0} | data
        if set(data) != set(_KEYS):
            raise ConfigError(f"a policy record has exactly {_KEYS}, got {bounded_echo(sorted(map(str, data)))}")
        return cls(enum_member(QualityMode, data["mode"], "quality mode"), data["min_coverage"], data["min_traded_seconds"], enum_member(GateMode, data["gate_mode"], "gate mode"))


def least_passing_seconds(min_coverage: float, window: Duration) -> int:
    """The least whole seconds that reach the share, by exact rational arithmetic on the decimal as written."""
    return math.ceil(Fraction(str(min_coverage)) * window.total_seconds)


@dataclass(frozen=True)
class QualityReport:
    rows: int
    min_coverage_seconds: int
    min_traded_seconds: int
    below_either: int
    below_coverage: int
    below_traded: int
    null_coverage: int
    null_traded: int
    first_offending_close_time: int | None


@dataclass(frozen=True)
class QualityPolicyResult:
    """The frame after the policy, and the counts of the frame before it, which are taken when first asked for."""

    frame: DataFrame
    take_report: Callable[[], QualityReport]

    @cached_property
    def report(self) -> QualityReport:
        return self.take_report()


class WindowCoverageError(CoverageError):
    """A strict gate found windows below its thresholds; ``report`` counts them."""

    def __init__(self, message: str, report: QualityReport):
        super().__init__(message)
        self.report = report


def _below(column: str, least: int) -> Column:
    return F.coalesce(F.col(column) < F.lit(least), F.lit(True))


def quality_report(df: DataFrame, policy: WindowQualityPolicy, window: Duration | str) -> DataFrame:
    """One row: the counts of :class:`QualityReport`, in one aggregation. First means row order where rows are numbered, else close time."""
    w = validate_window_duration(window)
    _require_quality_columns(df)
    least = least_passing_seconds(policy.min_coverage, w)
    low, idle = _below("coverage_seconds", least), _below("traded_seconds", policy.min_traded_seconds)
    order = F.col(ROW) if ROW in df.columns else F.col("close_time")
    return df.agg(
        F.count("*").alias("rows"),
        F.lit(least).cast("long").alias("min_coverage_seconds"),
        F.lit(policy.min_traded_seconds).cast("long").alias("min_traded_seconds"),
        F.count_if(low | idle).alias("below_either"),
        F.count_if(low).alias("below_coverage"),
        F.count_if(idle).alias("below_traded"),
        F.count_if(F.col("coverage_seconds").isNull()).alias("null_coverage"),
        F.count_if(F.col("traded_seconds").isNull()).alias("null_traded"),
        F.min_by("close_time", F.when(low | idle, order)).alias("first_offending_close_time"),
    )


def filter_windows(df: DataFrame, policy: WindowQualityPolicy, window: Duration | str) -> DataFrame:
    """Rows that reach both thresholds; a null reaches none. Stays lazy."""
    w = validate_window_duration(window)
    _require_quality_columns(df)
    return df.where((F.col("coverage_seconds") >= least_passing_seconds(policy.min_coverage, w)) & (F.col("traded_seconds") >= policy.min_traded_seconds))


def apply_quality_policy(df: DataFrame, policy: WindowQualityPolicy, *, window: Duration | str) -> QualityPolicyResult:
    """Apply a policy and report: PASS_THROUGH records, FILTER drops, GATE raises when strict and never drops.

    Only a strict gate runs a job; the others' reports are made when they are read.
    """
    counts = quality_report(df, policy, window)
    take = lambda: QualityReport(**counts.first().asDict())
    if policy.mode is not QualityMode.GATE or policy.gate_mode is not GateMode.STRICT:
        return QualityPolicyResult(filter_windows(df, policy, window) if policy.mode is QualityMode.FILTER else df, take)
    report = take()
    if report.below_either:
        raise WindowCoverageError(
            f"{report.below_either} of {report.rows} windows are below {report.min_coverage_seconds}s covered or {report.min_traded_seconds}s traded, the first at close_time {report.first_offending_close_time}",
            report,
        )
    return QualityPolicyResult(df, lambda: report)


def _require_quality_columns(df: DataFrame) -> None:
    if "traded_seconds" not in df.columns and "coverage_seconds" in df.columns:
        raise ConfigError("the frame has no traded_seconds: it is of the superseded nine-column form; compute its windows again")
    require_types(df, {"close_time": LONG, "coverage_seconds": LONG, "traded_seconds": LONG}, "window frame")
