"""Indicators over phased lookbacks, as native column expressions, and the identities of their columns."""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import Enum
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from candlespark.columns import require_absent
from candlespark.duration import Duration, positive_duration
from candlespark.errors import ConfigError, DataValidationError, bounded_echo
from candlespark.operators.phased import FIELDS, PhasedLookback

BANNED_NAME_PART = "close_time"
_INDICATOR = re.compile("[a-z][a-z0-9]*")
_COLUMN = re.compile("([a-z][a-z0-9]*)_([a-z])([0-9]+)_w(.+)")


class FeatureFamily(Enum):
    PHASED = "p"
    DENSE = "d"


class NormalizationClass(Enum):
    BOUNDED_BY_CONSTRUCTION = "bounded_by_construction"
    STATIONARIZED = "stationarized"
    EMPIRICALLY_NORMALIZED = "empirically_normalized"


def _period(value: object) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ConfigError(f"period must be a positive int, got {bounded_echo(value)}")
    return value


@dataclass(frozen=True)
class FeatureIdentity:
    """What a feature column is; its name is derived from this and read back into it."""

    indicator: str
    family: FeatureFamily
    period: int
    window: Duration
    normalization: NormalizationClass

    def __post_init__(self) -> None:
        if not isinstance(self.indicator, str) or BANNED_NAME_PART in self.indicator or not _INDICATOR.fullmatch(self.indicator):
            raise ConfigError(f"an indicator name is lower-case letters and digits, got {bounded_echo(self.indicator)}")
        if not isinstance(self.family, FeatureFamily) or not isinstance(self.normalization, NormalizationClass):
            raise ConfigError("family and normalization must be FeatureFamily and NormalizationClass members")
        _period(self.period)
        object.__setattr__(self, "window", positive_duration(self.window, "window"))

    @property
    def column_name(self) -> str:
        return f"{self.indicator}_{self.family.value}{self.period}_w{self.window}"

    @classmethod
    def parse(cls, column: str, *, normalization: NormalizationClass) -> FeatureIdentity:
        """Read a column name; the window must be spelled canonically, or two names would be one feature."""
        match = _COLUMN.fullmatch(column) if isinstance(column, str) and BANNED_NAME_PART not in column else None
        if match is None:
            raise ConfigError(f"{bounded_echo(column)} is no feature column; they look like rsi_p14_w21m")
        try:
            family = FeatureFamily(match[2])
        except ValueError:
            raise ConfigError(f"unknown feature family {match[2]!r}; known: {[m.value for m in FeatureFamily]}") from None
        window = Duration.parse(match[4])
        if str(window) != match[4] or str(int(match[3])) != match[3]:
            raise ConfigError(f"{bounded_echo(column)} is not spelled canonically")
        return cls(match[1], family, int(match[3]), window, normalization)


def effective_history(lookback: int, window: Duration | str) -> Duration:
    """L * W."""
    return Duration(_period(lookback) * positive_duration(window, "window").total_seconds)


def effective_n(history_range: Duration | str, window: Duration | str, lookback: int) -> int:
    """How many disjoint lookbacks a range of history holds."""
    return positive_duration(history_range, "history_range").total_seconds // positive_duration(window, "window").total_seconds // _period(lookback)


class IndicatorPrimitive(Protocol):
    """A named function of phased arrays (newest first). ``positive`` fields must be above zero, or the data are refused."""

    name: str
    normalization: NormalizationClass
    fields: tuple[str, ...]
    positive: tuple[str, ...]

    def lookback(self, period: int) -> int: ...

    def value(self, period: int) -> Column: ...


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


@dataclass(frozen=True)
class CutlersRSI:
    """100 * up / (up + down) over the changes of the last P steps; 50 without any change."""

    name: str = "rsi"
    normalization: NormalizationClass = NormalizationClass.BOUNDED_BY_CONSTRUCTION
    fields: tuple[str, ...] = ("close",)
    positive: tuple[str, ...] = ()

    def lookback(self, period: int) -> int:
        return _period(period) + 1

    def value(self, period: int) -> Column:
        newer, older = F.slice("close", 1, period), F.slice("close", 2, period)
        zero = F.lit(0.0)
        up = _total(F.zip_with(newer, older, lambda n, o: F.greatest(n - o, zero)))
        moved = up + _total(F.zip_with(newer, older, lambda n, o: F.greatest(o - n, zero)))
        return F.when(moved == 0, F.lit(50.0)).when(moved.isNotNull(), F.lit(100.0) * F.try_divide(up, moved))


@dataclass(frozen=True)
class RelativeRange:
    """Mean true range of the last P windows over the newest close."""

    name: str = "relrange"
    normalization: NormalizationClass = NormalizationClass.STATIONARIZED
    fields: tuple[str, ...] = ("high", "low", "close")
    positive: tuple[str, ...] = ("close",)

    def lookback(self, period: int) -> int:
        return _period(period) + 1

    def value(self, period: int) -> Column:
        high, low, close = F.col("high"), F.col("low"), F.col("close")
        true_range = lambda k: F.greatest(F.get(high, k), F.get(close, k + 1)) - F.least(F.get(low, k), F.get(close, k + 1))
        return F.try_divide(_total(F.transform(F.sequence(F.lit(0), F.lit(period - 1)), true_range)) / F.lit(float(period)), F.get(close, F.lit(0)))


@dataclass(frozen=True)
class LogVolumeRatio:
    """ln of the newest volume over the median of the P before it."""

    name: str = "logvolratio"
    normalization: NormalizationClass = NormalizationClass.STATIONARIZED
    fields: tuple[str, ...] = ("volume",)
    positive: tuple[str, ...] = ("volume",)

    def lookback(self, period: int) -> int:
        return _period(period) + 1

    def value(self, period: int) -> Column:
        base = F.sort_array(F.slice("volume", 2, period))
        middle = (F.get(base, F.lit((period - 1) // 2)) + F.get(base, F.lit(period // 2))) / F.lit(2.0)
        return F.log(F.try_divide(F.get(F.col("volume"), F.lit(0)), middle))


@dataclass(frozen=True)
class PriceToMovingAverage:
    """ln of the newest close over the mean of the last P closes."""

    name: str = "mapos"
    normalization: NormalizationClass = NormalizationClass.STATIONARIZED
    fields: tuple[str, ...] = ("close",)
    positive: tuple[str, ...] = ("close",)

    def lookback(self, period: int) -> int:
        return _period(period)

    def value(self, period: int) -> Column:
        return F.log(F.try_divide(F.get(F.col("close"), F.lit(0)), _total(F.slice("close", 1, period)) / F.lit(float(period))))


def indicator_identity(primitive: IndicatorPrimitive, *, period: int, window: Duration | str) -> FeatureIdentity:
    return FeatureIdentity(primitive.name, FeatureFamily.PHASED, period, positive_duration(window, "window"), primitive.normalization)


def require_phased_inputs(primitive: IndicatorPrimitive, phased: PhasedLookback, *, period: int) -> None:
    """Refuse a lookback of another length, or missing or mistyped array columns."""
    needed = primitive.lookback(period)
    if phased.grid.lookback != needed:
        raise ConfigError(f"{primitive.name} of period {period} reads {needed} windows, the lookback has {phased.grid.lookback}")
    types = {f.name: f.dataType for f in phased.frame.schema.fields}
    for name in primitive.fields:
        kind = types.get(name)
        if not isinstance(kind, ArrayType) or kind.elementType != FIELDS[name]:
            raise ConfigError(f"{primitive.name} reads {name} as an array of {FIELDS[name].simpleString()}, the frame has {kind.simpleString() if kind else 'none'}")


def has_missing_input(*fields: str) -> Column:
    """A null array, or a null inside one."""
    out = F.lit(False)
    for name in fields:
        out = out | F.col(name).isNull() | F.coalesce(F.exists(name, lambda x: x.isNull()), F.lit(False))
    return out


def add_indicator(phased: PhasedLookback, primitive: IndicatorPrimitive, *, period: int, strict: bool = True) -> DataFrame:
    """The phased frame with the indicator's column; rows with a missing input are null.

    Inputs that must be positive, and inputs or values that are not finite, are refused with
    :class:`DataValidationError`: ``strict`` counts them in one aggregation first, otherwise the
    expression raises when it is evaluated.
    """
    require_phased_inputs(primitive, phased, period=period)
    name = indicator_identity(primitive, period=period, window=Duration(phased.grid.window)).column_name
    require_absent(phased.frame, (name,))
    missing = has_missing_input(*primitive.fields)
    infinite = F.lit(False)
    for field in primitive.fields:
        infinite = infinite | F.exists(field, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    low = F.lit(False)
    for field in primitive.positive:
        low = low | F.exists(field, lambda x: x <= 0)
    value = primitive.value(period)
    broken = ~missing & (infinite | low | value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf"))))
    if strict:
        row = phased.frame.agg(F.count_if(~missing & low), F.count_if(~missing & ~low & broken)).first()
        if row[0]:
            raise DataValidationError(f"{row[0]} rows give {primitive.name} a value that is not above zero in {primitive.positive}")
        if row[1]:
            raise DataValidationError(f"{row[1]} rows give {primitive.name} an input or value that is not finite")
        return phased.frame.withColumn(name, F.when(~missing, value))
    refused = F.raise_error(F.lit(f"{primitive.name}: an input is not positive or not finite")).cast("double")
    return phased.frame.withColumn(name, F.when(missing, F.lit(None).cast("double")).when(broken, refused).otherwise(value))
