"""What a candle source declares about itself: columns, cadence, phase."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from enum import Enum
from types import MappingProxyType

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType

from candlespark.duration import Duration, validate_cadence
from candlespark.errors import ConfigError, bounded_echo

OHLCV = ("open", "high", "low", "close", "volume")


class Availability(Enum):
    """When a candle may be used."""

    CLOSE_TIME = "close_time"


class ColumnKind(Enum):
    """Kinds of declared columns; decimals are neither."""

    INTEGER = "integer"
    FLOATING = "floating"

    def matches(self, kind: DataType) -> bool:
        family = (ByteType, ShortType, IntegerType, LongType) if self is ColumnKind.INTEGER else (FloatType, DoubleType)
        return isinstance(kind, family)

    @property
    def read_as(self) -> DataType:
        return LongType() if self is ColumnKind.INTEGER else DoubleType()


@dataclass(frozen=True)
class SourceProfile:
    """Frozen declaration of a source. Timestamps are interval opens in Unix seconds."""

    name: str
    timestamp_column: str
    availability: Availability
    raw_schema: Mapping[str, ColumnKind]
    cadence: Duration
    phase_seconds: int = 0

    def __post_init__(self) -> None:
        if not isinstance(self.name, str) or not self.name:
            raise ConfigError("a profile needs a name")
        if not isinstance(self.availability, Availability):
            raise ConfigError("availability must be an Availability")
        object.__setattr__(self, "raw_schema", MappingProxyType(dict(self.raw_schema)))
        if not all(isinstance(k, str) and isinstance(v, ColumnKind) for k, v in self.raw_schema.items()):
            raise ConfigError("raw_schema maps column names to ColumnKind members")
        if len({k.lower() for k in self.raw_schema}) < len(self.raw_schema):
            raise ConfigError("raw_schema has names that differ in case only")
        object.__setattr__(self, "cadence", validate_cadence(self.cadence))
        if self.raw_schema.get(self.timestamp_column) is not ColumnKind.INTEGER:
            raise ConfigError(f"the timestamp column {bounded_echo(self.timestamp_column)} must be declared INTEGER")
        if isinstance(self.phase_seconds, bool) or not isinstance(self.phase_seconds, int) or not 0 <= self.phase_seconds < self.cadence.total_seconds:
            raise ConfigError(f"phase must be an int in [0, {self.cadence.total_seconds}), got {bounded_echo(self.phase_seconds)}")

    @classmethod
    def create(cls, *, name: str, timestamp_column: str, raw_schema: Mapping[str, ColumnKind], cadence: Duration | str, phase: Duration | str | int = 0, availability: Availability = Availability.CLOSE_TIME) -> SourceProfile:
        """A profile from spelled durations."""
        seconds = phase if isinstance(phase, int) else (Duration.parse(phase) if isinstance(phase, str) else phase).total_seconds
        return cls(name, timestamp_column, availability, raw_schema, validate_cadence(cadence), seconds)

    def derive_interval_bounds(self, df: DataFrame) -> DataFrame:
        """Two long columns, ``open_time`` and ``close_time``, of the half-open candle intervals."""
        opened = F.col(self.timestamp_column).cast("long")
        return df.select(opened.alias("open_time"), (opened + F.lit(self.cadence.total_seconds)).alias("close_time"))


def candle_profile(name: str, cadence: Duration | str, phase: int = 0) -> SourceProfile:
    """The usual six columns: timestamp and OHLCV."""
    schema = {"timestamp": ColumnKind.INTEGER} | {c: ColumnKind.FLOATING for c in OHLCV}
    return SourceProfile.create(name=name, timestamp_column="timestamp", raw_schema=schema, cadence=cadence, phase=phase)


#: The published one-minute BTC/USD history.
BITSTAMP_BTCUSD_1M = candle_profile("bitstamp-btcusd-1m", "1m")


def require_source_columns(df: DataFrame, profile: SourceProfile) -> None:
    """Refuse a profile that does not declare OHLCV, or a frame that lacks its columns."""
    undeclared = [c for c in OHLCV if c not in profile.raw_schema]
    if undeclared:
        raise ConfigError(f"profile {profile.name} does not declare {undeclared}")
    missing = [c for c in (profile.timestamp_column, *OHLCV) if c not in df.columns]
    if missing:
        raise ConfigError(f"the frame lacks {missing} of profile {profile.name}")
