"""Schema guards: operators add columns, never overwrite any, and name what they miss."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, DoubleType, LongType, StringType

from candlespark.errors import ConfigError

LONG, DOUBLE, STRING = LongType(), DoubleType(), StringType()
#: Position of a row in its source. Only readers know it, so it travels as a column.
ROW = "__row"


def require_absent(df: DataFrame, names: Iterable[str], remedy: str = "rename or drop it first") -> None:
    """Refuse output names that the frame has already; Spark resolves names without regard to case, so case does not save one."""
    if isinstance(names, str):
        raise ConfigError("names must be a sequence of column names, not one str")
    have = {c.lower(): c for c in df.columns}
    taken = [have[n.lower()] for n in names if n.lower() in have]
    if taken:
        raise ConfigError(f"the frame already has {taken[:20]}; {remedy}")


def require_types(df: DataFrame, types: Mapping[str, DataType], what: str = "frame") -> None:
    """Refuse a frame without these columns in exactly these types."""
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [n for n in types if n not in have]
    if missing:
        raise ConfigError(f"the {what} lacks {missing}; it has {list(have)[:20]}")
    wrong = [f"{n} is {have[n].simpleString()}, not {t.simpleString()}" for n, t in types.items() if have[n] != t]
    if wrong:
        raise ConfigError(f"the {what} has columns of other types: {'; '.join(wrong)}")
