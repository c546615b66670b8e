"""Calendar decomposition of Unix seconds: UTC by construction, no time zone to configure."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlespark.columns import LONG, require_absent, require_types

DAY, WEEK = 86_400, 604_800
#: The epoch was a Thursday: three days after the Monday that begins its week.
EPOCH_OFFSET = 3 * DAY
CALENDAR_COLUMNS = ("cal_mod_sin", "cal_mod_cos", "cal_dow_sin", "cal_dow_cos")


def second_of_day(t: Column | int) -> Column | int:
    """0 to 86399, also before the epoch."""
    return F.pmod(t, F.lit(DAY)) if isinstance(t, Column) else t % DAY


def second_of_week(t: Column | int) -> Column | int:
    """Seconds since Monday 00:00 UTC."""
    return F.pmod(t + F.lit(EPOCH_OFFSET), F.lit(WEEK)) if isinstance(t, Column) else (t + EPOCH_OFFSET) % WEEK


def day_of_week(t: Column | int) -> Column | int:
    """Monday 0 to Sunday 6."""
    if isinstance(t, Column):
        return F.floor(second_of_week(t) / F.lit(DAY)).cast("long")
    return second_of_week(t) // DAY


def add_calendar_columns(df: DataFrame, column: str = "close_time") -> DataFrame:
    """Append sine and cosine of the second of the day and of the week as points on circles."""
    require_types(df, {column: LONG})
    require_absent(df, CALENDAR_COLUMNS)
    day = second_of_day(F.col(column)).cast("double") * F.lit(math.tau / DAY)
    week = second_of_week(F.col(column)).cast("double") * F.lit(math.tau / WEEK)
    return df.select("*", *(f(x).alias(n) for n, (f, x) in zip(CALENDAR_COLUMNS, ((F.sin, day), (F.cos, day), (F.sin, week), (F.cos, week)))))
