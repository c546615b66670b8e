"""Backward and forward returns and forward excursions, aligned by exact close time."""

from __future__ import annotations

from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlespark.columns import DOUBLE, LONG, ROW, require_absent, require_types
from candlespark.duration import Duration, validate_cadence, validate_horizon_duration
from candlespark.errors import ConfigError

INT64 = 2**63
#: Rows whose order one task checks, and horizons of a chunk in which returns are aligned.
STRETCH_ROWS, CHUNK_HORIZONS = 1_000_000, 64


class ReturnMethod(Enum):
    SIMPLE = "simple"
    LOG = "log"


def _require_method(method: ReturnMethod) -> None:
    if not isinstance(method, ReturnMethod):
        raise ConfigError(f"method must be a ReturnMethod, got {type(method).__name__}")


def resolve_horizon(horizon: Duration | str, cadence: Duration | str) -> tuple[Duration, Duration]:
    """Both as durations; the horizon is a whole number of cadences."""
    h, e = validate_horizon_duration(horizon), validate_cadence(cadence)
    if h.total_seconds % e.total_seconds:
        raise ConfigError(f"horizon {h} is no multiple of the cadence {e}")
    return h, e


def _name(kind: str, method: ReturnMethod, horizon: Duration | str) -> str:
    _require_method(method)
    return f"{kind}_{method.value}_{validate_horizon_duration(horizon)}"


def backward_return_column(method: ReturnMethod, horizon: Duration | str) -> str:
    return _name("backward_return", method, horizon)


def forward_return_column(method: ReturnMethod, horizon: Duration | str) -> str:
    return _name("forward_return", method, horizon)


def forward_available_at_column(method: ReturnMethod, horizon: Duration | str) -> str:
    return forward_return_column(method, horizon) + "_available_at"


def forward_mfe_column(method: ReturnMethod, horizon: Duration | str) -> str:
    return _name("forward_mfe", method, horizon)


def forward_mae_column(method: ReturnMethod, horizon: Duration | str) -> str:
    return _name("forward_mae", method, horizon)


def forward_excursion_available_at_column(method: ReturnMethod, horizon: Duration | str) -> str:
    return _name("forward_excursion", method, horizon) + "_available_at"


def return_values(numerator: Column, denominator: Column, method: ReturnMethod) -> Column:
    """(n - d) / d, or log1p of it; anything but a finite number is null."""
    ratio = F.try_divide(numerator - denominator, denominator)
    value = F.log1p(ratio) if method is ReturnMethod.LOG else ratio
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def require_alignable(df: DataFrame, shift: int = 0, extra: tuple[str, ...] = (), grid: int | None = None) -> None:
    """Check columns and types, then in one aggregation: close_time without nulls or repeats, its shift within 64 bits, and with ``grid`` a hole-free grid of so many seconds."""
    require_types(df, {"close_time": LONG, "close": DOUBLE} | {c: DOUBLE for c in extra})
    key = F.col("close_time")
    phase = F.pmod(key, F.lit(grid or 1))
    # a close time comes to one row each before it is counted, so repeats are found by the same shuffle
    each = df.groupBy("close_time").agg(F.count("*").alias("n"))
    row = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.when(key.isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count_if((F.col("n") > 1) & key.isNotNull()).alias("repeats"), F.min(key).alias("low"), F.max(key).alias("high"), (F.min(phase) != F.max(phase)).alias("off")).first()
    if row["nulls"]:
        raise ConfigError(f"close_time has {row['nulls']} nulls; it is the key that rows are aligned by")
    if row["repeats"]:
        raise ConfigError("close_time repeats; rows could not be aligned by it")
    if row["n"] and not (-INT64 <= row["low"] + min(shift, -abs(shift)) and row["high"] + abs(shift) < INT64):
        raise ConfigError(f"close_time shifted by {shift}s leaves the 64-bit range")
    if grid and row["n"] > 1 and (row["off"] or row["high"] - row["low"] != (row["n"] - 1) * grid):
        raise ConfigError(f"the frame is no hole-free grid of {grid}s: {row['n']} rows from {row['low']} to {row['high']}")


def counterpart_closes(df: DataFrame, offsets: dict[str, int]) -> DataFrame:
    """The frame with, under each name, the close exactly so many seconds away; null where no row has that close time.

    Time is cut into chunks of many offsets. A row near a chunk's edge also goes, with its close alone, to the chunks of
    the rows that it is the counterpart of, so one shuffle of little more than the frame serves all offsets and
    the values are read by position in one order. Close times are unique; a row without one has no counterpart.
    """
    at = F.col("close_time")
    width = CHUNK_HORIZONS * max(abs(o) for o in offsets.values())
    chunk = lambda x: F.floor(x / F.lit(width))
    places = F.array_distinct(F.array(chunk(at), *(chunk(at - F.lit(o)) for o in set(offsets.values()))))
    rows = df.select("*", F.explode(places).alias("__chunk"))
    own = F.col("__chunk").eqNullSafe(chunk(at))
    thin = rows.select("__chunk", at.alias("__at"), F.col("close").alias("__close"), own.alias("__own"), *(F.when(own, F.col(c)).alias(c) for c in df.columns))
    order = Window.partitionBy("__chunk").orderBy("__at")
    other = {name: F.first("__close").over(order.rangeBetween(o, o)) for name, o in offsets.items()}
    found = thin.select("__own", *df.columns, *(F.when(F.col("__at").isNotNull(), c).alias(name) for name, c in other.items()))
    return found.where("__own").drop("__own")


def add_returns(df: DataFrame, *, horizon: Duration | str, cadence: Duration | str, method: ReturnMethod, checked: bool = True) -> DataFrame:
    """Backward and forward returns together, as :func:`add_backward_returns` and :func:`add_forward_returns` give them, from one shuffle."""
    _require_method(method)
    h, _ = resolve_horizon(horizon, cadence)
    back, ahead, at = backward_return_column(method, h), forward_return_column(method, h), forward_available_at_column(method, h)
    require_absent(df, (back, ahead, at, "__before", "__after"))
    if checked:
        require_alignable(df, h.total_seconds)
    found = counterpart_closes(df, {"__before": -h.total_seconds, "__after": h.total_seconds})
    values = {back: return_values(F.col("close"), F.col("__before"), method), ahead: return_values(F.col("__after"), F.col("close"), method)}
    return found.select(*df.columns, *(v.alias(n) for n, v in values.items()), (F.col("close_time") + F.lit(h.total_seconds).cast("long")).alias(at))


def add_backward_returns(df: DataFrame, *, horizon: Duration | str, cadence: Duration | str, method: ReturnMethod, checked: bool = True) -> DataFrame:
    """Append the return from ``horizon`` ago to now; causal. ``checked=False`` skips the guard's job for frames of this library."""
    _require_method(method)
    h, _ = resolve_horizon(horizon, cadence)
    name = backward_return_column(method, h)
    require_absent(df, (name, "__other"))
    if checked:
        require_alignable(df, -h.total_seconds)
    return counterpart_closes(df, {"__other": -h.total_seconds}).withColumn(name, return_values(F.col("close"), F.col("__other"), method)).drop("__other")


def add_forward_returns(df: DataFrame, *, horizon: Duration | str, cadence: Duration | str, method: ReturnMethod, checked: bool = True) -> DataFrame:
    """Append the return from now to ``horizon`` ahead, and on every row the instant it may first be read."""
    _require_method(method)
    h, _ = resolve_horizon(horizon, cadence)
    name, at = forward_return_column(method, h), forward_available_at_column(method, h)
    require_absent(df, (name, at, "__other"))
    if checked:
        require_alignable(df, h.total_seconds)
    found = counterpart_closes(df, {"__other": h.total_seconds}).withColumn(name, return_values(F.col("__other"), F.col("close"), method))
    return found.drop("__other").withColumn(at, F.col("close_time") + F.lit(h.total_seconds).cast("long"))


def require_total_grid(df: DataFrame, cadence_seconds: int) -> None:
    """Refuse a frame whose close times are not exactly a hole-free grid of the cadence, or, where rows are numbered, do not ascend with their numbers."""
    require_alignable(df, grid=cadence_seconds)
    require_ascending(df)


def require_ascending(df: DataFrame) -> None:
    """Refuse a frame with row numbers whose close times do not ascend with them; without numbers a frame has no order.

    Each stretch of rows is checked within, and the stretches' edges against one another.
    """
    if ROW not in df.columns:
        return
    stretch = F.floor(F.col(ROW) / F.lit(STRETCH_ROWS))
    rows = df.select(F.col(ROW).alias("r"), "close_time", stretch.alias("b"))
    before = F.lag("close_time").over(Window.partitionBy("b").orderBy("r"))
    inside = rows.withColumn("before", before).groupBy("b").agg(F.count_if(F.col("close_time") <= F.col("before")).alias("bad"), F.min("close_time").alias("low"), F.max("close_time").alias("high"))
    seam = F.coalesce(F.col("low") <= F.lag("high").over(Window.orderBy("b")), F.lit(False))  # a row for each stretch
    bad = inside.withColumn("seam", seam).agg(F.sum(F.col("bad") + F.col("seam").cast("int"))).first()[0]
    if bad:
        raise ConfigError(f"close_time does not ascend with the rows' numbers at {bad} places")


def add_forward_excursions(df: DataFrame, *, horizon: Duration | str, cadence: Duration | str, method: ReturnMethod, checked: bool = True) -> DataFrame:
    """Append favourable and adverse excursions over (t, t + H] against the close at t, and their available_at.

    Time is cut into blocks of one horizon. The interval after t is the rest of t's block and the beginning of the next one, so
    running extremes from the ends of blocks give every interval in one shuffle, whatever the horizon: a bar
    goes to the task of its own block and, one horizon earlier, to that of the block before. A bar with
    a null or NaN high or low nulls every interval that holds it.
    """
    _require_method(method)
    h, e = resolve_horizon(horizon, cadence)
    mfe, mae, at = forward_mfe_column(method, h), forward_mae_column(method, h), forward_excursion_available_at_column(method, h)
    require_absent(df, (mfe, mae, at))
    if checked:
        require_alignable(df, h.total_seconds, ("high", "low"), e.total_seconds)
        require_ascending(df)
    n, width = h.total_seconds // e.total_seconds, F.lit(h.total_seconds).cast("long")
    good = F.col("high").isNotNull() & F.col("low").isNotNull() & ~F.isnan("high") & ~F.isnan("low")
    block = (F.col("close_time") - F.pmod("close_time", width)) / width
    places = F.array(*(F.struct((block.cast("long") - k).alias("block"), (F.col("close_time") - k * width).alias("key"), F.lit(k == 0).alias("own")) for k in (0, 1)))
    bars = df.withColumn("__bar", F.when(good, F.struct("high", "low"))).withColumn("__at", F.explode(places))
    own = F.col("__at.own")
    rows = bars.select(F.col("__at.block").alias("__block"), F.col("__at.key").alias("__key"), own.alias("__own"), "__bar", *(F.when(own, F.col(c)).alias(c) for c in df.columns))
    # the next block's bars up to one horizon after t, and the own block's after t
    up = Window.partitionBy("__block").orderBy("__key", "__own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("__block").orderBy(F.desc("__key"), F.desc("__own")).rowsBetween(Window.unboundedPreceding, -1)
    sides = [(F.when(F.col("__own") if mine else ~F.col("__own"), F.col("__bar")), over) for mine, over in ((True, down), (False, up))]
    whole = reduce(lambda a, b: a + b, (F.count(bar).over(over) for bar, over in sides)) == n
    top = F.greatest(*(F.max(bar["high"]).over(over) for bar, over in sides))
    bottom = F.least(*(F.min(bar["low"]).over(over) for bar, over in sides))
    found = rows.select("*", F.when(whole, top).alias("__top"), F.when(whole, bottom).alias("__bottom")).where("__own")
    values = (return_values(F.col(c), F.col("close"), method).alias(name) for c, name in (("__top", mfe), ("__bottom", mae)))
    return found.select(*df.columns, *values, (F.col("close_time") + width).alias(at))
