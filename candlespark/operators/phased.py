"""Phased lookback: at each tick the L windows of duration W that end at t, t - W, t - 2W, ...

One shuffle instead of L joins: windows whose close times are the same modulo W are one class, in
which a tick's L windows stand one after the other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from candlespark.columns import DOUBLE, LONG, require_types
from candlespark.duration import Duration, positive_duration
from candlespark.errors import ConfigError, bounded_echo

#: The longest lookback, and lookbacks of a chunk of a class.
MAX_LOOKBACK, CHUNK_LOOKBACKS = 512, 64
#: Seconds of the buckets whose steps one task looks at.
MONTH = 2_592_000
FIELDS = {"open": DOUBLE, "high": DOUBLE, "low": DOUBLE, "close": DOUBLE, "volume": DOUBLE, "src_count": LONG, "coverage_seconds": LONG, "traded_seconds": LONG}


@dataclass(frozen=True)
class PhasedGrid:
    """A checked lookback over a window frame, in seconds; ``ticks`` is [first, last] or None when there is none."""

    window: int
    emit: int
    anchor: int
    lookback: int
    cadence: int
    ticks: tuple[int, int] | None

    @property
    def effective_history(self) -> Duration:
        return Duration(self.lookback * self.window)


@dataclass(frozen=True)
class PhasedLookback:
    """close_time and eight array columns of length L, newest first, or null together; with its grid."""

    frame: DataFrame
    grid: PhasedGrid

    @property
    def effective_history(self) -> Duration:
        return self.grid.effective_history


def _count(value: object, label: str, low: int, high: int | None = None) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < low or (high is not None and value > high):
        raise ConfigError(f"{label} must be an int of at least {low}{f' and at most {high}' if high else ''}, got {bounded_echo(value)}")
    return value


def resolve_phased_grid(df: DataFrame, *, window: Duration | str, emit_every: Duration | str, lookback: int, anchor: Duration | str = "0s") -> PhasedGrid:
    """Check the frame: key without nulls or repeats, one span W, steps that are multiples of their most common one."""
    w, e = positive_duration(window, "window").total_seconds, positive_duration(emit_every, "emit_every").total_seconds
    from candlespark.duration import coerce_duration

    a = coerce_duration(anchor, "anchor").total_seconds % e
    lookback = _count(lookback, "lookback", 1, MAX_LOOKBACK)
    require_types(df, {"open_time": LONG, "close_time": LONG} | FIELDS, "window frame")
    row = _measured(df, w)
    if row["n"] != row["present"]:
        raise ConfigError(f"close_time has {row['n'] - row['present']} nulls")
    if row["odd"]:
        raise ConfigError(f"{row['odd']} rows do not span the stated window of {Duration(w)}")
    if row["n"] < 2:
        raise ConfigError("a phased lookback needs at least two rows to measure the frame's cadence")
    if row["least"] <= 0:
        raise ConfigError("close_time repeats")
    cadence, uneven = row["least"], row["mixed"]
    if uneven or 2 * row["usual"] <= row["n"] - 1:  # the least step may not be the most common one: count them all
        cadence, uneven = _most_common_step(df)
    if uneven:
        raise ConfigError(f"the steps of close_time are not all multiples of {Duration(cadence)}")
    for label, value in (("window", w), ("emit_every", e)):
        if value % cadence:
            raise ConfigError(f"{label} {Duration(value)} is no multiple of the frame's cadence {Duration(cadence)}")
    if (a - row["low"]) % cadence:
        raise ConfigError(f"anchor {Duration(a)} puts ticks off the frame's grid")
    first, last = row["low"] + (a - row["low"]) % e, row["high"] - (row["high"] - a) % e
    return PhasedGrid(w, e, a, lookback, cadence, (first, last) if first <= last else None)


def _in_months(df: DataFrame, *more: Column) -> DataFrame:
    """close_time, its month-long bucket ``b``, the ``step`` from the row before in the bucket, and ``more``."""
    rows = df.select("close_time", F.floor(F.col("close_time") / F.lit(MONTH)).alias("b"), *more)
    return rows.withColumn("step", F.col("close_time") - F.lag("close_time").over(Window.partitionBy("b").orderBy("close_time")))


def _measured(df: DataFrame, w: int) -> Row:
    """Order, uniqueness, spans and steps of a frame in one aggregation and one shuffle.

    n, present (close times that are not null), odd (rows of another span), low, high, the ``least`` step, ``usual`` (how many
    steps are the least), and ``mixed``: steps that may be no multiple of the least, none of which is the proof that all are.
    A bucket is summed up within; the steps between buckets come from their ends, a row for each.
    """
    odd = ~(F.col("close_time") - F.col("open_time")).eqNullSafe(F.lit(w).cast("long"))
    kinds = _in_months(df, odd.alias("odd")).groupBy("b", "step").agg(
        F.count("*").alias("n"), F.count("close_time").alias("present"), F.count_if("odd").alias("odd"), F.min("close_time").alias("low"), F.max("close_time").alias("high")
    )
    sums = [F.sum(c).alias(c) for c in ("n", "present", "odd")]
    ends = [F.min("low").alias("low"), F.max("high").alias("high")]
    inside = F.col("step") == F.col("own")
    buckets = kinds.withColumn("own", F.min("step").over(Window.partitionBy("b"))).groupBy("b").agg(
        *sums, *ends, F.min("own").alias("own"), F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("usual"), F.count_if(F.try_mod("step", F.col("own")) != 0).alias("mixed")
    )
    seams = buckets.withColumn("seam", F.col("low") - F.lag("high").over(Window.orderBy("b")))
    everywhere = Window.partitionBy()
    steps = seams.withColumn("least", F.least(F.min("own").over(everywhere), F.min("seam").over(everywhere)))
    usual = F.sum(F.when(F.col("own") == F.col("least"), F.col("usual")).otherwise(0)) + F.count_if(F.col("seam") == F.col("least"))
    mixed = F.sum("mixed") + F.count_if(F.try_mod("own", F.col("least")) != 0) + F.count_if(F.try_mod("seam", F.col("least")) != 0)
    return steps.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "present", "odd")), *ends, F.min("least").alias("least"), usual.alias("usual"), mixed.alias("mixed")).first()


def _most_common_step(df: DataFrame) -> tuple[int, int]:
    """The most common step between consecutive close times (of equally common ones the least), and how many kinds are no multiple of it."""
    rows = _in_months(df)
    edges = rows.groupBy("b").agg(F.min("close_time").alias("low"), F.max("close_time").alias("high"))  # one row for each month
    seams = edges.select((F.col("low") - F.lag("high").over(Window.orderBy("b"))).alias("step")).where("step IS NOT NULL")
    counted = rows.select("step").where("step IS NOT NULL").unionByName(seams).groupBy("step").count()
    usual = counted.agg(F.max_by("step", F.struct("count", -F.col("step")))).first()[0]
    return usual, counted.where(F.try_mod("step", F.lit(usual)) != 0).count()


def phased_lookback(df: DataFrame, *, window: Duration | str, emit_every: Duration | str, lookback: int, anchor: Duration | str = "0s", min_traded_seconds: int = 0) -> PhasedLookback:
    """One row per tick; a window below ``min_traded_seconds`` is absent, and any absent window or null field nulls all arrays.

    The rows shuffled do not grow with ``lookback``: an array is a frame of as many rows of its class.
    """
    least = _count(min_traded_seconds, "min_traded_seconds", 0)
    grid = resolve_phased_grid(df, window=window, emit_every=emit_every, lookback=lookback, anchor=anchor)
    spark = df.sparkSession
    first, last = grid.ticks or (0, -grid.emit)
    present = F.lit(True)
    for name in FIELDS:
        present = present & F.col(name).isNotNull()
    admitted = df.where((F.col("traded_seconds") >= least) & present)
    # windows W apart are one class; of a class, chunks of many lookbacks, each with one lookback before it
    w, key = F.lit(grid.window).cast("long"), F.col("close_time")
    turn = ((key - F.pmod(key, w)) / w).cast("long")
    chunk = lambda x: F.floor(x / F.lit(CHUNK_LOOKBACKS * lookback))
    used = F.pmod(key - F.lit(grid.anchor), F.lit(math.gcd(grid.window, grid.emit))) == 0  # others are in no tick's lookback
    sent = admitted.where(used).select(F.pmod(key, w).alias("phase"), turn.alias("turn"), F.struct(*FIELDS).alias("x"))
    sent = sent.withColumn("chunk", F.explode(F.array_distinct(F.array(chunk(F.col("turn")), chunk(F.col("turn") + F.lit(lookback - 1))))))
    back = Window.partitionBy("phase", "chunk").orderBy("turn").rangeBetween(1 - lookback, 0)
    t = F.col("turn") * w + F.col("phase")
    own = (F.col("chunk") == chunk(F.col("turn"))) & (t >= first) & (t <= last) & (F.pmod(t - F.lit(grid.anchor), F.lit(grid.emit)) == 0)
    held = sent.withColumn("x", F.collect_list("x").over(back)).where(own & (F.size("x") == lookback))
    gathered = held.select(t.alias("t"), F.reverse("x").alias("x"))
    ticks = spark.range(first, last + 1, grid.emit).withColumnRenamed("id", "t")
    out = ticks.join(gathered, "t", "left").select(F.col("t").alias("close_time"), *(F.col(f"x.{n}").alias(n) for n in FIELDS))
    return PhasedLookback(out, grid)
