"""Specification forms of the windowed operators: the definition as one join each, for tests and small frames.

Their cost grows with rows times ticks; the engines in :mod:`windows` and :mod:`phased` give the
same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlespark.duration import Duration
from candlespark.logs import get_logger
from candlespark.operators import exact
from candlespark.operators.grid import Materialization, MaterializationRule, resolve_schedule
from candlespark.operators.phased import FIELDS, PhasedLookback, resolve_phased_grid
from candlespark.operators.windows import WINDOW_COLUMNS, extract_candles, tick_range, traded
from candlespark.sources.profile import OHLCV, SourceProfile

logger = get_logger(__name__)
MANY_PAIRS = 50_000_000


def compute_reference_windows(df: DataFrame, profile: SourceProfile, *, window: Duration | str, emit_every: Duration | str, anchor: Duration | str = "0s", materialization: Materialization | str = MaterializationRule.SKIP_WARMUP) -> DataFrame:
    """The window frame by the membership rule itself: candles joined to ticks by o >= t - W and o + d <= t."""
    s = resolve_schedule(profile, window=window, emit_every=emit_every, anchor=anchor)
    start, end = tick_range(df, profile, s, materialization)
    candles = extract_candles(df, profile)
    if (n := s.count_ticks(start, end)) * candles.count() > MANY_PAIRS:
        logger.warning("the specification form compares %d ticks with every candle; compute_windows gives the same rows", n)
    first = s.first_tick_at_or_after(start)
    ticks = df.sparkSession.range(first, max(first, end), s.emit).withColumnRenamed("id", "t")
    inside = (F.col("o") >= F.col("t") - s.window) & (F.col("o") + s.cadence <= F.col("t"))
    found = F.col("o").isNotNull()
    order = F.when(found, F.struct("o", "r", *OHLCV))
    out = ticks.join(exact.with_limbs(candles), inside, "left").groupBy("t").agg(
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.min_by("close", F.when(found, F.struct(-F.col("o"), "r", *OHLCV))).alias("close"), *exact.sums(),
        F.count("o").alias("src_count"), (F.count("o") * F.lit(s.cadence).cast("long")).alias("coverage_seconds"),
        (F.count_if(traded(F.col("volume"))) * F.lit(s.cadence).cast("long")).alias("traded_seconds"),
    )
    return exact.with_total(out).withColumn("open_time", F.col("t") - F.lit(s.window).cast("long")).withColumnRenamed("t", "close_time").select(*WINDOW_COLUMNS)


def phased_lookback_reference(df: DataFrame, *, window: Duration | str, emit_every: Duration | str, lookback: int, anchor: Duration | str = "0s", min_traded_seconds: int = 0) -> PhasedLookback:
    """The phased frame by one exact join for each phase."""
    grid = resolve_phased_grid(df, window=window, emit_every=emit_every, lookback=lookback, anchor=anchor)
    first, last = grid.ticks or (0, -grid.emit)
    out = df.sparkSession.range(first, last + 1, grid.emit).withColumnRenamed("id", "t")
    admitted = df.where(F.col("traded_seconds") >= min_traded_seconds)
    for k in range(lookback):
        phase = admitted.select((F.col("close_time") + F.lit(k * grid.window).cast("long")).alias("t"), *(F.col(c).alias(f"{c}_{k}") for c in FIELDS))
        out = out.join(phase, "t", "left")
    whole = F.lit(True)
    for k in range(lookback):
        for c in FIELDS:
            whole = whole & F.col(f"{c}_{k}").isNotNull()
    arrays = [F.when(whole, F.array(*(f"{c}_{k}" for k in range(lookback)))).alias(c) for c in FIELDS]
    return PhasedLookback(out.select(F.col("t").alias("close_time"), *arrays), grid)
