"""Windows over a stream of candles (an extension: the batch operator is the specification).

A candle goes to the ticks that contain it and is aggregated by tick, as in the batch explode
plan; a watermark on the tick closes a window once candles ``lateness`` behind cannot change
it. Ticks without candles are not emitted, since a stream cannot tell an empty tick from a late
one before the watermark passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlespark.duration import Duration, coerce_duration
from candlespark.operators import exact
from candlespark.operators.grid import resolve_schedule
from candlespark.operators.windows import extract_candles, traded
from candlespark.sources.profile import OHLCV, SourceProfile


def stream_windows(df: DataFrame, profile: SourceProfile, *, window: Duration | str, emit_every: Duration | str, anchor: Duration | str = "0s", lateness: Duration | str = "0s") -> DataFrame:
    """The ten window columns for every tick that has candles; works on streaming and on batch frames."""
    s = resolve_schedule(profile, window=window, emit_every=emit_every, anchor=anchor)
    late = coerce_duration(lateness, "lateness").total_seconds
    candles = extract_candles(df, profile)
    first, last = s.tick_at_or_after(F.col("o") + s.cadence), s.tick_at_or_before(F.col("o") + s.window)
    spread = candles.withColumn("__a", first).withColumn("__z", last).where("__a <= __z")
    limbs = (*exact.NAMES, exact.ODD, exact.ANY)
    spread = exact.with_limbs(spread).select("o", "r", *OHLCV, *limbs, F.explode(F.sequence("__a", "__z", F.lit(s.emit).cast("long"))).alias("t"))
    spread = spread.withColumn("tick", F.timestamp_seconds("t")).withWatermark("tick", f"{late + s.window} seconds")
    early, newest = F.struct("o", "r", *OHLCV), F.struct(-F.col("o"), "r", *OHLCV)
    d = F.lit(s.cadence).cast("long")
    out = spread.groupBy("tick").agg(
        F.min_by("open", early).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.min_by("close", newest).alias("close"),
        *exact.sums(), F.count("*").alias("src_count"), F.count_if(traded(F.col("volume"))).alias("n"),
    )
    t = F.unix_seconds("tick")
    return exact.with_total(out).select((t - F.lit(s.window).cast("long")).alias("open_time"), t.alias("close_time"), *OHLCV, "src_count", (F.col("src_count") * d).alias("coverage_seconds"), (F.col("n") * d).alias("traded_seconds"))
