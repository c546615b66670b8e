"""Candles from event and order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlespark.duration import Duration, coerce_duration


def epoch_seconds(ts: Column) -> Column:
    """Unix seconds of a timestamp without zone, whatever the session's zone; floored before the epoch too."""
    micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)
    return F.floor(micros / F.lit(1_000_000)).cast("long")


def candles_from_events(events: DataFrame, cadence: Duration | str, *, positive: bool = False) -> DataFrame:
    """One candle for each cadence interval that has events; volume counts purchases, so it is exact.

    Open and close are the values at the first and last (ts, event_id). ``positive`` leaves out
    events without a value above zero.
    """
    d = coerce_duration(cadence).total_seconds
    rows = events.where("value > 0") if positive else events
    s = epoch_seconds(F.col("ts"))
    rows = rows.select((s - F.pmod(s, F.lit(d))).alias("timestamp"), "ts", "event_id", "value", "event_type")
    at = F.struct("ts", "event_id")
    return rows.groupBy("timestamp").agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"),
        F.count_if(F.col("event_type") == "purchase").cast("double").alias("volume"),
    )


def candles_from_orders(orders: DataFrame) -> DataFrame:
    """Daily candles of order prices; volume counts orders."""
    s = epoch_seconds(F.col("o_orderdate"))
    rows = orders.select((s - F.pmod(s, F.lit(86_400))).alias("timestamp"), "o_orderdate", "o_orderkey", "o_totalprice")
    at = F.struct("o_orderdate", "o_orderkey")
    return rows.groupBy("timestamp").agg(
        F.min_by("o_totalprice", at).alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", at).alias("close"),
        F.count("*").cast("double").alias("volume"),
    )
