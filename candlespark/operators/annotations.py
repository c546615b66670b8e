"""Interval annotations: flags and overlapped seconds of a sparse sidecar, for every window.

A sidecar of up to ``LITERAL_INTERVALS`` intervals is held in literals, so a window is annotated in its
own row without a join: the seconds covered before a time are looked up, and a window's are the
difference between its ends. A larger one is joined by time buckets: intervals and
windows meet in the buckets they share, so no task compares all with all.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlespark.columns import LONG, STRING, require_absent, require_types
from candlespark.errors import ConfigError, DataValidationError

#: Intervals that are looked up without a join, and flags that are told by their own covered seconds.
LITERAL_INTERVALS, MANY_FLAGS = 2000, 64


class AnnotationValidationError(DataValidationError):
    """The sidecar's content is broken: nulls, empty or reversed intervals, unreadable rows."""


@dataclass(frozen=True)
class AnnotationColumns:
    """Names of a sidecar's columns."""

    start: str = "start_timestamp"
    end: str = "end_timestamp"
    flag: str = "flag"

    def __post_init__(self) -> None:
        if len({self.start.lower(), self.end.lower(), self.flag.lower()}) < 3:
            raise ConfigError("the three annotation columns need different names")


def require_annotations(annotations: DataFrame, columns: AnnotationColumns = AnnotationColumns()) -> int:
    """Check a sidecar in one aggregation and return its number of intervals."""
    require_types(annotations, {columns.start: LONG, columns.end: LONG, columns.flag: STRING}, "annotation sidecar")
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{k}") for k, c in enumerate((columns.start, columns.end, columns.flag))]
    row = annotations.agg(F.count("*").alias("n"), *nulls, F.count_if(F.col(columns.end) <= F.col(columns.start)).alias("bad")).first()
    if row["null_0"] or row["null_1"] or row["null_2"]:
        raise AnnotationValidationError(f"nulls in the sidecar: {columns.start} {row['null_0']}, {columns.end} {row['null_1']}, {columns.flag} {row['null_2']}")
    if row["bad"]:
        raise AnnotationValidationError(f"{row['bad']} intervals do not end after they start")
    return row["n"]


def merge_intervals(annotations: DataFrame, columns: AnnotationColumns = AnnotationColumns(), bucket_seconds: int = 31_536_000) -> DataFrame:
    """(start, end): the union of half-open intervals, overlapping and touching ones joined.

    Runs in buckets of starts and then over the few bucket results, so one task never sorts all
    intervals unless they are as many unions.
    """
    spans = annotations.select(F.col(columns.start).alias("start"), F.col(columns.end).alias("end"))
    bucketed = spans.withColumn("b", F.floor(F.col("start") / bucket_seconds))
    return _islands(_islands(bucketed, ["b"]), [])


def _islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") <= reach, 0).otherwise(1)
    island = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return spans.withColumn("fresh", fresh).withColumn("island", island).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("start", "end")


def annotate_windows(df: DataFrame, annotations: DataFrame, *, columns: AnnotationColumns = AnnotationColumns(), prefix: str = "annotation") -> DataFrame:
    """Append ``<prefix>_flags`` (sorted, distinct, never null) and ``<prefix>_overlap_seconds``.

    An interval touches a window iff open_time < end and close_time > start; seconds are those of
    the window inside the union of all intervals.
    """
    require_types(df, {"open_time": LONG, "close_time": LONG}, "window frame")
    flags_name, seconds_name = f"{prefix}_flags", f"{prefix}_overlap_seconds"
    require_absent(df, (flags_name, seconds_name))
    n = require_annotations(annotations, columns)
    if n > LITERAL_INTERVALS:
        return _joined(df, annotations, columns, flags_name, seconds_name)
    rows = annotations.select(columns.start, columns.end, columns.flag).limit(LITERAL_INTERVALS).collect()
    empty, none = F.array().cast("array<string>"), F.lit(0).cast("long")
    if not rows:
        return df.select("*", empty.alias(flags_name), none.alias(seconds_name))
    by_flag: dict[str, list[tuple[int, int]]] = {}
    for s, e, f in rows:
        by_flag.setdefault(f, []).append((s, e))
    seconds = _covered([(r[0], r[1]) for r in rows], "close_time") - _covered([(r[0], r[1]) for r in rows], "open_time")
    if len(by_flag) <= MANY_FLAGS:  # a flag touches a window that its intervals cover a part of
        held = [F.when(_covered(x, "close_time") > _covered(x, "open_time"), F.lit(f)) for f, x in sorted(by_flag.items())]
        names = F.array_compact(F.array(*held))
    else:
        flags = _constant([{"s": s, "e": e, "f": f} for s, e, f in {tuple(r) for r in rows}], "array<struct<s:long,e:long,f:string>>")
        touches = lambda x: (F.col("open_time") < x["e"]) & (F.col("close_time") > x["s"])
        names = F.array_sort(F.array_distinct(F.transform(F.filter(flags, touches), lambda x: x["f"])))
    return df.select("*", names.alias(flags_name), seconds.alias(seconds_name))


def _constant(value: list, kind: str) -> Column:
    """A constant of any size as one literal, which is read once when the plan is made."""
    return F.from_json(F.lit(json.dumps(value)), F.lit(kind))


def _covered(spans: list[tuple[int, int]], time: str) -> Column:
    """Seconds that the union of intervals covers before a time.

    The span of the intervals is cut into cells of equal length, four for each interval. A cell knows what is covered
    before it and the parts of the union in it, of which there are few: a look-up and a short sum, however many
    intervals there are.
    """
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    low, high = merged[0][0], merged[-1][1]
    width = max(1, -(-(high - low) // (4 * len(merged))))
    cells: list[dict] = [{"b": 0, "p": []} for _ in range(-(-(high - low) // width))]
    for s, e in merged:
        for k in range((s - low) // width, (e - 1 - low) // width + 1):
            cells[k]["p"].append({"s": max(s, low + k * width), "e": min(e, low + (k + 1) * width)})
    for k in range(1, len(cells)):
        cells[k]["b"] = cells[k - 1]["b"] + sum(p["e"] - p["s"] for p in cells[k - 1]["p"])
    t = F.col(time)
    place = F.greatest(F.lit(0), F.least(F.lit(len(cells) - 1), F.floor((t - F.lit(low)) / F.lit(width)))).cast("int")
    cell = F.get(_constant(cells, "array<struct<b:long,p:array<struct<s:long,e:long>>>>"), place)
    # of a part, what lies before the time
    return F.aggregate(cell["p"], cell["b"], lambda a, p: a + F.least(F.greatest(t, p["s"]), p["e"]) - p["s"])


def _joined(df: DataFrame, annotations: DataFrame, columns: AnnotationColumns, flags_name: str, seconds_name: str, bucket: int = 86_400) -> DataFrame:
    """By buckets of a day: an interval and a window are compared in the first bucket that both reach."""
    span = lambda low, high: F.sequence(F.floor(low / bucket), F.floor((high - 1) / bucket))
    windows = df.select("open_time", "close_time").distinct()
    cells = windows.select("*", F.explode(span(F.col("open_time"), F.col("close_time"))).alias("cell"))
    flagged = annotations.select(F.col(columns.start).alias("s"), F.col(columns.end).alias("e"), F.col(columns.flag).alias("f"))
    union = merge_intervals(annotations, columns).select(F.col("start").alias("s"), F.col("end").alias("e"))
    meet = (F.col("open_time") < F.col("e")) & (F.col("close_time") > F.col("s")) & (F.col("cell") == F.greatest(F.floor(F.col("open_time") / bucket), F.floor(F.col("s") / bucket)))
    spread = lambda x: x.select("*", F.explode(span(F.col("s"), F.col("e"))).alias("cell"))
    flags = cells.join(spread(flagged), "cell").where(meet).groupBy("open_time", "close_time").agg(F.array_sort(F.collect_set("f")).alias("f"))
    overlap = F.least("close_time", "e") - F.greatest("open_time", "s")
    seconds = cells.join(spread(union), "cell").where(meet).groupBy("open_time", "close_time").agg(F.sum(overlap).alias("n"))
    both = df.join(flags, ["open_time", "close_time"], "left").join(seconds, ["open_time", "close_time"], "left")
    return both.select(*(df.columns), F.coalesce("f", F.array().cast("array<string>")).alias(flags_name), F.coalesce("n", F.lit(0).cast("long")).alias(seconds_name))
