"""Window aggregation: one row per tick of an epoch-anchored grid.

A candle [o, o + d) belongs to the window of W seconds that ends at tick t iff o >= t - W and
o + d <= t. Every tick has a row; without candles its prices and volume are null and its
counters 0.

Four physical plans, whose results are the same bit for bit: candles have one total order (open time, row number,
values with nulls first and NaN last), of equal open times the first in it gives open and close, and volumes are exact sums (:mod:`exact`).

* **Explode** (any input, small W / E): a candle is sent to the ticks that contain it, W / E of
  them, and aggregated by tick with map-side pre-aggregation; candles that share their ticks are
  aggregated first.
* **Sweep** (input on its grid): see :mod:`candlespark.operators.sweep`. One shuffle of the candles
  answers every tick of every schedule, at a cost that does not grow with W.
* **Search** (any input): see :mod:`candlespark.operators.events`. The same chunks, with binary searches in sorted candles.
* **Blocks** (input on its grid): the same by window functions alone. Time is cut into blocks of
  W seconds; a window is a suffix of one block and a prefix of the next, so running aggregates
  within blocks give every window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlespark.columns import ROW
from candlespark.duration import Duration
from candlespark.errors import ConfigError
from candlespark.logs import get_logger
from candlespark.operators import exact
from candlespark.operators.events import MAX_SECONDS, search
from candlespark.operators.grid import ExplicitRange, Materialization, MaterializationRule, ResolvedSchedule, coerce_materialization, resolve_schedule
from candlespark.operators.sweep import MAX_SLOTS, sweep
from candlespark.sources.profile import OHLCV, SourceProfile, require_source_columns

logger = get_logger(__name__)

WINDOW_COLUMNS = ("open_time", "close_time", *OHLCV, "src_count", "coverage_seconds", "traded_seconds")
#: Rows that are exploded rather than looking for a better plan, and W / E up to which the stretch of a first full window is.
EXPLODE_ROWS, FEW_TICKS = 1_000_000, 64
MANY_TICKS = 20_000_000
#: Bits of the number of cadences whose runs of candles one task joins.
STRETCH_BITS = 18
PLANS = ("auto", "explode", "blocks", "sweep", "search")
#: One traded candle in a count of candles: the upper half of 64 bits counts these.
_TRADED = 1 << 32


def extract_candles(df: DataFrame, profile: SourceProfile, by: str | None = None) -> DataFrame:
    """o (open time), prices, volume, and the ordinal that breaks ties between equal open times.

    Without a ``__row`` column from a reader, candles of equal open times count as published in the
    order of their values (nulls first, NaN last), so that results do not depend on partitioning.
    """
    require_source_columns(df, profile)
    order = F.col(ROW).cast("long") if ROW in df.columns else F.lit(0).cast("long")
    keys = [F.col(by).alias("__by")] if by else []
    return df.select(*keys, F.col(profile.timestamp_column).cast("long").alias("o"), order.alias("r"), *(F.col(c).cast("double").alias(c) for c in OHLCV))


def traded(volume: Column) -> Column:
    """A volume above zero; null and NaN are no trades (NaN would compare as above)."""
    return (volume > 0) & ~F.isnan(volume)


def _aggregates(d: int, unique: bool) -> list[Column]:
    """Of candles with the limbs of their volume: open and close go to the first published of equal open times.

    Where open times are known to be ``unique`` they alone order candles: such aggregates have buffers of fixed size and are hashed, not sorted.
    """
    if unique:
        ends = [F.min("o").alias("low_o"), F.max("o").alias("high_o"), F.min_by("open", "o").alias("open"), F.max_by("close", "o").alias("close")]
    else:
        ends = [F.min(F.struct("o", "r", *OHLCV)).alias("early"), F.min(F.struct((-F.col("o")).alias("o"), "r", *OHLCV)).alias("late")]
    return [
        *ends,
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        *exact.sums(),
        F.count("*").alias("src_count"),
        F.sum(F.when(traded(F.col("volume")), F.lit(d).cast("long")).otherwise(F.lit(0).cast("long"))).alias("traded_seconds"),
    ]


def _merged(unique: bool) -> list[Column]:
    """The same of rows that are such aggregates themselves."""
    if unique:
        ends = [F.min_by("open", "low_o").alias("open"), F.max_by("close", "high_o").alias("close")]
    else:
        ends = [F.min("early").alias("early"), F.min("late").alias("late")]
    return [*ends, F.max("high").alias("high"), F.min("low").alias("low"), *exact.sums(), F.sum("src_count").alias("src_count"), F.sum("traded_seconds").alias("traded_seconds")]


def _one_an_instant(candles: DataFrame, keys: list[str]) -> DataFrame:
    """Candles of equal open times as one row, with counts: they are in the same windows. Summed before the shuffle."""
    first = F.min(F.struct("r", *OHLCV)).alias("first")
    busy = F.count_if(traded(F.col("volume"))).alias("busy")
    rows = exact.with_limbs(candles).groupBy(*keys, "o").agg(first, F.max("high").alias("high"), F.min("low").alias("low"), F.count("*").alias("n"), busy, *exact.sums())
    return rows.select("*", *(F.col(f"first.{c}").alias(c) for c in ("open", "close"))).drop("first")


def _in_panes(candles: DataFrame, s: ResolvedSchedule, keys: list[str], unique: bool) -> DataFrame:
    """Candles on the grid as one row for each pane, whose candles are in the same windows; ``o`` is the pane's start. Hashed and summed before the shuffle."""
    rows = _one_an_instant(candles, keys)
    if unique:
        rows = exact.with_limbs(candles).withColumns({"n": F.lit(1).cast("long"), "busy": F.when(traded(F.col("volume")), 1).otherwise(0).cast("long")})
    pane = F.col("o") - F.pmod(F.col("o") - F.lit(s.anchor), F.lit(s.pane))
    ends = [F.min_by("open", "o").alias("open"), F.max_by("close", "o").alias("close")]
    found = rows.groupBy(*keys, pane.alias("__pane")).agg(*ends, F.max("high").alias("high"), F.min("low").alias("low"), F.sum("n").alias("n"), F.sum("busy").alias("busy"), *exact.sums())
    return found.withColumnRenamed("__pane", "o")


def _bounded(candles: DataFrame, s: ResolvedSchedule, start: Column, end: Column) -> DataFrame:
    """The candles of some window, with the first and the last tick of [start, end) whose window contains them."""
    first = s.tick_at_or_after(F.greatest(F.col("o") + s.cadence, start))
    last = s.tick_at_or_before(F.least(F.col("o") + s.window, end - 1))
    return candles.withColumn("__first", first).withColumn("__last", last).where("__first <= __last")


def _spread(rows: DataFrame, s: ResolvedSchedule) -> DataFrame:
    """A row ``t`` for each tick from ``__first`` to ``__last``."""
    return rows.select("*", F.explode(F.sequence("__first", "__last", F.lit(s.emit).cast("long"))).alias("t")).drop("__first", "__last")


def _to_ticks(candles: DataFrame, s: ResolvedSchedule, start: Column, end: Column) -> DataFrame:
    """A row ``t`` for each candle and tick of [start, end) whose window contains it."""
    return _spread(_bounded(candles, s, start, end), s)


def _explode_plan(candles: DataFrame, s: ResolvedSchedule, start: int, end: int, keys: list[str], unique: bool = False) -> DataFrame:
    """Where several candles share their ticks (E over the cadence), they are aggregated before they are exploded."""
    bound = lambda x: F.lit(x).cast("long")
    rows = _bounded(exact.with_limbs(candles), s, bound(start), bound(end))
    if s.pane > s.cadence:
        panes = rows.groupBy(*keys, "__first", "__last").agg(*_aggregates(s.cadence, unique))
        found = _spread(panes, s).groupBy(*keys, "t").agg(*_merged(unique))
    else:
        found = _spread(rows, s).groupBy(*keys, "t").agg(*_aggregates(s.cadence, unique))
    if not unique:
        found = found.select("*", F.col("early.open").alias("open"), F.col("late.close").alias("close"))
    return exact.with_total(found.drop("early", "late", "low_o", "high_o"))


def _block_plan(candles: DataFrame, s: ResolvedSchedule, start: int, end: int, keys: list[str]) -> DataFrame:
    """A row for every tick: running aggregates within blocks of W seconds, in one shuffle.

    The window of tick t is the suffix of one block from t - W on, and the prefix of the next
    block before t. A candle goes to the task of its own block, for suffixes, and to that of the
    block before, for prefixes, there W earlier: so one probe of t, at t - W, stands before all
    that its suffix counts and after all that its prefix counts. If the suffix has a candle it
    has the last one of its block, and a prefix has the first of its own.
    """
    w = s.window
    block = lambda x: x - F.pmod(x - F.lit(s.phase), F.lit(w))
    ticks = _tick_frame(candles.sparkSession, s, start, end)
    if keys:
        ticks = _keyed_ticks(candles, ticks, keys)
    candles, own = _require_grid(candles, s), block(F.col("o"))
    places = F.array(*(F.struct((own - shift).alias("b"), (F.col("o") - shift).alias("k"), F.lit(n).alias("side")) for n, shift in ((0, F.lit(0)), (1, F.lit(w)))))
    count = F.lit(1).cast("long") + F.when(traded(F.col("volume")), F.lit(_TRADED)).otherwise(F.lit(0).cast("long"))
    limbs = exact.live(candles)  # of most volumes two or three: a running sum costs more than finding out
    rows = exact.with_limbs(candles).select(*keys, F.explode(places).alias("at"), "r", *OHLCV, *limbs, count.alias("n")).select(*keys, "at.*", "r", *OHLCV, *limbs, "n")
    probe = F.col("t") - w
    probes = ticks.select(*keys, block(probe).alias("b"), probe.alias("k"), "t")
    block_of = Window.partitionBy(*keys, "b")
    to_here = (Window.unboundedPreceding, Window.currentRow)
    # of equal open times the first published decides: it comes last in both orders
    up = block_of.orderBy(F.asc("k"), F.asc_nulls_first("side"), F.desc("r"), *(F.desc(c) for c in OHLCV))
    down = block_of.orderBy(F.desc("k"), F.desc_nulls_last("side"), F.desc("r"), *(F.desc(c) for c in OHLCV))
    whole = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    old, new = F.col("side") == 0, F.col("side") == 1
    last = lambda side, c, over: F.last(F.when(side, F.struct(c)), ignorenulls=True).over(over)[c]
    halves = {
        "new_close": last(new, "close", up.rowsBetween(*to_here)), "old_close": F.min_by("close", F.when(old, F.struct(-F.col("k"), "r", *OHLCV))).over(whole),
        "new_open": F.min_by("open", F.when(new, F.struct("k", "r", *OHLCV))).over(whole), "old_open": last(old, "open", down.rowsBetween(*to_here)),
    }
    for name, side, over in (("new", new, up), ("old", old, down)):
        for c, f in (("high", F.max), ("low", F.min), *((x, F.sum) for x in limbs), ("n", F.sum)):
            halves[f"{name}_{c}"] = f(F.when(side, F.col(c))).over(over.rowsBetween(*to_here))
    found = rows.unionByName(probes, allowMissingColumns=True).select(*keys, "t", *(c.alias(n) for n, c in halves.items())).where("t IS NOT NULL")
    has_old, has_new = F.col("old_n").isNotNull(), F.col("new_n").isNotNull()
    many = F.coalesce("old_n", F.lit(0).cast("long")) + F.coalesce("new_n", F.lit(0).cast("long"))
    both = lambda c: F.coalesce(F.col(f"old_{c}") + F.col(f"new_{c}"), f"old_{c}", f"new_{c}")
    return exact.with_total(found.select(
        *keys, "t",
        F.when(has_old, F.col("old_open")).when(has_new, F.col("new_open")).alias("open"),
        F.greatest("old_high", "new_high").alias("high"), F.least("old_low", "new_low").alias("low"),
        F.when(has_new, F.col("new_close")).when(has_old, F.col("old_close")).alias("close"),
        *(both(c).alias(c) for c in limbs), *(F.lit(None if c == exact.ODD else 0).cast("double" if c == exact.ODD else "long").alias(c) for c in (*exact.NAMES, exact.ODD) if c not in limbs),
        many.bitwiseAND(F.lit(_TRADED - 1)).alias("src_count"),
        (F.shiftright(many, 32) * F.lit(s.cadence).cast("long")).alias("traded_seconds"),
    ))


def _keyed_ticks(candles: DataFrame, ticks: DataFrame, keys: list[str]) -> DataFrame:
    """The grid once for each key, by exploding it beside the key rather than joining."""
    bounds = ticks.agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n")).first()
    if not bounds["n"]:
        return candles.select(*keys).distinct().limit(0).withColumn("t", F.lit(0).cast("long"))
    step = (bounds["hi"] - bounds["lo"]) // max(1, bounds["n"] - 1) or 1
    grid = F.sequence(F.lit(bounds["lo"]).cast("long"), F.lit(bounds["hi"]).cast("long"), F.lit(step).cast("long"))
    return candles.select(*keys).distinct().select(*keys, F.explode(grid).alias("t"))


def _tick_frame(spark, s: ResolvedSchedule, start: int, end: int) -> DataFrame:
    first = s.first_tick_at_or_after(start)
    return spark.range(first, max(first, end), s.emit).withColumnRenamed("id", "t")


@dataclass(frozen=True)
class _Span:
    """First and last open time of a source, or None, how many candles it has and how many lie off its grid, and whether no two of a key lie in one cadence.

    ``full`` has the tick of the first full window, or None, of each schedule for which it was sought.
    """

    low: int | None
    high: int | None
    off: int
    unique: bool
    candles: int = 0
    full: dict[ResolvedSchedule, int | None] = field(default_factory=dict)


def _pages(candles: DataFrame, s: ResolvedSchedule, keys: list[str]) -> DataFrame:
    """A row for each 64 cadences of a source that have a candle: a bit for each that has one, and what its candles sum up."""
    slot = F.floor((F.col("o") - F.lit(s.phase)) / F.lit(s.cadence))
    off = F.pmod(F.col("o") - F.lit(s.phase), F.lit(s.cadence)) != 0
    rows = candles.where("o IS NOT NULL").select(*keys, "o", off.alias("off"), slot.alias("slot"))
    bits = F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")
    return rows.groupBy(*keys, F.shiftright("slot", 6).alias("page")).agg(bits, F.min("o").alias("low"), F.max("o").alias("high"), F.count_if("off").alias("off"), F.count("*").alias("n"))


def _span(candles: DataFrame, s: ResolvedSchedule, keys: list[str] | None = None) -> _Span:
    """As many bits as candles means that all open at times of their own."""
    unique = F.bool_and(F.col("n") == F.bit_count("bits"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return _Span(*_pages(candles, s, keys or []).agg(F.min("low"), F.max("high"), zero("off"), F.coalesce(unique, F.lit(True)), zero("n")).first())


def _warm_span(candles: DataFrame, schedules: list[ResolvedSchedule]) -> _Span:
    """The span with the first full windows of schedules, where candles open on the grid at times of their own.

    In a source without a hole these are the first ones; else one pass more finds those of all schedules.
    """
    s = schedules[0]
    span = _span(candles, s)
    if span.low is None or span.off or not span.unique:
        return span
    if span.candles * s.cadence == span.high + s.cadence - span.low:
        ticks = {w: w.first_tick_at_or_after(span.low + w.window) for w in schedules}
        return replace(span, full={w: t if t <= span.high + s.cadence else None for w, t in ticks.items()})
    return replace(span, full=_first_full(candles, list(dict.fromkeys(schedules))))


def _first_full(candles: DataFrame, schedules: list[ResolvedSchedule]) -> dict[ResolvedSchedule, int | None]:
    """The first tick of each schedule whose window is full, of a source whose candles open on the grid at times of their own.

    A window is full if it lies in a run of cadences that all have a candle. Runs of a page are read from its bits, those of a
    stretch joined in one task, which leaves its first full ticks, the run that it begins with and the one that it ends with;
    only these are joined over stretches. So it is one pass over a summary of the source, however many holes come first.
    """
    s, least = schedules[0], min(w.window // w.cadence for w in schedules)
    pages = _pages(candles, s, []).select("page", "bits", F.expr("bits & ~shiftleft(bits, 1)").alias("heads"), F.expr("bits & ~shiftrightunsigned(bits, 1)").alias("tails"))
    places = lambda c, edge: F.when(F.col("bits") == -1, F.array(F.lit(edge))).otherwise(F.expr(f"filter(sequence(0, 63), i -> (shiftrightunsigned({c}, i) & 1) = 1)"))
    ends = pages.select("page", F.explode(F.arrays_zip(places("heads", 0).alias("a"), places("tails", 63).alias("b"))).alias("x"))
    runs = ends.select(F.shiftright("page", STRETCH_BITS - 6).alias("stretch"), *((F.col("page") * 64 + F.col(f"x.{c}")).alias(c) for c in "ab"))
    # others are in no full window
    runs = runs.where((F.pmod("a", F.lit(64)) == 0) | (F.pmod("b", F.lit(64)) == 63) | (F.col("b") - F.col("a") + 1 >= least))
    fulls = {}
    for k, w in enumerate(schedules):
        time = lambda c: F.col(c) * F.lit(s.cadence).cast("long") + F.lit(s.phase)
        tick = w.tick_at_or_after(time("a") + F.lit(w.window))
        fulls[f"full{k}"] = F.min(F.when(tick <= time("b") + F.lit(s.cadence), tick))
    begin, stop = F.shiftleft("stretch", STRETCH_BITS), F.shiftleft(F.col("stretch") + 1, STRETCH_BITS) - 1
    sides = F.max(F.when(F.col("a") == begin, F.col("b"))).alias("head"), F.min(F.when(F.col("b") == stop, F.col("a"))).alias("tail")
    stretches = _runs(runs, ["stretch"]).groupBy("stretch").agg(*(c.alias(n) for n, c in fulls.items()), *sides)
    edge = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("a"), b.alias("b")))
    edges = F.array_distinct(F.array_compact(F.array(edge(begin, F.col("head")), edge(F.col("tail"), stop))))
    across = stretches.select(*fulls, F.explode_outer(edges).alias("x")).select("x.a", "x.b", *fulls)
    row = _runs(across, [], list(fulls)).agg(*(F.least(F.min(n), c).alias(n) for n, c in fulls.items())).first()
    return dict(zip(schedules, row))


def _runs(rows: DataFrame, keys: list[str], least: list[str] = []) -> DataFrame:
    """Runs [a, b] that touch as one, with the least of columns. Rows without a run are one."""
    order = Window.partitionBy(*keys).orderBy("a")
    fresh = F.when(F.col("a") == F.lag("b").over(order) + 1, 0).otherwise(1)
    numbered = rows.withColumn("run", fresh).withColumn("run", F.when(F.col("a").isNotNull(), F.sum("run").over(order)))
    return numbered.groupBy(*keys, "run").agg(*(F.min(c).alias(c) for c in least), F.min("a").alias("a"), F.max("b").alias("b"))


def _warmup_range(candles: DataFrame, s: ResolvedSchedule, span: _Span) -> tuple[int, int] | None:
    """[first fully covered tick, last tick + 1), or None if no window is ever full.

    A window is full when its candles' durations add up to W. Where candles open on the grid at times of their own, the
    span knows it; else growing stretches are counted, not all of history.
    """
    if span.low is None:
        return None
    start, last = s.first_tick_at_or_after(span.low + s.window), s.last_tick_at_or_before(span.high + s.cadence)
    if s in span.full:
        return None if span.full[s] is None else (span.full[s], last + 1)
    if start > last:
        return None
    full, reach, low = s.window // s.cadence, max(64 * s.emit, 4 * s.window), start
    few = s.window // s.emit <= FEW_TICKS
    while low <= last:
        high = min(last, s.last_tick_at_or_before(low + reach))
        near = candles.where((F.col("o") >= low - s.window) & (F.col("o") < high))
        if few or span.off:
            counts = _to_ticks(near, s, F.lit(low).cast("long"), F.lit(high + 1).cast("long")).groupBy("t").agg(F.count("*").alias("src_count"))
        else:
            counts = _swept(near, s, low, high + 1, [], span.unique)
        found = counts.where(F.col("src_count") == full).agg(F.min("t")).first()[0]
        if found is not None:
            return found, last + 1
        low, reach = high + s.emit, reach * 8
    return None


def tick_range(df: DataFrame, profile: SourceProfile, s: ResolvedSchedule, materialization: Materialization | str, span: _Span | None = None) -> tuple[int, int]:
    """The half-open range of ticks that a rule stands for."""
    rule = coerce_materialization(materialization)
    if isinstance(rule, ExplicitRange):
        return rule.start, rule.end
    candles = extract_candles(df, profile)
    found = _warmup_range(candles, s, span or _warm_span(candles, [s]))
    if found is None:
        raise ConfigError(f"no window of {Duration(s.window)} is fully covered by the source, so {MaterializationRule.SKIP_WARMUP.value} has no tick to begin at")
    return found


def _swept(candles: DataFrame, s: ResolvedSchedule, start: int, end: int, keys: list[str], unique: bool = True) -> DataFrame:
    if s.window // s.cadence > MAX_SLOTS:
        return _block_plan(candles, s, start, end, keys)
    candles = _require_grid(candles, s)
    if s.pane > s.cadence:
        coarse = replace(s, cadence=s.pane, phase=s.anchor % s.pane)
        return sweep(_in_panes(candles, s, keys, unique), [coarse], [(start, end)], keys, True, s.cadence).drop("k")
    return sweep(candles if unique else _one_an_instant(candles, keys), [s], [(start, end)], keys, not unique).drop("k")


def _searched(candles: DataFrame, s: ResolvedSchedule, start: int, end: int, keys: list[str], unique: bool = True) -> DataFrame:
    return search(candles if unique else _one_an_instant(candles, keys), [s], [(start, end)], keys, not unique).drop("k")


def _require_grid(candles: DataFrame, s: ResolvedSchedule) -> DataFrame:
    """The candles; one off the grid ends the job, where the caller's word stood for the check."""
    off = F.pmod(F.col("o") - F.lit(s.phase), F.lit(s.cadence)) != 0
    return candles.withColumn("o", F.when(off, F.raise_error(F.concat(F.lit("a candle lies off the grid at "), F.col("o").cast("string"))).cast("long")).otherwise(F.col("o")))


def _each_key_warm(df: DataFrame, profile: SourceProfile, s: ResolvedSchedule, key: str, make: Callable[[ExplicitRange], DataFrame]) -> DataFrame:
    """Of each key the ticks from its own first full window to its last candle; a key without a full window has no rows."""
    candles = extract_candles(df, profile, key)
    low, high = candles.agg(F.min("o"), F.max("o")).first()
    start = None if low is None else s.first_tick_at_or_after(low + s.window)
    found = None if start is None else make(ExplicitRange(start, max(start, s.last_tick_at_or_before(high + s.cadence) + 1)))
    full = F.min(F.when(F.col("src_count") == s.window // s.cadence, F.col("close_time")))
    bounds = None if found is None else found.groupBy(F.col(key).alias("__by")).agg(full.alias("__from")).where("__from IS NOT NULL")
    if bounds is None or bounds.isEmpty():
        raise ConfigError(f"no window of {Duration(s.window)} is fully covered by any {key}, so {MaterializationRule.SKIP_WARMUP.value} has no tick to begin at")
    last = candles.groupBy(F.col("__by").alias("__key")).agg((F.max("o") + s.cadence).alias("__until"))
    spans = bounds.join(last, F.col("__by").eqNullSafe(F.col("__key")))
    inside = F.col(key).eqNullSafe(F.col("__by")) & F.col("close_time").between(F.col("__from"), F.col("__until"))
    return found.join(spans, inside).select(found.columns)


def compute_windows(
    df: DataFrame, profile: SourceProfile, *, window: Duration | str, emit_every: Duration | str, anchor: Duration | str = "0s",
    materialization: Materialization | str = MaterializationRule.SKIP_WARMUP, plan: str = "auto", partition_by: str | None = None, deterministic: bool = False, on_grid: bool = False,
) -> DataFrame:
    """The ten-column window frame (after the key, where ``partition_by`` names one, by which each key is a source of its own).

    ``plan`` forces a physical plan; all give the same rows, bit for bit. ``auto`` explodes where that makes at most ``EXPLODE_ROWS``
    rows, or where windows do not overlap. Beyond it sweeps if every candle lies on the cadence
    grid, which one aggregation finds out unless the caller states it with ``on_grid`` (of a
    source that passed validation), and searches otherwise; windows of more than ``MAX_SECONDS`` off the grid are
    exploded. The sweep and block plans refuse a source off its grid. ``deterministic`` is what all plans are, and changes nothing.
    Nulls: an invalid null price is carried as the source has it; null volume adds nothing. Volumes below 2**-91 or from 2**72 on, infinite
    or NaN ones are added in floating point beside the exact sum of the others.
    """
    s = resolve_schedule(profile, window=window, emit_every=emit_every, anchor=anchor)
    if plan not in PLANS:
        raise ConfigError(f"plan must be one of {PLANS}, got {plan!r}")
    candles = extract_candles(df, profile, partition_by)
    rule = coerce_materialization(materialization)
    if partition_by and not isinstance(rule, ExplicitRange):
        return _each_key_warm(df, profile, s, partition_by, lambda span: compute_windows(df, profile, window=window, emit_every=emit_every, anchor=anchor, materialization=span, plan=plan, partition_by=partition_by, on_grid=on_grid))
    # only candles of some window are read: the predicate reaches the scan
    within = lambda a, b: (F.col("o") >= a - s.window) & (F.col("o") < b)
    span = None if isinstance(rule, ExplicitRange) else _warm_span(candles, [s])
    low, high = (rule.start - s.window, rule.end) if span is None else (span.low or 0, span.high or 0)
    count = (high - low) // s.cadence
    overlap = s.exploded(1) > 1 or s.window > s.emit and count > EXPLODE_ROWS
    wanted = plan in ("blocks", "sweep") or plan == "auto" and max(count, s.exploded(count)) > EXPLODE_ROWS and overlap
    keys = ["__by"] if partition_by else []
    many = count > EXPLODE_ROWS and not wanted  # these are hashed if open times are unique
    if span is None and (many or (wanted or plan == "search") and not on_grid):
        span = _span(candles.where(within(rule.start, rule.end)), s, keys)
    off, unique = (0, None) if span is None else (span.off, span.unique)
    if off and (plan in ("blocks", "sweep") or on_grid):
        raise ConfigError(f"{off} candles lie off the grid of {profile.cadence} from {profile.phase_seconds}s; only the search and explode plans take them")
    start, end = tick_range(df, profile, s, rule, span)
    if s.count_ticks(start, end) > MANY_TICKS:
        logger.warning("%d ticks will be emitted", s.count_ticks(start, end))
    candles = candles.where(within(start, end))
    if plan == "blocks":
        out = _block_plan(candles, s, start, end, keys)
    elif wanted and not off:
        out = _swept(candles, s, start, end, keys, unique is not False)
    elif plan == "search" or wanted and s.window <= MAX_SECONDS:
        out = _searched(candles, s, start, end, keys, unique is not False)
    else:
        found = _explode_plan(candles, s, start, end, keys, bool(unique))
        ticks = _tick_frame(df.sparkSession, s, start, end)
        if keys:  # a null key is a key
            same = F.col("__by").eqNullSafe(F.col("__own")) & (F.col("t") == F.col("__at"))
            out = _keyed_ticks(candles, ticks, keys).join(found.withColumnsRenamed({"__by": "__own", "t": "__at"}), same, "left").drop("__own", "__at")
        else:
            out = ticks.join(found, "t", "left")
    count = F.coalesce("src_count", F.lit(0).cast("long"))
    return out.select(
        *(F.col(k).alias(partition_by) for k in keys),
        (F.col("t") - F.lit(s.window).cast("long")).alias("open_time"), F.col("t").alias("close_time"), *OHLCV,
        count.alias("src_count"), (count * F.lit(s.cadence).cast("long")).alias("coverage_seconds"),
        F.coalesce("traded_seconds", F.lit(0).cast("long")).alias("traded_seconds"),
    )


def compute_ladder(
    df: DataFrame, profile: SourceProfile, pairs: list[tuple[Duration | str, Duration | str]], *, anchor: Duration | str = "0s",
    materialization: Materialization | str = MaterializationRule.SKIP_WARMUP,
) -> DataFrame:
    """All (window, emit cadence) pairs of a ladder, with the leading columns window_seconds and emit_seconds.

    Input on its grid is swept, other input searched: one scan and one shuffle of the candles answer all pairs, where a
    call for each pair would take as many. Pairs beyond the bounds of these are computed one by one.
    """
    resolved = [resolve_schedule(profile, window=w, emit_every=e, anchor=anchor) for w, e in pairs]
    if not resolved:
        raise ConfigError("a ladder needs at least one pair")
    rule, candles = coerce_materialization(materialization), extract_candles(df, profile)
    if isinstance(rule, ExplicitRange):
        candles = candles.where((F.col("o") >= rule.start - max(s.window for s in resolved)) & (F.col("o") < rule.end))
    span = _span(candles, resolved[0]) if isinstance(rule, ExplicitRange) else _warm_span(candles, resolved)
    ranges = [tick_range(df, profile, s, rule, span) for s in resolved]
    together = [k for k, s in enumerate(resolved) if (s.window <= MAX_SECONDS if span.off else s.window // s.cadence <= MAX_SLOTS)]
    parts = []
    if together:
        answer = search if span.off else sweep
        found = answer(candles if span.unique else _one_an_instant(candles, []), [resolved[k] for k in together], [ranges[k] for k in together], [], not span.unique)
        sizes = F.array(*(F.struct(F.lit(resolved[k].window).cast("long").alias("window_seconds"), F.lit(resolved[k].emit).cast("long").alias("emit_seconds")) for k in together))
        count, own = F.col("src_count"), F.get(sizes, F.col("k"))
        parts.append(found.select(own["window_seconds"].alias("window_seconds"), own["emit_seconds"].alias("emit_seconds"), (F.col("t") - own["window_seconds"]).alias("open_time"), F.col("t").alias("close_time"), *OHLCV, count, (count * F.lit(profile.cadence.total_seconds).cast("long")).alias("coverage_seconds"), "traded_seconds"))
    for k, (s, (start, end)) in enumerate(zip(resolved, ranges)):
        if k not in together:
            one = compute_windows(df, profile, window=Duration(s.window), emit_every=Duration(s.emit), anchor=anchor, materialization=ExplicitRange(start, max(start, end)))
            parts.append(one.select(F.lit(s.window).cast("long").alias("window_seconds"), F.lit(s.emit).cast("long").alias("emit_seconds"), *WINDOW_COLUMNS))
    return reduce(DataFrame.unionByName, parts)
