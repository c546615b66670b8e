"""Queries over the shared tables, and the SQL that states their results independently."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlespark.adapters import candles_from_events, candles_from_orders
from candlespark.duration import Duration
from candlespark.functions import add_calendar_columns, day_of_week, second_of_day, second_of_week
from candlespark.operators.annotations import annotate_windows
from candlespark.operators.grid import ExplicitRange
from candlespark.operators.indicators import CutlersRSI, LogVolumeRatio, PriceToMovingAverage, RelativeRange, add_indicator
from candlespark.operators.phased import phased_lookback
from candlespark.operators.quality import QualityMode, WindowQualityPolicy, apply_quality_policy, quality_report
from candlespark.operators.returns import ReturnMethod, add_backward_returns, add_forward_excursions, add_forward_returns
from candlespark.operators.windows import compute_ladder, compute_windows
from candlespark.sources.profile import SourceProfile, candle_profile
from candlespark.sources.validation import find_gaps, validation_counts
from candlespark.streaming import stream_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DAY0 = 1_704_067_200
RANGE = ExplicitRange(DAY0, DAY0 + 31 * 86_400)
PRICES = "open, high, low, close, volume"
WINDOW = f"open_time, close_time, {PRICES}, src_count, coverage_seconds, traded_seconds"
# (start, end, flag) of a made-up outage log; some touch, some overlap, one is shorter than a candle
INTERVALS = [(DAY0 + 3600, DAY0 + 9000, "outage"), (DAY0 + 9000, DAY0 + 9600, "maintenance"), (DAY0 + 86_400, DAY0 + 180_000, "outage"), (DAY0 + 100_000, DAY0 + 200_000, "late"), (DAY0 + 1_000_000, DAY0 + 1_000_010, "blip")]


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def _candles(spark: SparkSession, sf_dir: str, d: int, positive: bool = False) -> tuple[DataFrame, SourceProfile]:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return candles_from_events(events, Duration(d), positive=positive), candle_profile("events", Duration(d))


def _candles_sql(d: int, positive: bool = False) -> str:
    return f"""e AS (SELECT epoch_us(ts) // 1000000 AS s, epoch_us(ts) AS us, event_id, value, event_type FROM events {"WHERE value > 0" if positive else ""}),
        c AS (SELECT s - s % {d} AS timestamp, arg_min(value, us) AS open, max(value) AS high, min(value) AS low, arg_max(value, us) AS close,
              CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS volume FROM e GROUP BY 1)"""


def _windows_sql(d: int, w: int, e: int, a: int = 0, span: ExplicitRange | None = None, positive: bool = False) -> str:
    """CTEs e, c, t, g and w, the last with the ten window columns."""
    if span is None:
        ticks = f"SELECT unnest(range(lo + ((({a} - lo) % {e}) + {e}) % {e}, hi + 1, {e})) AS t FROM (SELECT min(timestamp) + {w} AS lo, max(timestamp) + {d} AS hi FROM c)"
        keep = f"WHERE t >= (SELECT min(t) FROM g WHERE n * {d} = {w})"
    else:
        first = span.start + (a - span.start) % e
        ticks, keep = f"SELECT unnest(range({first}, {span.end}, {e})) AS t", ""
    candles = _candles_sql(d, positive)
    return f"""{candles},
        t AS ({ticks}),
        g AS (SELECT t, arg_min(open, timestamp) AS open, max(high) AS high, min(low) AS low, arg_max(close, timestamp) AS close, sum(volume) AS volume,
              count(timestamp) AS n, count(*) FILTER (WHERE volume > 0 AND NOT isnan(volume)) AS m
              FROM t LEFT JOIN c ON timestamp >= t - {w} AND timestamp + {d} <= t GROUP BY t),
        w AS (SELECT t - {w} AS open_time, t AS close_time, {PRICES}, n AS src_count, n * {d} AS coverage_seconds, m * {d} AS traded_seconds FROM g {keep})"""


def _windows(spark: SparkSession, sf_dir: str, d: int, w: int, e: int, a: int = 0, span: ExplicitRange | None = None, positive: bool = False, **more) -> DataFrame:
    candles, profile = _candles(spark, sf_dir, d, positive)
    return compute_windows(candles, profile, window=Duration(w), emit_every=Duration(e), anchor=Duration(a), materialization=span or "skip_warmup", **more)


def _window_query(name: str, d: int, w: int, e: int, a: int = 0, span: ExplicitRange | None = None, **more) -> None:
    QUERIES[name] = lambda spark, sf_dir: _windows(spark, sf_dir, d, w, e, a, span, **more)
    SQL[name] = f"WITH {_windows_sql(d, w, e, a, span)} SELECT {WINDOW} FROM w"


# --- windows: the flagship, then shapes of the grid ----------------------------------------------

_window_query("windows_skip_warmup", 900, 3600, 900)
_window_query("windows_aligned", 900, 3600, 3600, 0, RANGE)
_window_query("windows_rolling", 300, 3600, 300, 0, RANGE)
_window_query("windows_sparse_e_gt_w", 900, 1800, 7200, 0, RANGE)
_window_query("windows_anchor", 900, 3600, 1800, 900, RANGE)
_window_query("windows_explicit_overrun", 3600, 14_400, 3600, 0, ExplicitRange(DAY0 - 172_800, DAY0 + 35 * 86_400))
_window_query("windows_minute", 60, 900, 60, 0, RANGE)
_window_query("windows_two_block", 300, 86_400, 300, 0, RANGE, plan="blocks")
_window_query("windows_two_block_wide", 900, 604_800, 900, 0, RANGE, on_grid=True)
_window_query("windows_two_block_sparse", 300, 3600, 7200, 0, RANGE, plan="blocks")
_window_query("windows_deterministic", 900, 3600, 900, 0, RANGE, deterministic=True)
_window_query("windows_empty_range", 900, 3600, 900, 0, ExplicitRange(DAY0, DAY0))


def _named(d: int) -> str:
    return f"candles_{d // 60}m"


for _d in (300, 900, 3600):
    QUERIES[_named(_d)] = lambda spark, sf_dir, d=_d: _candles(spark, sf_dir, d)[0]
    SQL[_named(_d)] = f"WITH {_candles_sql(_d)} SELECT timestamp, {PRICES} FROM c"


@_query("candles_orders_daily", f"""
    SELECT s - s % 86400 AS timestamp, arg_min(o_totalprice, k) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, k) AS close, CAST(count(*) AS DOUBLE) AS volume
    FROM (SELECT epoch_us(o_orderdate) // 1000000 AS s, epoch_us(o_orderdate)::HUGEINT * 10000000000 + o_orderkey AS k, o_totalprice FROM orders) GROUP BY 1""")  # fmt: skip
def _orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles_from_orders(spark.read.parquet(f"{sf_dir}/orders.parquet"))


LADDER = [(3600, 1800), (14_400, 3600), (86_400, 7200)]


@_query("windows_ladder", f"WITH {_candles_sql(900)}," + ", ".join(
    f"""t{k} AS (SELECT unnest(range({RANGE.start + (0 - RANGE.start) % e}, {RANGE.end}, {e})) AS t),
    g{k} AS (SELECT {w} AS window_seconds, {e} AS emit_seconds, t, arg_min(open, timestamp) AS open, max(high) AS high, min(low) AS low, arg_max(close, timestamp) AS close, sum(volume) AS volume,
    count(timestamp) AS n, count(*) FILTER (WHERE volume > 0) AS m FROM t{k} LEFT JOIN c ON timestamp >= t - {w} AND timestamp + 900 <= t GROUP BY t)"""
    for k, (w, e) in enumerate(LADDER)
) + " SELECT window_seconds::BIGINT AS window_seconds, emit_seconds::BIGINT AS emit_seconds, t - window_seconds AS open_time, t AS close_time, open, high, low, close, volume, n AS src_count, n * 900 AS coverage_seconds, m * 900 AS traded_seconds FROM ("
    + " UNION ALL ".join(f"SELECT * FROM g{k}" for k in range(len(LADDER))) + ")")
def _ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    candles, profile = _candles(spark, sf_dir, 900)
    return compute_ladder(candles, profile, [(Duration(w), Duration(e)) for w, e in LADDER], materialization=RANGE)


@_query("windows_by_type", f"""WITH e AS (SELECT event_type, epoch_us(ts) // 1000000 AS s, epoch_us(ts) AS us, value FROM events),
    c AS (SELECT event_type, s - s % 3600 AS timestamp, arg_min(value, us) AS open, max(value) AS high, min(value) AS low, arg_max(value, us) AS close, CAST(count(*) AS DOUBLE) AS volume FROM e GROUP BY 1, 2),
    t AS (SELECT event_type, unnest(range({DAY0}, {RANGE.end}, 3600)) AS t FROM (SELECT DISTINCT event_type FROM c)),
    g AS (SELECT t.event_type, t, arg_min(open, timestamp) AS open, max(high) AS high, min(low) AS low, arg_max(close, timestamp) AS close, sum(volume) AS volume, count(timestamp) AS n, count(*) FILTER (WHERE volume > 0) AS m
          FROM t LEFT JOIN c ON c.event_type = t.event_type AND timestamp >= t - 14400 AND timestamp + 3600 <= t GROUP BY 1, 2)
    SELECT event_type, t - 14400 AS open_time, t AS close_time, {PRICES}, n AS src_count, n * 3600 AS coverage_seconds, m * 3600 AS traded_seconds FROM g""")  # fmt: skip
def _by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    from candlespark.adapters import epoch_seconds

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = epoch_seconds(F.col("ts"))
    at = F.struct("ts", "event_id")
    rows = events.withColumn("timestamp", s - F.pmod(s, F.lit(3600))).groupBy("event_type", "timestamp")
    candles = rows.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").cast("double").alias("volume"))
    return compute_windows(candles, candle_profile("by type", "1h"), window="4h", emit_every="1h", materialization=RANGE, partition_by="event_type")


@_query("windows_streamed", f"WITH {_windows_sql(900, 3600, 900, 0, ExplicitRange(DAY0 - 7200, DAY0 + 40 * 86_400))} SELECT {WINDOW} FROM w WHERE src_count > 0")
def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    candles, profile = _candles(spark, sf_dir, 900)
    return stream_windows(candles, profile, window="1h", emit_every="15m")


# --- quality, annotations, validation ------------------------------------------------------------

_LOW = "coalesce(coverage_seconds < 2700, true)"
_IDLE = "coalesce(traded_seconds < 900, true)"
POLICY = WindowQualityPolicy(QualityMode.FILTER, min_coverage=0.75, min_traded_seconds=900)


@_query("quality_filter", f"WITH {_windows_sql(900, 3600, 900, 0, RANGE)} SELECT {WINDOW} FROM w WHERE coverage_seconds >= 2700 AND traded_seconds >= 900")
def _quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_quality_policy(_windows(spark, sf_dir, 900, 3600, 900, 0, RANGE), POLICY, window="1h").frame


@_query("quality_report", f"""WITH {_windows_sql(900, 3600, 900, 0, RANGE)} SELECT count(*) AS rows, 2700::BIGINT AS min_coverage_seconds, 900::BIGINT AS min_traded_seconds,
    count(*) FILTER (WHERE {_LOW} OR {_IDLE}) AS below_either, count(*) FILTER (WHERE {_LOW}) AS below_coverage, count(*) FILTER (WHERE {_IDLE}) AS below_traded,
    count(*) - count(coverage_seconds) AS null_coverage, count(*) - count(traded_seconds) AS null_traded, min(close_time) FILTER (WHERE {_LOW} OR {_IDLE}) AS first_offending_close_time FROM w""")  # fmt: skip
def _quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_windows(spark, sf_dir, 900, 3600, 900, 0, RANGE), POLICY, "1h")


def _sidecar(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INTERVALS, "start_timestamp long, end_timestamp long, flag string")


_I = "i(s, e, f) AS (VALUES " + ", ".join(f"({s}, {e}, '{f}')" for s, e, f in INTERVALS) + ")"
_U = """p AS (SELECT s, e, max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
    q AS (SELECT s, e, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (ORDER BY s, e) AS k FROM p), u AS (SELECT min(s) AS s, max(e) AS e FROM q GROUP BY k)"""


@_query("annotate_windows", f"""WITH {_windows_sql(900, 3600, 900, 0, RANGE)}, {_I}, {_U},
    a AS (SELECT close_time AS ct, list_sort(list_distinct(list(f))) AS fl FROM w JOIN i ON open_time < i.e AND close_time > i.s GROUP BY 1),
    b AS (SELECT close_time AS ct, CAST(sum(least(close_time, u.e) - greatest(open_time, u.s)) AS BIGINT) AS n FROM w JOIN u ON open_time < u.e AND close_time > u.s GROUP BY 1)
    SELECT open_time, close_time, src_count, array_to_string(coalesce(fl, []), '|') AS flags, coalesce(n, 0) AS overlap_seconds FROM w LEFT JOIN a ON a.ct = close_time LEFT JOIN b ON b.ct = close_time""")  # fmt: skip
def _annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = annotate_windows(_windows(spark, sf_dir, 900, 3600, 900, 0, RANGE), _sidecar(spark))
    return out.select("open_time", "close_time", "src_count", F.array_join("annotation_flags", "|").alias("flags"), F.col("annotation_overlap_seconds").alias("overlap_seconds"))


_STEPS = "s AS (SELECT timestamp, timestamp - lag(timestamp) OVER (ORDER BY timestamp) AS diff FROM c)"


@_query("find_gaps", f"WITH {_candles_sql(300)}, {_STEPS.replace('s AS', 'z AS', 1)} SELECT timestamp - diff + 300 AS expected_start, timestamp AS next_open, diff // 300 - 1 AS missing_count FROM z WHERE diff > 300 AND diff % 300 = 0")
def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_gaps(*_candles(spark, sf_dir, 300))


@_query("validation_report", f"""WITH {_candles_sql(300)}, {_STEPS.replace('s AS', 'z AS', 1)}
    SELECT 'off_phase' AS kind, count(*) FILTER (WHERE timestamp % 300 <> 0) AS count FROM z UNION ALL SELECT 'non_increasing_timestamps', count(*) FILTER (WHERE diff <= 0) FROM z
    UNION ALL SELECT 'overlapping_intervals', count(*) FILTER (WHERE diff > 0 AND diff < 300) FROM z UNION ALL SELECT 'irregular_interval', count(*) FILTER (WHERE diff > 300 AND diff % 300 <> 0) FROM z
    UNION ALL SELECT 'gap', count(*) FILTER (WHERE diff > 300 AND diff % 300 = 0) FROM z""")  # fmt: skip
def _validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation_counts(*_candles(spark, sf_dir, 300))


# --- returns, excursions, calendar ---------------------------------------------------------------

_R = f"WITH {_windows_sql(900, 3600, 900, 0, RANGE)}"


def _return_sql(forward: bool, log: bool) -> str:
    n, d = ("o.close", "w.close") if forward else ("w.close", "o.close")
    ratio = f"({n} - {d}) / {d}"
    value = f"round(ln(1 + {ratio}), 9)" if log else ratio
    finite = f"CASE WHEN {d} <> 0 AND {ratio} > -1 THEN {value} END" if log else f"CASE WHEN {d} <> 0 THEN {value} END"
    name = f"{'forward' if forward else 'backward'}_return_{'log' if log else 'simple'}_4h"
    extra = f", w.close_time + 14400 AS {name}_available_at" if forward else ""
    return f"{_R} SELECT w.close_time, w.close, {finite} AS {name}{extra} FROM w LEFT JOIN w o ON o.close_time = w.close_time {'+' if forward else '-'} 14400"


def _return_query(forward: bool, method: ReturnMethod) -> None:
    name = f"{'forward' if forward else 'backward'}_return_{method.value}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        add = add_forward_returns if forward else add_backward_returns
        out = add(_windows(spark, sf_dir, 900, 3600, 900, 0, RANGE), horizon="4h", cadence="15m", method=method, checked=False)
        value = F.col(f"{name}_4h")
        return out.select("close_time", "close", (F.round(value, 9) if method is ReturnMethod.LOG else value).alias(f"{name}_4h"), *([f"{name}_4h_available_at"] if forward else []))

    QUERIES[name], SQL[name] = run, _return_sql(forward, method is ReturnMethod.LOG)


for _forward in (False, True):
    for _method in ReturnMethod:
        _return_query(_forward, _method)


def _excursion_query(method: ReturnMethod) -> None:
    name, log = f"forward_excursions_{method.value}", method is ReturnMethod.LOG

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = add_forward_excursions(_windows(spark, sf_dir, 900, 3600, 900, 0, RANGE), horizon="4h", cadence="15m", method=method)
        values = [F.col(f"forward_{k}_{method.value}_4h") for k in ("mfe", "mae")]
        return out.select("close_time", *((F.round(v, 9) if log else v).alias(k) for k, v in zip(("mfe", "mae"), values)), F.col(f"forward_excursion_{method.value}_4h_available_at").alias("available_at"))

    def value(x: str) -> str:
        ratio = f"({x} - close) / close"
        return f"CASE WHEN n = 16 AND close <> 0 AND {ratio} > -1 THEN round(ln(1 + {ratio}), 9) END" if log else f"CASE WHEN n = 16 AND close <> 0 THEN {ratio} END"

    over = "OVER (ORDER BY close_time ROWS BETWEEN 1 FOLLOWING AND 16 FOLLOWING)"
    QUERIES[name] = run
    SQL[name] = f"{_R}, x AS (SELECT close_time, close, count(high) {over} AS n, max(high) {over} AS hi, min(low) {over} AS lo FROM w) SELECT close_time, {value('hi')} AS mfe, {value('lo')} AS mae, close_time + 14400 AS available_at FROM x"


for _method in ReturnMethod:
    _excursion_query(_method)


@_query("calendar_columns", f"""WITH {_candles_sql(900)} SELECT timestamp, round(sin((timestamp % 86400) * {math.tau / 86_400!r}), 9) AS cal_mod_sin, round(cos((timestamp % 86400) * {math.tau / 86_400!r}), 9) AS cal_mod_cos,
    round(sin(((timestamp + 259200) % 604800) * {math.tau / 604_800!r}), 9) AS cal_dow_sin, round(cos(((timestamp + 259200) % 604800) * {math.tau / 604_800!r}), 9) AS cal_dow_cos,
    timestamp % 86400 AS second_of_day, (timestamp + 259200) % 604800 AS second_of_week, ((timestamp + 259200) % 604800) // 86400 AS day_of_week FROM c""")  # fmt: skip
def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = add_calendar_columns(_candles(spark, sf_dir, 900)[0].select("timestamp"), "timestamp")
    t = F.col("timestamp")
    rounded = [F.round(c, 9).alias(c) for c in ("cal_mod_sin", "cal_mod_cos", "cal_dow_sin", "cal_dow_cos")]
    return out.select("timestamp", *rounded, second_of_day(t).alias("second_of_day"), second_of_week(t).alias("second_of_week"), day_of_week(t).alias("day_of_week"))


# --- phased lookback and indicators --------------------------------------------------------------

_PW, _PE = 14_400, 7200


def _phased(spark: SparkSession, sf_dir: str, lookback: int, traded: int = 0):
    frame = _windows(spark, sf_dir, 3600, _PW, 3600, 0, RANGE, positive=True)
    return phased_lookback(frame, window=Duration(_PW), emit_every=Duration(_PE), lookback=lookback, min_traded_seconds=traded)


def _phased_sql(lookback: int, traded: int = 0) -> str:
    joins = " ".join(f"LEFT JOIN ok x{k} ON x{k}.close_time = k.t - {k * _PW}" for k in range(lookback))
    whole = " AND ".join(f"x{k}.close_time IS NOT NULL" for k in range(lookback))
    lists = ", ".join(f"CASE WHEN {whole} THEN [{', '.join(f'x{k}.{c}' for k in range(lookback))}] END AS {c}" for c in ("open", "high", "low", "close", "volume", "src_count", "coverage_seconds", "traded_seconds"))
    first = DAY0 + (0 - DAY0) % _PE
    return f"""WITH {_windows_sql(3600, _PW, 3600, 0, RANGE, positive=True)}, ok AS (SELECT * FROM w WHERE traded_seconds >= {traded} AND close IS NOT NULL),
        k AS (SELECT unnest(range({first}, (SELECT max(close_time) + 1 FROM w), {_PE})) AS t), ph AS (SELECT k.t AS close_time, {lists} FROM k {joins})"""


@_query("phased_lookback", f"{_phased_sql(3)} SELECT close_time, array_to_string(close, '|') AS close, array_to_string(volume, '|') AS volume, array_to_string(src_count, '|') AS src_count, array_to_string(traded_seconds, '|') AS traded_seconds FROM ph")
def _lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = [F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(c) for c in ("close", "volume", "src_count", "traded_seconds")]
    return _phased(spark, sf_dir, 3).frame.select("close_time", *joined)


def _indicator_query(name: str, primitive, period: int, traded: int, sql: str) -> None:
    lookback = primitive.lookback(period)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = add_indicator(_phased(spark, sf_dir, lookback, traded), primitive, period=period, strict=False)
        return out.select("close_time", F.round(f"{primitive.name}_p{period}_w{Duration(_PW)}", 9).alias("value"))

    QUERIES[name] = run
    SQL[name] = f"{_phased_sql(lookback, traded)} SELECT close_time, round({sql}, 9) AS value FROM ph"


_P = 5
_up = " + ".join(f"greatest(close[{k + 1}] - close[{k + 2}], 0)" for k in range(_P))
_down = " + ".join(f"greatest(close[{k + 2}] - close[{k + 1}], 0)" for k in range(_P))
_indicator_query("rsi", CutlersRSI(), _P, 0, f"CASE WHEN close IS NULL THEN NULL WHEN ({_up}) + ({_down}) = 0 THEN 50.0 ELSE 100.0 * (({_up}) / (({_up}) + ({_down}))) END")
_tr = " + ".join(f"greatest(high[{k + 1}], close[{k + 2}]) - least(low[{k + 1}], close[{k + 2}])" for k in range(_P))
_indicator_query("relrange", RelativeRange(), _P, 0, f"CASE WHEN close IS NOT NULL THEN ({_tr}) / {_P}.0 / close[1] END")
_indicator_query("logvolratio", LogVolumeRatio(), _P, 1, f"CASE WHEN volume IS NOT NULL THEN ln(volume[1] / list_median(volume[2:{_P + 1}])) END")
_indicator_query("mapos", PriceToMovingAverage(), _P, 0, f"CASE WHEN close IS NOT NULL THEN ln(close[1] / list_avg(close)) END")


def queries() -> dict[str, Query]:
    import candlespark.contracts  # noqa: F401  registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    import candlespark.contracts  # noqa: F401

    return dict(SQL)
