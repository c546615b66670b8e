from __future__ import annotations

import random

import pytest

from candlespark.columns import ROW
from candlespark.errors import ConfigError
from candlespark.operators.grid import ExplicitRange
from candlespark.operators.windows import compute_ladder, compute_windows
from candlespark.sources.profile import candle_profile
from tests.oracle import FIELDS, candles, windows

T0 = 1_700_000_040
SCHEMA = "timestamp long, open double, high double, low double, close double, volume double"
FAMILIES = {
    "complete": (60, 0, candles(1, 60, 40, T0)),
    "gaps": (60, 0, candles(2, 60, 40, T0, drop={1, 2, 13, 22, 23, 24, 25, 38})),
    "untraded": (60, 0, candles(3, 60, 40, T0, untraded=range(7, 13))),
    "phased": (60, 7, candles(4, 60, 40, T0 + 7)),
    "seconds": (1, 0, candles(5, 1, 30, T0)),
}


def _frame(spark, rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], f"{SCHEMA}, {ROW} long")


def _got(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[1])


@pytest.mark.parametrize("family", FAMILIES)
@pytest.mark.parametrize("plan", ["explode", "blocks", "sweep"])
def test_against_brute_force(spark, family, plan):
    d, p, rows = FAMILIES[family]
    df, profile = _frame(spark, rows), candle_profile("f", f"{d}s", p)
    span = ExplicitRange(T0 - 5 * d, T0 + 60 * d)
    for w, e, a in ((5, 1, 0), (4, 2, 1), (10, 10, 0), (3, 7, 2)):
        a = a * d + p
        got = _got(compute_windows(df, profile, window=f"{w * d}s", emit_every=f"{e * d}s", anchor=f"{a}s", materialization=span, plan=plan))
        assert got == windows(rows, d, w * d, e * d, a, span.start, span.end)


def test_off_phase_duplicates_and_ties(spark):
    rows = candles(6, 60, 30, T0) + [(T0 + 5 * 60 + 30, 1.0, 2.0, 0.5, 1.5, 3.0), (T0 + 7 * 60, 9.0, 9.5, 8.0, 8.5, 1.0), (T0 + 7 * 60, 7.0, 7.5, 6.0, 6.5, 2.0)]
    got = _got(compute_windows(_frame(spark, rows), candle_profile("f", "1m"), window="4m", emit_every="2m", materialization=ExplicitRange(T0, T0 + 2000), deterministic=True))
    assert got == windows(rows, 60, 240, 120, 0, T0, T0 + 2000)


def test_plans_agree_on_ties_nulls_and_nan(spark):
    rng = random.Random(7)
    rows = []
    for k in range(400):
        for _ in range(rng.choice([0, 1, 1, 1, 2, 3])):
            o = rng.choice([None, float("nan"), *[20 + rng.randrange(80) * 0.25] * 20])
            rows.append((T0 + 60 * k, o, o and o + 1, o and o - 1, rng.choice([None, o, 21.5]), rng.choice([None, 0.0, 0.25, 7.5, float("nan"), *[3.0] * 20])))
    rng.shuffle(rows)
    profile, span = candle_profile("f", "1m"), ExplicitRange(T0 - 3600, T0 + 500 * 60)
    numbered, plain = _frame(spark, rows).repartition(3), spark.createDataFrame(rows, SCHEMA)
    for df in (numbered, plain):
        for w, e in ((5, 1), (30, 7), (64, 64)):
            found = [[tuple(repr(v) for v in r) for r in _got(compute_windows(df, profile, window=f"{w}m", emit_every=f"{e}m", materialization=span, plan=plan))] for plan in ("explode", "blocks", "sweep")]
            if df is numbered:
                assert found[0] == found[1] == found[2]
            else:  # nulls among rows of equal open times have no order of their own
                assert [[r[3:5] + r[6:] for r in f] for f in found[1:]] == [[r[3:5] + r[6:] for r in found[0]]] * 2


def test_keys_and_chunks(spark, monkeypatch):
    from candlespark.operators import sweep as module

    monkeypatch.setattr(module, "CHUNK_SLOTS", 16)
    a, b = candles(8, 60, 90, T0, drop={3, 4, 50}), candles(9, 60, 20, T0 + 1800)
    df = spark.createDataFrame([(*r, k) for k, rows in (("a", a), ("b", b), (None, b)) for r in rows], f"{SCHEMA}, key string")
    out = compute_windows(df, candle_profile("f", "1m"), window="9m", emit_every="2m", materialization=ExplicitRange(T0, T0 + 6000), partition_by="key", plan="sweep")
    got = {}
    for r in out.collect():
        got.setdefault(r[0], []).append(tuple(r)[1:])
    want = {k: windows(rows, 60, 540, 120, 0, T0, T0 + 6000) for k, rows in (("a", a), ("b", b), (None, b))}
    assert {k: sorted(v, key=lambda r: r[1]) for k, v in got.items()} == want


def test_sources_off_their_grid(spark):
    rows = [*candles(6, 60, 30, T0), (T0 + 5 * 60 + 30, 1.0, 2.0, 0.5, 1.5, 3.0)]
    df, profile, span = _frame(spark, rows), candle_profile("f", "1m"), ExplicitRange(T0, T0 + 2000)
    assert _got(compute_windows(df, profile, window="8m", emit_every="1m", materialization=span, deterministic=True)) == windows(rows, 60, 480, 60, 0, T0, T0 + 2000)
    for plan in ("blocks", "sweep"):
        with pytest.raises(ConfigError):
            compute_windows(df, profile, window="8m", emit_every="1m", materialization=span, plan=plan)
        with pytest.raises(Exception, match="off the grid"):
            compute_windows(df, profile, window="8m", emit_every="1m", materialization=span, plan=plan, on_grid=True).collect()
    out = compute_ladder(df, profile, [("2m", "1m"), ("8m", "4m")], materialization=span)
    assert sorted(map(tuple, out.collect())) == sorted((w, e, *r) for w, e in ((120, 60), (480, 240)) for r in windows(rows, 60, w, e, 0, T0, T0 + 2000))


def test_ladder_skips_each_warmup(spark):
    rows = candles(11, 60, 200, T0, drop={1, 100})
    out = compute_ladder(_frame(spark, rows), candle_profile("f", "1m"), [("1m", "1m"), ("3m", "1m"), ("40m", "1m")])
    want = []
    for w in (60, 180, 2400):
        every = windows(rows, 60, w, 60, 0, T0, rows[-1][0] + 61)
        want += [(w, 60, *r) for r in every[next(k for k, r in enumerate(every) if r[8] == w) :]]
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_skip_warmup_begins_at_the_first_full_window_and_keeps_later_gaps(spark):
    rows = FAMILIES["gaps"][2]
    got = _got(compute_windows(_frame(spark, rows), candle_profile("f", "1m"), window="4m", emit_every="1m"))
    want = windows(rows, 60, 240, 60, 0, T0, rows[-1][0] + 61)
    first = next(k for k, r in enumerate(want) if r[8] == 240)
    assert got == want[first:]
    with pytest.raises(ConfigError):
        compute_windows(_frame(spark, rows), candle_profile("f", "1m"), window="30m", emit_every="1m")
    with pytest.raises(ConfigError):
        compute_windows(_frame(spark, []), candle_profile("f", "1m"), window="4m", emit_every="1m")


def test_nan_and_null_volume_do_not_trade(spark):
    rows = [(T0 + 60 * k, 1.0, 1.0, 1.0, 1.0, v) for k, v in enumerate([float("nan"), None, 0.0, float("inf"), 2.0])]
    got = _got(compute_windows(_frame(spark, rows), candle_profile("f", "1m"), window="5m", emit_every="5m", anchor=f"{(T0 + 300) % 300}s", materialization=ExplicitRange(T0 + 300, T0 + 301)))
    assert got[0][7:] == (5, 300, 120)


def test_ladder_and_keys(spark):
    rows = FAMILIES["gaps"][2]
    span = ExplicitRange(T0, T0 + 3000)
    df, profile = _frame(spark, rows), candle_profile("f", "1m")
    ladder = compute_ladder(df, profile, [("2m", "1m"), ("10m", "5m")], materialization=span)
    for w, e in ((120, 60), (600, 300)):
        part = ladder.where(f"window_seconds = {w}").drop("window_seconds", "emit_seconds")
        assert _got(part) == windows(rows, 60, w, e, 0, span.start, span.end)
    from pyspark.sql import functions as F

    keyed = df.withColumn("symbol", F.lit("a")).unionByName(df.where("timestamp % 120 = 0").withColumn("symbol", F.lit("b")))
    for plan in ("explode", "blocks"):
        out = compute_windows(keyed, profile, window="10m", emit_every="5m", materialization=span, partition_by="symbol", plan=plan)
        for s, some in (("a", rows), ("b", [r for r in rows if r[0] % 120 == 0])):
            assert _got(out.where(f"symbol = '{s}'").drop("symbol")) == windows(some, 60, 600, 300, 0, span.start, span.end)


def test_columns_are_required(spark):
    df = spark.createDataFrame([(1, 1.0)], "timestamp long, open double")
    with pytest.raises(ConfigError):
        compute_windows(df, candle_profile("f", "1m"), window="1m", emit_every="1m")
    assert FIELDS[0] == "timestamp"


def test_minute_windows_cover_the_whole_month(spark, tmp_path):
    from pyspark.sql import functions as F

    from candlespark.catalog import DAY0, queries

    events = [(k, DAY0 + day * 86_400 + k * 37, 10.0 + k, "purchase" if k % 2 else "view") for k, day in enumerate([0, 0, 3, 9, 10, 10, 20, 29, 29])]
    df = spark.createDataFrame(events, "event_id long, s long, value double, event_type string")
    df.select("event_id", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, s)").alias("ts"), "value", "event_type").write.parquet(str(tmp_path / "events.parquet"))
    by_minute = {}
    for _, s, value, kind in events:
        by_minute.setdefault(s - s % 60, []).append((value, kind == "purchase"))
    rows = [(m, v[0][0], max(x for x, _ in v), min(x for x, _ in v), v[-1][0], float(sum(p for _, p in v))) for m, v in by_minute.items()]
    assert _got(queries()["windows_minute"](spark, str(tmp_path))) == windows(rows, 60, 900, 60, 0, DAY0, DAY0 + 31 * 86_400)
