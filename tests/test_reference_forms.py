from __future__ import annotations

from candlespark import api
from candlespark.columns import ROW
from tests.oracle import candles, windows

T0 = 1_700_000_040
SCHEMA = f"timestamp long, open double, high double, low double, close double, volume double, {ROW} long"


def test_specification_equals_engines(spark):
    rows = candles(7, 60, 60, T0, drop={3, 4, 20}, untraded=range(30, 40))
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], SCHEMA)
    profile, span = api.candle_profile("f", "1m"), api.ExplicitRange(T0, T0 + 4000)
    how = {"window": "6m", "emit_every": "1m", "materialization": span}
    spec = sorted(map(tuple, api.compute_reference_windows(df, profile, **how).collect()))
    assert spec == sorted(map(tuple, api.compute_windows(df, profile, **how).collect())) == sorted(windows(rows, 60, 360, 60, 0, T0, T0 + 4000))
    frame = api.compute_windows(df, profile, **how)
    look = {"window": "6m", "emit_every": "2m", "lookback": 3, "min_traded_seconds": 60}
    fast, slow = (sorted(map(tuple, f(frame, **look).frame.collect()), key=lambda r: r[0]) for f in (api.phased_lookback, api.phased_lookback_reference))
    assert fast == slow and any(r[1] for r in fast) and any(r[1] is None for r in fast)


def test_names_exist():
    assert all(hasattr(api, n) for n in api.__all__) and len(api.__all__) > 90


def test_long_lookbacks_over_many_chunks_are_those_of_exact_joins(spark, monkeypatch):
    import random

    from candlespark.operators import phased
    from candlespark.operators.reference import phased_lookback_reference

    monkeypatch.setattr(phased, "CHUNK_LOOKBACKS", 1)
    rng = random.Random(81)
    rows = []
    for k in range(-60, 400):
        if rng.random() < 0.98:
            t, v = 60 * k, rng.uniform(1, 9)
            rows.append((t - 180, t, v, v + 1, v - 1, rng.choice([None, *[v] * 60]), 5.0, 3, 180, rng.choice([0, 60, 120, 180])))
    names = "open_time long, close_time long, open double, high double, low double, close double, volume double, src_count long, coverage_seconds long, traded_seconds long"
    df = spark.createDataFrame(rows, names).repartition(3)
    for lookback, every, least in ((1, "1m", 0), (4, "2m", 60), (12, "7m", 0), (5, "3m", 0)):
        args = dict(window="3m", emit_every=every, lookback=lookback, min_traded_seconds=least, anchor="1m")
        got = sorted(map(str, phased.phased_lookback(df, **args).frame.collect()))
        assert got == sorted(map(str, phased_lookback_reference(df, **args).frame.collect())) and any("open=[" in r for r in got)
