"""All physical plans of a window give the same rows, bit for bit, and volumes that math.fsum gives."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlespark.columns import ROW
from candlespark.operators import events, exact, kernels, sweep
from candlespark.operators import windows as plans
from candlespark.operators.grid import ExplicitRange, resolve_schedule
from candlespark.operators.reference import compute_reference_windows
from candlespark.operators.windows import compute_ladder, compute_windows
from candlespark.sources.profile import candle_profile
from tests.oracle import candles, windows
from tests.test_windows import SCHEMA, T0, _frame, _got

PROFILE = candle_profile("f", "1m")


def _bits(df):
    return sorted((tuple(repr(v) for v in r) for r in df.collect()), key=lambda r: int(r[1]))


def _odd_rows(rng, n, step=60):
    rows = []
    for k in range(n):
        for _ in range(rng.choice([0, 1, 1, 1, 2, 3])):
            o = rng.choice([None, float("nan"), *[20 + rng.randrange(80) * 0.25] * 20])
            volume = rng.choice([None, 0.0, 1e-7, float("nan"), math.inf, *(rng.random() * 10.0 ** rng.randrange(-9, 9) for _ in range(30))])
            rows.append((T0 + step * k, o, o and o + 1, o and o - 1, rng.choice([None, o, 21.5]), volume))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("numbered", [True, False])
def test_null_nan_and_tied_candles_on_the_grid(spark, numbered):
    rows = _odd_rows(random.Random(21), 200)
    df = _frame(spark, rows).repartition(3) if numbered else spark.createDataFrame(rows, SCHEMA).repartition(3)
    span = ExplicitRange(T0 - 3600, T0 + 240 * 60)
    for w, e in ((5, 1), (30, 7)):
        made = lambda plan, w=w, e=e: compute_windows(df, PROFILE, window=f"{w}m", emit_every=f"{e}m", materialization=span, plan=plan)
        found = [_bits(made(plan)) for plan in ("explode", "blocks", "sweep", "search")]
        assert found[0] == found[1] == found[2] == found[3]
        assert found[0] == _bits(compute_reference_windows(df, PROFILE, window=f"{w}m", emit_every=f"{e}m", materialization=span))


def test_an_open_null_among_two_candles_of_one_instant(spark):
    df = spark.createDataFrame([(T0, None, 6.0, 4.0, 5.5, 1.0), (T0, 5.0, 6.0, 1.0, 1.5, 1.0)], SCHEMA)
    span = ExplicitRange(T0 + 60, T0 + 61)
    found = [[r[2:6] for r in _got(compute_windows(df, PROFILE, window="1m", emit_every="1m", materialization=span, plan=plan))] for plan in ("explode", "blocks", "sweep", "search")]
    assert found == [[(None, 6.0, 1.0, 5.5)]] * 4


@pytest.mark.parametrize("tied", [True, False])
def test_off_the_grid(spark, monkeypatch, tied):
    monkeypatch.setattr(events, "CHUNK_SECONDS", 900)
    rng = random.Random(22)
    rows = [(T0 + rng.randrange(6000), *r[1:]) for r in candles(23, 60, 300, T0)]
    rows += [(r[0], *candles(k, 60, 1, T0)[0][1:]) for k in range(3 if not tied else 80) for r in rows[:5]]
    df, span = _frame(spark, rows), ExplicitRange(T0 - 600, T0 + 9000)
    for w, e in ((1, 1), (7, 2), (33, 1), (5, 9)):
        want = windows(rows, 60, 60 * w, 60 * e, 0, span.start, span.end)
        for plan in ("search", "explode"):
            assert _got(compute_windows(df, PROFILE, window=f"{w}m", emit_every=f"{e}m", materialization=span, plan=plan)) == want
    ladder = compute_ladder(df, PROFILE, [("1m", "1m"), ("33m", "4m")], materialization=span)
    assert sorted(map(tuple, ladder.collect())) == sorted((w, e, *r) for w, e in ((60, 60), (1980, 240)) for r in windows(rows, 60, w, e, 0, span.start, span.end))
    keyed = df.withColumn("key", F.when(F.col(ROW) % 3 == 0, F.lit("a")))
    out = compute_windows(keyed, PROFILE, window="33m", emit_every="2m", materialization=span, partition_by="key", plan="search").collect()
    for key in ("a", None):
        some = [r for k, r in enumerate(rows) if (k % 3 == 0) == (key == "a")]
        assert sorted((tuple(r)[1:] for r in out if r["key"] == key), key=lambda r: r[1]) == windows(some, 60, 1980, 120, 0, span.start, span.end)


def test_null_nan_and_tied_candles_off_the_grid(spark):
    rows = [(r[0] + (k * 7) % 50, *r[1:]) for k, r in enumerate(_odd_rows(random.Random(24), 200))]
    span = ExplicitRange(T0 - 3600, T0 + 300 * 60)
    for df in (_frame(spark, rows).repartition(3), spark.createDataFrame(rows, SCHEMA)):
        found = [_bits(compute_windows(df, PROFILE, window="9m", emit_every="2m", materialization=span, plan=plan)) for plan in ("explode", "search")]
        assert found[0] == found[1] == _bits(compute_reference_windows(df, PROFILE, window="9m", emit_every="2m", materialization=span))


def test_a_large_source_off_its_grid_is_searched(spark, monkeypatch):
    from candlespark.operators import windows as module

    monkeypatch.setattr(module, "EXPLODE_ROWS", 100)
    monkeypatch.setattr(module, "_explode_plan", None)  # would fail
    rows = [(r[0] + (30 if k == 50 else 0), *r[1:]) for k, r in enumerate(candles(25, 60, 120, T0))]
    got = _got(compute_windows(_frame(spark, rows), PROFILE, window="17m", emit_every="1m", materialization=ExplicitRange(T0, T0 + 8000)))
    assert got == windows(rows, 60, 1020, 60, 0, T0, T0 + 8000)


def _scale_volumes(n):
    """Activity in stretches, over nine decades, with stretches of exact zeros."""
    rng = np.random.default_rng(26)
    k = np.arange(n)
    value = rng.random(n) * 10.0 ** (k % 9 - 4)
    value[k % 1024 == 999] = 5e-07
    value[(k % 1024 > 999) | (k % 65_536 >= 39_000)] = 0.0
    return value


def test_volumes_at_scale_are_those_of_fsum_in_every_plan_and_ladder(spark):
    n, start = 120_000, 1_600_000_020
    volume = _scale_volumes(n)
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"timestamp": start + 60 * np.arange(n), "volume": volume})).repartition(5)
    df = df.select("timestamp", *(F.lit(1.0).alias(c) for c in ("open", "high", "low", "close")), "volume")
    span = ExplicitRange(start + 60 * 30_000, start + 60 * n + 1)
    found = {}
    for minutes, plans in ((8, ("explode", "sweep", "search", "blocks")), (993, ("sweep", "search")), (17_632, ("sweep", "search"))):
        for plan in plans:
            out = compute_windows(df, PROFILE, window=f"{minutes}m", emit_every="7m", materialization=span, plan=plan).orderBy("close_time").select("close_time", "volume").toPandas()
            assert minutes not in found or (found[minutes] == out["volume"]).all()
            found[minutes] = out["volume"]
        at = ((out["close_time"] - start) // 60).to_numpy()
        for i in range(0, len(at), 97):
            inside = volume[max(0, at[i] - minutes) : at[i]]
            exactly = math.fsum(inside)
            assert found[minutes][i] == exactly and (exactly > 0) == inside.any()
    ladder = compute_ladder(df, PROFILE, [(f"{m}m", "7m") for m in found], materialization=span).orderBy("close_time").toPandas()
    for m, want in found.items():
        assert (ladder[ladder["window_seconds"] == 60 * m]["volume"].to_numpy() == want.to_numpy()).all()


def test_sums_are_exact_whatever_the_order():
    rng = np.random.default_rng(27)
    for k in range(400):
        n = rng.integers(1, 50)
        x = np.ldexp(rng.integers(0, 1 << 53, n).astype(float), rng.integers(-110, 15, n)) * rng.choice([1, 1, -1], n)
        limbs, odd = exact.limbs_of(x)
        assert not odd.any() and exact.totals(list(limbs.sum(1, keepdims=True)))[0] == math.fsum(x)
    _, odd = exact.limbs_of(np.array([0.0, -0.0, exact.LEAST, -exact.MOST / 2, exact.LEAST / 2, exact.MOST, math.inf, math.nan]))
    assert odd.tolist() == [False] * 4 + [True] * 4 and exact.totals([None] * exact.LIMBS) is None


def test_spark_and_numpy_round_sums_alike(spark):
    rng = random.Random(28)
    rows = [(k % 40, rng.choice([None, rng.uniform(-1, 1) * 10.0 ** rng.randrange(-25, 20)])) for k in range(2000)] + [(50, None), (51, math.nan), (51, 1.0), (52, 1e300), (52, 2.0)]
    df = exact.with_limbs(spark.createDataFrame(rows, "g int, volume double").repartition(7)).groupBy("g").agg(*exact.sums())
    got = {r["g"]: r["volume"] for r in exact.with_total(df).collect()}
    assert got[50] is None and math.isnan(got[51]) and got[52] == 1e300
    assert all(got[g] == math.fsum(v for h, v in rows if h == g and v is not None) for g in range(40))


def test_range_values_and_sums():
    rng = np.random.default_rng(29)
    x = rng.integers(-99, 99, 500)
    low = np.sort(rng.integers(0, 500, 300))
    high = np.minimum(500, low + rng.integers(0, 200, 300))
    want = [x[a:b].max(initial=-1000) for a, b in zip(low, high)]
    assert kernels.range_values(x, low, high, np.maximum, -1000).tolist() == want
    assert kernels.range_sums(x.astype(float), low, high).tolist() == [x[a:b].sum() for a, b in zip(low, high)]
    assert sweep.chunk_ticks(0, 100, 10, 7, 3, 60).tolist() == [10, 17, 24, 31, 38, 45, 52, 59]


def test_each_key_skips_its_own_warmup(spark):
    own = {"a": candles(41, 60, 60, T0), "b": candles(42, 60, 50, T0 + 1200), None: candles(43, 60, 30, T0 + 300, drop={4}), "short": candles(44, 60, 3, T0)}
    df = spark.createDataFrame([(*r, k) for k, rows in own.items() for r in rows], f"{SCHEMA}, key string")
    for plan in ("auto", "sweep"):
        got = {}
        for r in compute_windows(df, PROFILE, window="8m", emit_every="1m", partition_by="key", plan=plan).collect():
            got.setdefault(r["key"], []).append(tuple(r)[1:])
        want = {}
        for key, rows in own.items():
            every = windows(rows, 60, 480, 60, 0, T0, rows[-1][0] + 61)
            first = next((k for k, r in enumerate(every) if r[8] == 480), None)
            if first is not None:
                want[key] = every[first:]
        assert {k: sorted(v, key=lambda r: r[1]) for k, v in got.items()} == want and set(want) == {"a", "b", None}
    from candlespark.errors import ConfigError

    with pytest.raises(ConfigError, match="by any key"):
        compute_windows(df.where("key = 'short'"), PROFILE, window="8m", emit_every="1m", partition_by="key")


def test_first_full_windows_of_one_pass_are_those_of_every_run(spark, monkeypatch):
    monkeypatch.setattr("candlespark.operators.windows.STRETCH_BITS", 7)  # two pages a stretch
    rng = random.Random(3)
    schema = "timestamp long, open double, high double, low double, close double, volume double"
    pairs = [(1, 1), (2, 3), (7, 2), (64, 1), (65, 5), (130, 7), (400, 1)]
    for share in (0.0, 0.002, 0.02, 0.3, 0.9):
        start = rng.randrange(-500, 500)
        held = [k for k in range(start, start + 1500) if rng.random() >= share] or [start]
        df = spark.createDataFrame([(60 * k, *([1.0] * 5)) for k in held], schema).repartition(3)
        candles, schedules = plans.extract_candles(df, PROFILE), [resolve_schedule(PROFILE, window=f"{w}m", emit_every=f"{e}m") for w, e in pairs]
        span = plans._warm_span(candles, schedules)
        assert (span.low, span.high, span.off, span.unique) == (60 * held[0], 60 * held[-1], 0, True)
        have = set(held)
        for (w, e), s in zip(pairs, schedules):
            full = [t for t in range(held[0], held[-1] + 2) if t % e == 0 and all(k in have for k in range(t - w, t))]
            assert span.full[s] == (60 * full[0] if full else None), (share, w, e)


def test_first_full_window_of_repeated_candles_is_counted(spark):
    held = [1, 1, 2, 3, 5, 6, 6, 7]
    df = spark.createDataFrame([(60 * k, *([1.0] * 5)) for k in held], "timestamp long, open double, high double, low double, close double, volume double")
    for full in (2, 3):
        got = compute_windows(df, PROFILE, window=f"{full}m", emit_every="1m")
        ticks = [t for t in range(1 + full, 9) if sum(t - full <= k < t for k in held) == full]
        assert got.agg(F.min("close_time")).first()[0] == 60 * ticks[0]
