"""Quality, annotations, returns, calendar, phased lookback, indicators."""

from __future__ import annotations

import math
import random
import statistics

import pytest

from candlespark.duration import Duration
from candlespark.errors import ConfigError, DataValidationError
from candlespark.functions import add_calendar_columns
from candlespark.operators import annotations as ann
from candlespark.operators.indicators import CutlersRSI, LogVolumeRatio, PriceToMovingAverage, RelativeRange, add_indicator
from candlespark.operators.phased import phased_lookback, resolve_phased_grid
from candlespark.operators.quality import GateMode, QualityMode, WindowCoverageError, WindowQualityPolicy, apply_quality_policy, least_passing_seconds
from candlespark.operators.returns import ReturnMethod, add_backward_returns, add_forward_excursions, add_forward_returns

T0 = 1_700_000_000


def test_exact_thresholds_and_modes(spark):
    assert least_passing_seconds(0.1, Duration(30)) == 3 and least_passing_seconds(0.29, Duration(100)) == 29
    df = spark.createDataFrame([(1, 30, 10), (2, 29, 10), (3, 30, 0), (4, None, 10)], "close_time long, coverage_seconds long, traded_seconds long")
    policy = WindowQualityPolicy(QualityMode.FILTER, 1.0, 5)
    out = apply_quality_policy(df, policy, window="30s")
    assert [r[0] for r in out.frame.collect()] == [1]
    r = out.report
    assert (r.rows, r.below_either, r.below_coverage, r.below_traded, r.null_coverage, r.first_offending_close_time) == (4, 3, 2, 1, 1, 2)
    assert WindowQualityPolicy.from_dict(policy.to_dict()) == policy
    with pytest.raises(WindowCoverageError) as e:
        apply_quality_policy(df, WindowQualityPolicy(QualityMode.GATE), window="30s")
    assert e.value.report.below_coverage == 2
    assert apply_quality_policy(df, WindowQualityPolicy(QualityMode.GATE, gate_mode=GateMode.REPORT), window="30s").frame.count() == 4
    with pytest.raises(ConfigError):
        apply_quality_policy(df.drop("traded_seconds"), policy, window="30s")
    for bad in (1.5, -0.1, math.nan, True):
        with pytest.raises(ConfigError):
            WindowQualityPolicy(QualityMode.FILTER, bad)


def test_annotations_both_plans(spark, monkeypatch):
    df = spark.createDataFrame([(1362225600 + 3600 * k, 1362229200 + 3600 * k) for k in range(4)], "open_time long, close_time long")
    side = spark.createDataFrame([(1362229320, 1362233460, "suspected_outage"), (1362230000, 1362231000, "b"), (1362225000, 1362225600, "before")], "start_timestamp long, end_timestamp long, flag string")
    want = [([], 0), (["b", "suspected_outage"], 3480), (["suspected_outage"], 660), ([], 0)]
    for limit in (2000, 0):
        monkeypatch.setattr(ann, "LITERAL_INTERVALS", limit)
        out = ann.annotate_windows(df, side).orderBy("open_time").collect()
        assert [(r["annotation_flags"], r["annotation_overlap_seconds"]) for r in out] == want
    with pytest.raises(ann.AnnotationValidationError):
        ann.annotate_windows(df, spark.createDataFrame([(5, 5, "x")], side.schema))
    with pytest.raises(ann.AnnotationValidationError):
        ann.annotate_windows(df, spark.createDataFrame([(5, None, "x")], side.schema))
    with pytest.raises(ConfigError):
        ann.annotate_windows(ann.annotate_windows(df, side), side)
    assert ann.annotate_windows(df, side.limit(0)).select("annotation_flags").first()[0] == []


def test_returns_by_exact_time(spark):
    t = [0, 60, 120, 180, 240, 300, 360, 420]
    closes = [128.0, 160.0, 0.0, 100.0, -50.0, 100.0, None, 100.0]
    df = spark.createDataFrame([(T0 + a, c) for a, c in zip(t, closes)], "close_time long, close double")
    out = add_backward_returns(df, horizon="1m", cadence="1m", method=ReturnMethod.SIMPLE).orderBy("close_time").collect()
    assert [r[2] for r in out] == [None, 0.25, -1.0, None, -1.5, -3.0, None, None]
    out = add_forward_returns(df.where(f"close_time != {T0 + 60}"), horizon="1m", cadence="1m", method=ReturnMethod.LOG).orderBy("close_time").collect()
    assert out[0][2] is None and [r[3] for r in out] == [r[0] + 60 for r in out]
    with pytest.raises(ConfigError):
        add_backward_returns(df.unionByName(df), horizon="1m", cadence="1m", method=ReturnMethod.SIMPLE)
    with pytest.raises(ConfigError):
        add_backward_returns(df, horizon="90s", cadence="1m", method=ReturnMethod.SIMPLE)


def test_excursions(spark):
    rows = [(T0 + 60 * i, h, low, 100.0) for i, (h, low) in enumerate([(101.0, 99.0), (104.0, 100.0), (103.0, 97.0), (106.0, 95.0)])]
    df = spark.createDataFrame(rows, "close_time long, high double, low double, close double")
    out = add_forward_excursions(df, horizon="2m", cadence="1m", method=ReturnMethod.SIMPLE).orderBy("close_time").collect()
    assert [(r[4], r[5]) for r in out] == [(0.04, -0.03), (0.06, -0.05), (None, None), (None, None)]
    with pytest.raises(ConfigError):
        add_forward_excursions(df.where(f"close_time != {T0 + 60}"), horizon="2m", cadence="1m", method=ReturnMethod.SIMPLE)
    many = [(60 * i - 300_000, float(100 + i % 37), float(90 - i % 29), 95.0 + i % 5) for i in range(9000)]
    big = spark.createDataFrame(many, df.schema)
    got = {r[0]: (r[4], r[5]) for r in add_forward_excursions(big, horizon="5m", cadence="1m", method=ReturnMethod.SIMPLE).collect()}
    assert len(got) == 9000
    for i in (0, 17, 4095, 4096, 5000, 8994):
        after, c = many[i + 1 : i + 6], many[i][3]
        want = ((max(r[1] for r in after) - c) / c, (min(r[2] for r in after) - c) / c) if len(after) == 5 else (None, None)
        assert got[many[i][0]] == want


def test_calendar_before_and_after_the_epoch(spark):
    df = spark.createDataFrame([(4 * 86_400,), (-1,)], "close_time long")
    rows = add_calendar_columns(df).collect()
    assert tuple(rows[0])[1:] == (0.0, 1.0, 0.0, 1.0)
    assert math.isclose(rows[1][1], math.sin(86_399 * math.tau / 86_400), abs_tol=1e-12)
    with pytest.raises(ConfigError):
        add_calendar_columns(add_calendar_columns(df))


def _window_frame(spark, n, drop=()):
    rows = [(T0 + 60 * k - 180, T0 + 60 * k, 100.0 + k, 102.0 + k, 99.0 - k % 3, 100.0 + (k * 7) % 11, 5.0 + k % 4, 3, 180, 60 * (k % 4)) for k in range(n) if k not in drop]
    return rows, spark.createDataFrame(rows, "open_time long, close_time long, open double, high double, low double, close double, volume double, src_count long, coverage_seconds long, traded_seconds long")


def test_phased_lookback_and_indicators(spark):
    rows, df = _window_frame(spark, 60, drop={17})
    by_time = {r[1]: r for r in rows}
    ph = phased_lookback(df, window="3m", emit_every="2m", lookback=4, anchor=f"{T0 % 120}s", min_traded_seconds=0)
    got = {r["close_time"]: r for r in ph.frame.collect()}
    assert set(got) == set(range(T0, T0 + 60 * 59 + 1, 120)) and ph.effective_history == Duration(720)
    for t, r in got.items():
        past = [by_time.get(t - 180 * k) for k in range(4)]
        assert r["close"] == ([p[5] for p in past] if all(past) else None)
    p = 3
    formulas = {
        CutlersRSI(): lambda h, low, c, v: 50.0 if (m := sum(abs(a - b) for a, b in zip(c, c[1:]))) == 0 else 100 * sum(max(a - b, 0) for a, b in zip(c, c[1:])) / m,
        RelativeRange(): lambda h, low, c, v: sum(max(h[k], c[k + 1]) - min(low[k], c[k + 1]) for k in range(p)) / p / c[0],
        LogVolumeRatio(): lambda h, low, c, v: math.log(v[0] / statistics.median(v[1:])),
    }
    for primitive, formula in formulas.items():
        out = add_indicator(ph, primitive, period=p)
        for r in out.collect():
            value = r[f"{primitive.name}_p3_w3m"]
            assert value is None if r["close"] is None else math.isclose(value, formula(r["high"], r["low"], r["close"], r["volume"]), rel_tol=1e-12)
    assert add_indicator(ph, PriceToMovingAverage(), period=4).columns[-1] == "mapos_p4_w3m"
    with pytest.raises(ConfigError):
        add_indicator(ph, CutlersRSI(), period=5)
    zero = phased_lookback(df.replace(5.0, 0.0, ["volume"]), window="3m", emit_every="2m", lookback=4, anchor=f"{T0 % 120}s")
    with pytest.raises(DataValidationError):
        add_indicator(zero, LogVolumeRatio(), period=3)


def test_phased_refusals(spark):
    _, df = _window_frame(spark, 10)
    for more in ({"window": "4m"}, {"emit_every": "90s"}, {"lookback": 0}, {"lookback": 513}, {"anchor": "1s"}):
        with pytest.raises(ConfigError):
            phased_lookback(df, **({"window": "3m", "emit_every": "2m", "lookback": 2, "anchor": f"{T0 % 60}s"} | more))
    with pytest.raises(ConfigError):
        phased_lookback(df.unionByName(df), window="3m", emit_every="2m", lookback=2, anchor=f"{T0 % 60}s")


def test_excursions_over_many_blocks_are_those_of_each_interval(spark):
    import math
    import random

    from candlespark.operators.returns import ReturnMethod, add_forward_excursions

    rng = random.Random(31)
    rows = []
    for k in range(-70, 260):
        low = rng.uniform(50, 90)
        high = rng.choice([low + rng.random()] * 40 + [None, float("nan")])
        rows.append((60 * k, high, low, rng.uniform(60, 80), f"row {k}"))
    df = spark.createDataFrame(rows, "close_time long, high double, low double, close double, note string").repartition(5)
    for minutes in (1, 7, 60, 1000):
        got = {r["close_time"]: r for r in add_forward_excursions(df, horizon=f"{minutes}m", cadence="1m", method=ReturnMethod.SIMPLE).collect()}
        assert len(got) == len(rows)
        for i, (t, _, _, close, note) in enumerate(rows):
            after = rows[i + 1 : i + 1 + minutes]
            whole = len(after) == minutes and all(r[1] is not None and not math.isnan(r[1]) for r in after)
            want = ((max(r[1] for r in after) - close) / close, (min(r[2] for r in after) - close) / close) if whole else (None, None)
            r = got[t]
            name = next(c for c in r.asDict() if c.startswith("forward_mfe")), next(c for c in r.asDict() if c.startswith("forward_mae"))
            assert (r[name[0]], r[name[1]]) == want and r["note"] == note


def test_both_returns_at_once_are_each_of_them(spark):
    import random

    from candlespark.operators.returns import ReturnMethod, add_backward_returns, add_forward_returns, add_returns

    rng = random.Random(61)
    rows = [(60 * k, rng.choice([None, 0.0, *[rng.uniform(1, 9)] * 9]), k) for k in range(-300, 900) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "close_time long, close double, note long").repartition(4)
    close = {t: c for t, c, _ in rows}
    for h in (1, 7, 500):
        both = add_returns(df, horizon=f"{h}m", cadence="1m", method=ReturnMethod.SIMPLE)
        one = add_forward_returns(add_backward_returns(df, horizon=f"{h}m", cadence="1m", method=ReturnMethod.SIMPLE), horizon=f"{h}m", cadence="1m", method=ReturnMethod.SIMPLE)
        assert both.columns == one.columns and sorted(map(str, both.collect())) == sorted(map(str, one.collect()))
        ratio = lambda n, d: None if n is None or not d else (n - d) / d
        want = sorted((t, c, k, ratio(c, close.get(t - 60 * h)), ratio(close.get(t + 60 * h), c), t + 60 * h) for t, c, k in rows)
        assert sorted(map(tuple, both.collect()), key=lambda r: r[0]) == want


def test_annotations_are_those_of_every_interval(spark, monkeypatch):
    import random

    from candlespark.operators import annotations

    rng = random.Random(91)
    windows = [(t, t + rng.choice([1, 60, 900, 50_000])) for t in (rng.randrange(-5000, 60_000) for _ in range(300))]
    df = spark.createDataFrame(windows, "open_time long, close_time long").repartition(3)
    for n, flags in ((1, 1), (40, 3), (300, 5)):
        spans = [(s, s + rng.choice([1, 7, 300, 4000])) for s in (rng.randrange(0, 50_000) for _ in range(n))]
        rows = [(s, e, f"f{rng.randrange(flags)}") for s, e in spans]
        side = spark.createDataFrame(rows, "start_timestamp long, end_timestamp long, flag string")
        covered = sorted({x for s, e in spans for x in range(s, e)})
        from bisect import bisect_left

        want = sorted((o, c, sorted({f for s, e, f in rows if o < e and c > s}), bisect_left(covered, c) - bisect_left(covered, o)) for o, c in windows)
        assert sorted(map(tuple, annotations.annotate_windows(df, side).collect())) == want
        with monkeypatch.context() as m:
            m.setattr(annotations, "MANY_FLAGS", 0)
            assert sorted(map(tuple, annotations.annotate_windows(df, side).collect())) == want


def test_steps_measured_in_one_aggregation_are_those_of_sorted_times(spark, monkeypatch):
    monkeypatch.setattr("candlespark.operators.phased.MONTH", 600)  # many buckets, some without a row
    rng = random.Random(5)
    _, plain = _window_frame(spark, 2)
    cases = [[0, 60, 120, 180], [0, 60, 180, 300, 420], [0, 60, 120, 240, 300], [0, 120, 300, 420], [0, 60, 60], [0, 3600, 7200], [0, 120, 240, 300]]
    cases += [sorted(rng.sample(range(0, 6000, 60), rng.randrange(2, 70))) for _ in range(8)]
    for times in cases:
        rows = [(T0 + 60 * t - 60 * 3600, T0 + 60 * t, *([1.0] * 5), 1, 60, 60) for t in times]
        steps = [60 * (b - a) for a, b in zip(times, times[1:])]
        usual = min(set(steps), key=lambda x: (-steps.count(x), x))
        right = min(steps) > 0 and not any(x % usual for x in steps)
        make = lambda: resolve_phased_grid(spark.createDataFrame(rows, plain.schema).repartition(3), window="60h", emit_every="60h", lookback=1, anchor=f"{(T0 + 60 * times[0]) % 216_000}s")  # noqa: E731, B023
        if right and 216_000 % usual == 0:
            assert make().cadence == usual, times
        else:
            with pytest.raises(ConfigError):
                make()
