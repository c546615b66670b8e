from __future__ import annotations

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from candlespark.duration import Duration, coerce_duration
from candlespark.errors import ConfigError, bounded_echo
from candlespark.operators.grid import ExplicitRange, ResolvedSchedule, coerce_materialization, resolve_schedule
from candlespark.operators.indicators import FeatureFamily, FeatureIdentity, NormalizationClass, effective_history, effective_n
from candlespark.plans import (
    CadenceRule,
    HorizonSchedule,
    LookbackSchedule,
    WindowSchedule,
    explicit,
    explicit_lookback,
    explicit_pairs,
    log_spaced,
    metallic_horizons,
    metallic_lookback,
    metallic_recurrence,
    named_schedule,
    w_over_k,
)
from candlespark.sources.profile import candle_profile

RATIO = math.sqrt(math.e + math.sqrt(5))


@given(st.integers(0, 10**12))
def test_duration_round_trip(n):
    assert Duration.parse(str(Duration(n))).total_seconds == n


@pytest.mark.parametrize("text", ["", "1", "h", "1h1h", "1m1h", "-1h", "1 h", "1H", "١h", "1.5h"])
def test_duration_refuses(text):
    with pytest.raises(ConfigError):
        Duration.parse(text)


def test_bare_numbers_are_no_durations():
    with pytest.raises(ConfigError):
        coerce_duration(60)
    with pytest.raises(ConfigError):
        Duration(True)
    assert len(bounded_echo("x" * 1000)) < 120


@given(st.integers(-10**6, 10**6), st.integers(1, 5000), st.integers(0, 5000), st.integers(0, 10**4))
def test_tick_arithmetic(bound, e, a, width):
    s = ResolvedSchedule(e, e, a % e, 1, 0)
    grid = [t for t in range(bound, bound + width) if (t - s.anchor) % e == 0]
    assert s.count_ticks(bound, bound + width) == len(grid)
    assert s.first_tick_at_or_after(bound) >= bound > s.first_tick_at_or_after(bound) - e
    assert s.last_tick_at_or_before(bound) <= bound < s.last_tick_at_or_before(bound) + e


def test_schedule_refusals():
    p = candle_profile("x", "1m")
    for w, e, a in (("30s", "1m", "0s"), ("1m", "30s", "0s"), ("90s", "1m", "0s"), ("2m", "90s", "0s"), ("2m", "1m", "30s")):
        with pytest.raises(ConfigError):
            resolve_schedule(p, window=w, emit_every=e, anchor=a)
    with pytest.raises(ConfigError):
        ExplicitRange(5, 4)
    with pytest.raises(ConfigError):
        coerce_materialization("everything")


def test_published_identities():
    assert log_spaced(count=5, minimum="15m", maximum="1d", grain="15m").schedule_id == "0abc992caafb27a7ce8ba1ba5edca1118366b9ec84190744e2a641c0972d3e07"
    lookback = metallic_lookback(coefficient=RATIO, seed=1, grain=1, minimum=3, maximum=21)
    assert lookback.periods == (3, 8, 21)
    assert lookback.schedule_id == "2b7c4fa642bfd96d9727e10ea28438ffcbb7756b9a5809e8e57a56339cc9b0b4"


def test_schedules_round_trip_and_differ_by_kind():
    ladder = {"coefficient": RATIO, "seed": "1m", "grain": "1m", "minimum": "2h26m", "maximum": "16h33m"}
    w, h = metallic_recurrence(**ladder), metallic_horizons(**ladder)
    assert [str(x) for x in h.horizons] == ["2h26m", "6h20m", "16h33m"] and w.members == h.members and w.schedule_id != h.schedule_id
    assert WindowSchedule.from_dict(w.to_dict()) == w and HorizonSchedule.from_dict(h.to_dict()) == h
    with pytest.raises(ConfigError):
        HorizonSchedule.from_dict(w.to_dict())
    with pytest.raises(ConfigError):
        WindowSchedule.from_dict(w.to_dict() | {"schedule_id": "0" * 64})
    for s in (explicit(["1m", "5m"], name="two"), named_schedule("metallic-legacy-2025")):
        assert WindowSchedule.from_dict(s.to_dict()) == s
    assert LookbackSchedule.from_dict(explicit_lookback([5, 3]).to_dict()).periods == (5, 3)
    with pytest.raises(ConfigError):
        explicit(["1m", "60s"])


def test_cadences():
    rule = w_over_k(["1m", "2h", "1d"], divisor=8, allowed=["1h", "1m", "15m"], source_cadence="1m")
    assert [str(p.emit_every) for p in rule.pairs] == ["1m", "15m", "1h"]
    assert CadenceRule.from_dict(rule.to_dict()) == rule
    pairs = explicit_pairs([("1h", "5m")], name="one")
    assert CadenceRule.from_dict(pairs.to_dict()) == pairs
    with pytest.raises(ConfigError):
        w_over_k(["1h"], divisor=4, allowed=["1m"], source_cadence="5m")


def test_feature_identity():
    f = FeatureIdentity("rsi", FeatureFamily.PHASED, 14, Duration.parse("2h26m"), NormalizationClass.BOUNDED_BY_CONSTRUCTION)
    assert f.column_name == "rsi_p14_w2h26m" and FeatureIdentity.parse(f.column_name, normalization=f.normalization) == f
    for bad in ("rsi", "rsi_x14_w1m", "rsi_p0_w1m", "rsi_p14_w60s", "rsi_p014_w1m", "close_time_p1_w1m"):
        with pytest.raises(ConfigError):
            FeatureIdentity.parse(bad, normalization=f.normalization)
    assert effective_history(15, "1h") == Duration(15 * 3600) and effective_n("10d", "1h", 24) == 10
