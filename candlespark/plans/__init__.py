"""Schedules: parameters of window ladders, lookbacks, horizons and emit cadences, named by their content."""

from candlespark.plans.schedules import (
    CadenceRule,
    HorizonSchedule,
    LookbackSchedule,
    WindowSchedule,
    explicit,
    explicit_horizons,
    explicit_lookback,
    explicit_pairs,
    log_spaced,
    log_spaced_horizons,
    log_spaced_lookback,
    metallic_horizons,
    metallic_lookback,
    metallic_recurrence,
    named_schedule,
    named_schedule_names,
    w_over_k,
)

__all__ = [
    "CadenceRule", "HorizonSchedule", "LookbackSchedule", "WindowSchedule", "explicit", "explicit_horizons", "explicit_lookback", "explicit_pairs",
    "log_spaced", "log_spaced_horizons", "log_spaced_lookback", "metallic_horizons", "metallic_lookback", "metallic_recurrence", "named_schedule", "named_schedule_names", "w_over_k",
]
