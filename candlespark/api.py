"""Every public name of the candle engine in one place."""

from candlespark.adapters import candles_from_events, candles_from_orders
from candlespark.duration import Duration, coerce_duration, validate_cadence, validate_horizon_duration, validate_window_duration
from candlespark.errors import ConfigError, CoverageError, DataValidationError, bounded_echo
from candlespark.functions import add_calendar_columns, day_of_week, second_of_day, second_of_week
from candlespark.logs import get_logger
from candlespark.operators.annotations import AnnotationColumns, AnnotationValidationError, annotate_windows, merge_intervals
from candlespark.operators.grid import ExplicitRange, MaterializationRule, ResolvedSchedule, coerce_materialization, resolve_schedule
from candlespark.operators.indicators import (
    CutlersRSI,
    FeatureFamily,
    FeatureIdentity,
    IndicatorPrimitive,
    LogVolumeRatio,
    NormalizationClass,
    PriceToMovingAverage,
    RelativeRange,
    add_indicator,
    effective_history,
    effective_n,
    has_missing_input,
    indicator_identity,
    require_phased_inputs,
)
from candlespark.operators.phased import PhasedGrid, PhasedLookback, phased_lookback, resolve_phased_grid
from candlespark.operators.quality import GateMode, QualityMode, QualityPolicyResult, QualityReport, WindowCoverageError, WindowQualityPolicy, apply_quality_policy, filter_windows, quality_report
from candlespark.operators.reference import compute_reference_windows, phased_lookback_reference
from candlespark.operators.returns import (
    ReturnMethod,
    add_backward_returns,
    add_forward_excursions,
    add_forward_returns,
    add_returns,
    backward_return_column,
    forward_available_at_column,
    forward_excursion_available_at_column,
    forward_mae_column,
    forward_mfe_column,
    forward_return_column,
    resolve_horizon,
)
from candlespark.operators.windows import compute_ladder, compute_windows
from candlespark.plans import *  # noqa: F403
from candlespark.plans import __all__ as _plans
from candlespark.sources.profile import BITSTAMP_BTCUSD_1M, Availability, ColumnKind, SourceProfile, candle_profile, require_source_columns
from candlespark.sources.reader import NoDataError, SourceReadResult, read_annotations, read_source_csv
from candlespark.sources.snapshot import *  # noqa: F403
from candlespark.sources.snapshot import __all__ as _snapshot
from candlespark.sources.validation import Finding, FindingKind, SourceValidationError, ValidationMode, ValidationReport, find_gaps, validate_source_frame, validation_counts
from candlespark.streaming import stream_windows

__all__ = sorted([*_plans, *_snapshot, *(n for n, v in list(globals().items()) if not n.startswith("_") and getattr(v, "__module__", "").startswith("candlespark")), "BITSTAMP_BTCUSD_1M"])
