"""Validation of raw candle frames: findings as data, nothing repaired.

All counts come from one scan of the source and one shuffle; samples are fetched only for checks that
failed. Row order is the reader's ``__row`` column; a frame without it is taken in the order of
its timestamps, where only repeats can be seen as non-increasing.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlespark.columns import ROW
from candlespark.errors import ConfigError, DataValidationError, bounded_echo
from candlespark.logs import get_logger
from candlespark.sources.profile import ColumnKind, SourceProfile

logger = get_logger(__name__)
SAMPLES, MAX_GAPS = 20, 1000
#: Rows that one task orders: numbered rows are cut into stretches of so many.
STRETCH_ROWS = 1_000_000
#: Flags of a row that one number holds.
FLAG_BITS = 60


class ValidationMode(Enum):
    STRICT = "strict"
    REPORT = "report"


class FindingKind(Enum):
    SCHEMA = "schema"
    NULL_VALUES = "null_values"
    NON_FINITE_VALUES = "non_finite_values"
    OFF_PHASE = "off_phase"
    NON_INCREASING_TIMESTAMPS = "non_increasing_timestamps"
    OVERLAPPING_INTERVALS = "overlapping_intervals"
    IRREGULAR_INTERVAL = "irregular_interval"
    GAP = "gap"


@dataclass(frozen=True)
class Finding:
    kind: FindingKind
    message: str
    count: int
    sample_timestamps: tuple[int, ...] = ()


@dataclass(frozen=True)
class ValidationReport:
    rows: int
    findings: tuple[Finding, ...]

    @property
    def passed(self) -> bool:
        return not self.findings


class SourceValidationError(DataValidationError):
    """Strict validation found something; ``report`` has it all."""

    def __init__(self, message: str, report: ValidationReport):
        super().__init__(message)
        self.report = report


def _in_stretches(df: DataFrame, profile: SourceProfile, *more: Column) -> DataFrame:
    """ts, ord, and the stretch ``b`` of rows that one task orders, with ``more``."""
    ts = F.col(profile.timestamp_column).cast("long")
    numbered = ROW in df.columns
    order = F.col(ROW) if numbered else ts
    width = STRETCH_ROWS if numbered else STRETCH_ROWS * profile.cadence.total_seconds
    return df.select(ts.alias("ts"), order.alias("ord"), F.floor(order / F.lit(width)).alias("b"), *more)


def with_previous(df: DataFrame, profile: SourceProfile) -> DataFrame:
    """ts, order, and ``diff`` to the previous row (null for the first).

    The order is cut into stretches that are compared within, and each stretch's last row is
    carried to the next, so no task orders the whole source.
    """
    rows = _in_stretches(df, profile)
    inside = Window.partitionBy("b").orderBy("ord", "ts")
    last = rows.groupBy("b").agg(F.max_by("ts", F.struct("ord", "ts")).alias("last"))  # a row for each stretch
    carried = last.select("b", F.lag("last").over(Window.orderBy("b")).alias("carried"))
    lagged = rows.withColumn("prev", F.lag("ts").over(inside)).withColumn("rank", F.row_number().over(inside))
    joined = lagged.join(carried, "b")
    previous = F.when(F.col("rank") == 1, F.col("carried")).otherwise(F.col("prev"))
    return joined.select("ts", "ord", (F.col("ts") - previous).alias("diff"))


def find_gaps(df: DataFrame, profile: SourceProfile) -> DataFrame:
    """expected_start, next_open, missing_count for every run of missing candles between two that are a whole number of cadences apart."""
    d = F.lit(profile.cadence.total_seconds).cast("long")
    steps = with_previous(df, profile).where((F.col("diff") > d) & (F.pmod("diff", d) == 0))
    return steps.select((F.col("ts") - F.col("diff") + d).alias("expected_start"), F.col("ts").alias("next_open"), (F.expr(f"diff div {profile.cadence.total_seconds}") - 1).cast("long").alias("missing_count"))


def _step_checks(d: int) -> dict[FindingKind, Column]:
    diff = F.col("diff")
    return {
        FindingKind.NON_INCREASING_TIMESTAMPS: diff <= 0,
        FindingKind.OVERLAPPING_INTERVALS: (diff > 0) & (diff < d),
        FindingKind.IRREGULAR_INTERVAL: (diff > d) & (F.pmod(diff, F.lit(d)) != 0),
        FindingKind.GAP: (diff > d) & (F.pmod(diff, F.lit(d)) == 0),
    }


def _summary(df: DataFrame, profile: SourceProfile, flags: dict[str, Column]) -> DataFrame:
    """One row: ``rows``, the rows of each check by its name, and those of each flag. The source is read once.

    Flags travel as bits of a number beside time and order, in one shuffle. A stretch is counted within, and the step
    into it from its first time and the last one of the stretch before: a row for each stretch.
    """
    d = profile.cadence.total_seconds
    at = {f: (f"m{k // FLAG_BITS}", 1 << k % FLAG_BITS) for k, f in enumerate(flags)}
    masks: dict[str, Column] = {}
    for f, (name, bit) in at.items():
        masks[name] = masks.get(name, F.lit(0).cast("long")) + F.when(flags[f], F.lit(bit)).otherwise(F.lit(0)).cast("long")
    order = Window.partitionBy("b").orderBy("ord", "ts")
    rows = _in_stretches(df, profile, *(m.alias(name) for name, m in masks.items()))
    rows = rows.withColumns({"diff": F.col("ts") - F.lag("ts").over(order), "rank": F.row_number().over(order)})
    steps, off = _step_checks(d), F.pmod(F.col("ts"), F.lit(d)) != profile.phase_seconds
    counts = {FindingKind.OFF_PHASE.value: off} | {k.value: c for k, c in steps.items()} | {f: F.col(name).bitwiseAND(F.lit(bit)) != 0 for f, (name, bit) in at.items()}
    ends = F.min_by("ts", "rank").alias("first"), F.max_by("ts", "rank").alias("last")
    stretches = rows.groupBy("b").agg(F.count("*").alias("rows"), *ends, *(F.count_if(c).alias(n) for n, c in counts.items()))
    seams = stretches.withColumn("diff", F.col("first") - F.lag("last").over(Window.orderBy("b")))
    here = {k.value: F.count_if(c) for k, c in steps.items()}
    return seams.agg(*((F.coalesce(F.sum(n), F.lit(0)) + here.get(n, F.lit(0))).alias(n) for n in ("rows", *counts)))


def validation_counts(df: DataFrame, profile: SourceProfile) -> DataFrame:
    """(kind, count) for each check of rows, zeros included; gaps count missing candles' runs. One scan, no samples."""
    kinds = (FindingKind.OFF_PHASE, *_step_checks(1))
    one = _summary(df, profile, {})
    return one.select(F.explode(F.array(*(F.struct(F.lit(k.value).alias("kind"), F.col(k.value).alias("count")) for k in kinds))).alias("x")).select("x.kind", "x.count")


def validate_source_frame(df: DataFrame, profile: SourceProfile, *, mode: ValidationMode = ValidationMode.STRICT) -> ValidationReport:
    """Schema, nulls, non-finite values, phase, order, overlap, irregular steps, gaps, in this order.

    Rows are checked only where the timestamp column is usable: present, of its kind, without nulls.
    """
    if not isinstance(mode, ValidationMode):
        raise ConfigError(f"mode must be a ValidationMode, got {type(mode).__name__}")
    findings: list[Finding] = []
    types = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in profile.raw_schema if c not in types]
    wrong = [c for c, k in profile.raw_schema.items() if c in types and not k.matches(types[c])]
    if missing or wrong:
        parts = [f"missing {[bounded_echo(c) for c in missing]}"] * bool(missing) + [f"wrong kind {[f'{bounded_echo(c)}: {types[c].simpleString()}' for c in wrong]}"] * bool(wrong)
        findings.append(Finding(FindingKind.SCHEMA, "; ".join(parts), len(missing) + len(wrong)))
    present = [c for c in profile.raw_schema if c in types]
    floating = [c for c in present if profile.raw_schema[c] is ColumnKind.FLOATING and ColumnKind.FLOATING.matches(types[c])]
    flags = {f"n{k}": F.col(f"`{c}`").isNull() for k, c in enumerate(present)}
    flags |= {f"f{k}": F.isnan(f"`{c}`") | (F.abs(f"`{c}`") == F.lit(float("inf"))) for k, c in enumerate(floating)}
    stamp = profile.timestamp_column
    usable = stamp in types and stamp not in wrong
    counted = _summary(df, profile, flags) if usable else df.agg(F.count("*").alias("rows"), *(F.count_if(c).alias(n) for n, c in flags.items()))
    row = counted.first()
    nulls = {c: row[f"n{k}"] for k, c in enumerate(present) if row[f"n{k}"]}
    if nulls:
        findings.append(Finding(FindingKind.NULL_VALUES, f"null cells by column: {nulls}", sum(nulls.values())))
    odds = {c: row[f"f{k}"] for k, c in enumerate(floating) if row[f"f{k}"]}
    if odds:
        findings.append(Finding(FindingKind.NON_FINITE_VALUES, f"NaN or infinite cells by column: {odds}", sum(odds.values())))
    if usable and not nulls.get(stamp) and row["rows"]:
        findings += _row_findings(df, profile, row.asDict())
    report = ValidationReport(row["rows"], tuple(findings))
    if findings and mode is ValidationMode.STRICT:
        raise SourceValidationError("; ".join(f.message for f in findings), report)
    return report


def _row_findings(df: DataFrame, profile: SourceProfile, counts: dict[str, int]) -> list[Finding]:
    d, p = profile.cadence.total_seconds, profile.phase_seconds
    steps = with_previous(df, profile)
    sample = lambda c: tuple(r[0] for r in steps.where(c).orderBy("ord").select("ts").limit(SAMPLES).collect())
    checks, found = _step_checks(d), []
    if n := counts["off_phase"]:
        found.append(Finding(FindingKind.OFF_PHASE, f"{n} timestamps are not {p} modulo {d}", n, sample(F.pmod(F.col("ts"), F.lit(d)) != p)))
    kind = FindingKind.NON_INCREASING_TIMESTAMPS
    if n := counts[kind.value]:
        return [*found, Finding(kind, f"{n} timestamps do not follow the row before", n, sample(checks[kind]))]
    for kind, text in ((FindingKind.OVERLAPPING_INTERVALS, "begin before the candle before them ends"), (FindingKind.IRREGULAR_INTERVAL, f"are no whole number of {d}s after the candle before")):
        if n := counts[kind.value]:
            found.append(Finding(kind, f"{n} candles {text}", n, sample(checks[kind])))
    if n := counts["gap"]:
        if n > MAX_GAPS:
            logger.warning("%d gaps; the first %d are reported", n, MAX_GAPS)
        for r in find_gaps(df, profile).orderBy("next_open").limit(MAX_GAPS).collect():
            found.append(Finding(FindingKind.GAP, f"{r['missing_count']} missing candle(s) expected in [{r['expected_start']}, {r['next_open']})", r["missing_count"], (r["expected_start"], r["next_open"])))
    return found
