"""Continuity of a snapshot's frame with its manifest: span, row count, first and last row."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlespark.columns import ROW
from candlespark.errors import ConfigError, DataValidationError, bounded_echo
from candlespark.sources.profile import BITSTAMP_BTCUSD_1M, SourceProfile
from candlespark.sources.reader import read_source_csv
from candlespark.sources.snapshot.fetch import SnapshotFetchResult
from candlespark.sources.snapshot.manifest import SnapshotManifest
from candlespark.sources.validation import ValidationMode, ValidationReport, validate_source_frame


class SeamKind(Enum):
    MANIFEST_SPAN = "manifest_span"
    ROW_COUNT = "row_count"
    FIRST_TIMESTAMP = "first_timestamp"
    LAST_TIMESTAMP = "last_timestamp"


@dataclass(frozen=True)
class SeamMismatch:
    kind: SeamKind
    expected: int
    found: int | None


@dataclass(frozen=True)
class ContinuityReport:
    validation: ValidationReport
    mismatches: tuple[SeamMismatch, ...]

    @property
    def passed(self) -> bool:
        return self.validation.passed and not self.mismatches


class SnapshotContinuityError(DataValidationError):
    """The frame is not the gap-free history that the manifest states; ``report`` has what differs."""

    def __init__(self, message: str, report: ContinuityReport):
        super().__init__(message)
        self.report = report


def continuity_report(df: DataFrame, manifest: SnapshotManifest, profile: SourceProfile = BITSTAMP_BTCUSD_1M, validation: ValidationReport | None = None) -> ContinuityReport:
    """First and last are those of the first and last row, not the least and greatest."""
    validation = validation or validate_source_frame(df, profile, mode=ValidationMode.REPORT)
    found: list[SeamMismatch] = []
    d = profile.cadence.total_seconds
    stated = (manifest.last_timestamp - manifest.first_timestamp) // d + 1
    if stated != manifest.row_count or (manifest.last_timestamp - manifest.first_timestamp) % d:
        found.append(SeamMismatch(SeamKind.MANIFEST_SPAN, stated, manifest.row_count))
    stamp = profile.timestamp_column
    if stamp in df.columns:
        order = F.col(ROW) if ROW in df.columns else F.col(stamp)
        row = df.agg(F.count("*").alias("n"), F.min_by(stamp, order).alias("first"), F.max_by(stamp, order).alias("last")).first()
        for kind, expected, value in ((SeamKind.ROW_COUNT, manifest.row_count, row["n"]), (SeamKind.FIRST_TIMESTAMP, manifest.first_timestamp, row["first"]), (SeamKind.LAST_TIMESTAMP, manifest.last_timestamp, row["last"])):
            if value != expected:
                found.append(SeamMismatch(kind, expected, value))
    return ContinuityReport(validation, tuple(found))


def verify_snapshot_continuity(df: DataFrame, manifest: SnapshotManifest, *, profile: SourceProfile = BITSTAMP_BTCUSD_1M, validation: ValidationReport | None = None) -> ContinuityReport:
    """As :func:`continuity_report`, raising unless it passes."""
    report = continuity_report(df, manifest, profile, validation)
    if not report.passed:
        parts = [f"{m.kind.value}: expected {m.expected}, found {m.found}" for m in report.mismatches] + [f.message for f in report.validation.findings]
        raise SnapshotContinuityError("; ".join(parts), report)
    return report


def read_snapshot_frame(spark: SparkSession, result: SnapshotFetchResult, *, asset_name: str, profile: SourceProfile = BITSTAMP_BTCUSD_1M) -> DataFrame:
    """Read a verified CSV asset; at most one row more than stated, so an overlong file is seen and not read whole."""
    if asset_name not in result.assets:
        raise ConfigError(f"no asset {bounded_echo(asset_name)}; there are {sorted(result.assets)[:20]}")
    read = read_source_csv(spark, result.assets[asset_name].path, profile, mode=ValidationMode.REPORT, max_rows=result.manifest.row_count + 1)
    verify_snapshot_continuity(read.frame, result.manifest, profile=profile, validation=read.report)
    return read.frame
