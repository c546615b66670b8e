"""Verified release snapshots: a manifest names assets by size and digest, and nothing unverified is read."""

from candlespark.sources.snapshot.continuity import ContinuityReport, SeamKind, SeamMismatch, SnapshotContinuityError, read_snapshot_frame, verify_snapshot_continuity
from candlespark.sources.snapshot.fetch import (
    AssetTransport,
    ExistingAssetPolicy,
    FetchedAsset,
    HttpAssetTransport,
    LocalAssetTransport,
    SnapshotFetchResult,
    SnapshotIntegrityError,
    fetch_snapshot,
    verify_snapshot_on_disk,
)
from candlespark.sources.snapshot.manifest import AssetRecord, SnapshotManifest, SnapshotManifestError, SnapshotRelease, is_plain_asset_name, parse_manifest

__all__ = [
    "AssetRecord", "AssetTransport", "ContinuityReport", "ExistingAssetPolicy", "FetchedAsset", "HttpAssetTransport", "LocalAssetTransport", "SeamKind", "SeamMismatch",
    "SnapshotContinuityError", "SnapshotFetchResult", "SnapshotIntegrityError", "SnapshotManifest", "SnapshotManifestError", "SnapshotRelease",
    "fetch_snapshot", "is_plain_asset_name", "parse_manifest", "read_snapshot_frame", "verify_snapshot_continuity", "verify_snapshot_on_disk",
]
