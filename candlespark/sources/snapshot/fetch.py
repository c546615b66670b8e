"""Fetching and re-verifying snapshots on disk. Driver-side: a release is a few files."""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
import urllib.request
from collections.abc import Mapping
from dataclasses import dataclass
from enum import Enum
from pathlib import Path
from types import MappingProxyType
from typing import Protocol

from candlespark.errors import ConfigError, DataValidationError, bounded_echo
from candlespark.sources.snapshot.manifest import MANIFEST_NAME, MAX_MANIFEST_BYTES, AssetRecord, SnapshotManifest, SnapshotManifestError, SnapshotRelease, parse_manifest


class SnapshotIntegrityError(DataValidationError):
    """Bytes differ from what the manifest, or the caller, states."""


class AssetTransport(Protocol):
    """Bring the bytes at ``url`` to ``dest``; more than ``max_bytes`` is an error."""

    def download(self, url: str, dest: Path, *, max_bytes: int) -> None: ...


def _copy(source, dest: Path, max_bytes: int) -> None:
    with dest.open("wb") as out:
        left = max_bytes
        while block := source.read(min(1 << 20, left + 1)):
            left -= len(block)
            if left < 0:
                raise SnapshotIntegrityError(f"more than {max_bytes} bytes arrived for {dest.name}")
            out.write(block)


class HttpAssetTransport:
    """HTTP(S) with a time limit and a hard byte cap."""

    def __init__(self, timeout: float = 60.0):
        self.timeout = timeout

    def download(self, url: str, dest: Path, *, max_bytes: int) -> None:
        with urllib.request.urlopen(url, timeout=self.timeout) as source:  # noqa: S310  the scheme is checked by SnapshotRelease
            _copy(source, dest, max_bytes)


class LocalAssetTransport:
    """A release that lies in a folder: the last part of the URL is the file."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def download(self, url: str, dest: Path, *, max_bytes: int) -> None:
        with (self.folder / url.rsplit("/", 1)[-1]).open("rb") as source:
            _copy(source, dest, max_bytes)


class ExistingAssetPolicy(Enum):
    REFUSE = "refuse"
    REPLACE = "replace"


@dataclass(frozen=True)
class FetchedAsset:
    record: AssetRecord
    path: Path
    reused: bool


@dataclass(frozen=True)
class SnapshotFetchResult:
    release: SnapshotRelease
    manifest: SnapshotManifest
    manifest_sha256: str
    assets: Mapping[str, FetchedAsset]


def _digest(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _matches(path: Path, record: AssetRecord) -> bool:
    return path.stat().st_size == record.size and _digest(path) == record.sha256


def _part(folder: Path, name: str) -> Path:
    handle, path = tempfile.mkstemp(prefix=f"{name}.", suffix=".part", dir=folder)
    os.close(handle)
    return Path(path)


def fetch_snapshot(release: SnapshotRelease, directory: str | Path, *, transport: AssetTransport | None = None, existing: ExistingAssetPolicy = ExistingAssetPolicy.REFUSE, expected_manifest_sha256: str | None = None) -> SnapshotFetchResult:
    """Download what is missing; each file appears under its name only after size and digest match.

    The manifest is always fetched anew. A present file with the stated digest is reused; one
    with another is refused or replaced, as the policy says. Files fetched before a failure stay.
    """
    if not isinstance(existing, ExistingAssetPolicy):
        raise ConfigError("existing must be an ExistingAssetPolicy")
    transport = transport or HttpAssetTransport()
    folder = Path(directory)
    if folder.exists() and not folder.is_dir():
        raise ConfigError(f"{folder} is no directory")
    folder.mkdir(parents=True, exist_ok=True)
    part = _part(folder, MANIFEST_NAME)
    try:
        transport.download(release.asset_url(MANIFEST_NAME), part, max_bytes=MAX_MANIFEST_BYTES)
        raw = part.read_bytes()
        identity = hashlib.sha256(raw).hexdigest()
        if expected_manifest_sha256 is not None and identity != expected_manifest_sha256:
            raise SnapshotIntegrityError(f"the manifest's digest is {identity}, not {bounded_echo(expected_manifest_sha256)}")
        manifest = parse_manifest(raw)
        if manifest.tag != release.tag:
            raise SnapshotIntegrityError(f"the manifest is of {manifest.tag}, not of {release.tag}")
        os.replace(part, folder / MANIFEST_NAME)
    finally:
        part.unlink(missing_ok=True)
    assets = {name: _bring(release, folder, record, transport, existing) for name, record in manifest.assets.items()}
    return SnapshotFetchResult(release, manifest, identity, MappingProxyType(assets))


def _bring(release: SnapshotRelease, folder: Path, record: AssetRecord, transport: AssetTransport, existing: ExistingAssetPolicy) -> FetchedAsset:
    path = folder / record.name
    if path.exists():
        if path.is_file() and _matches(path, record):
            return FetchedAsset(record, path, True)
        if existing is ExistingAssetPolicy.REFUSE or not path.is_file():
            raise SnapshotIntegrityError(f"{path} exists and is not the stated asset")
    if shutil.disk_usage(folder).free < record.size:
        raise OSError(f"no room for the {record.size} bytes of {record.name}")
    part = _part(folder, record.name)
    try:
        transport.download(release.asset_url(record.name), part, max_bytes=record.size)
        _require(part, record)
        os.replace(part, path)
    finally:
        part.unlink(missing_ok=True)
    return FetchedAsset(record, path, False)


def _require(path: Path, record: AssetRecord) -> None:
    if path.stat().st_size != record.size:
        raise SnapshotIntegrityError(f"{record.name} has {path.stat().st_size} bytes, the manifest states {record.size}")
    if (found := _digest(path)) != record.sha256:
        raise SnapshotIntegrityError(f"{record.name} has digest {found}, the manifest states {record.sha256}")


def verify_snapshot_on_disk(directory: str | Path, *, repository: str, host: str = "https://github.com") -> SnapshotFetchResult:
    """Check a folder against its own manifest, without any network: presence, size and digest of every asset."""
    folder = Path(directory)
    path = folder / MANIFEST_NAME
    if not path.is_file():
        raise SnapshotIntegrityError(f"{folder} has no manifest")
    if path.stat().st_size > MAX_MANIFEST_BYTES:
        raise SnapshotManifestError(f"the manifest has over {MAX_MANIFEST_BYTES} bytes")
    raw = path.read_bytes()
    manifest = parse_manifest(raw)
    release = SnapshotRelease(repository, manifest.tag, host)
    assets = {}
    for name, record in manifest.assets.items():
        if not (folder / name).is_file():
            raise SnapshotIntegrityError(f"asset {name} is missing")
        _require(folder / name, record)
        assets[name] = FetchedAsset(record, folder / name, True)
    return SnapshotFetchResult(release, manifest, hashlib.sha256(raw).hexdigest(), MappingProxyType(assets))
