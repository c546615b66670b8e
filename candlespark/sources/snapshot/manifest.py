"""Release coordinates and the strict manifest reader."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime
from types import MappingProxyType
from typing import Any

from candlespark.errors import ConfigError, DataValidationError, bounded_echo

MANIFEST_NAME = "manifest.json"
MAX_MANIFEST_BYTES = 1 << 20
_WORD = "[A-Za-z0-9][A-Za-z0-9._-]*"
_REPOSITORY, _TAG, _HOST, _ASSET = (re.compile(p) for p in (f"{_WORD}/{_WORD}", "[A-Za-z0-9][A-Za-z0-9._+-]*", "https?://[A-Za-z0-9][A-Za-z0-9.:-]*", _WORD))
_DIGEST = re.compile("[0-9a-f]{64}")


class SnapshotManifestError(DataValidationError):
    """The manifest is not what its schema says."""


def is_plain_asset_name(name: object) -> bool:
    """A name that is safe as a file name and in a URL."""
    return isinstance(name, str) and _ASSET.fullmatch(name) is not None


@dataclass(frozen=True)
class SnapshotRelease:
    """An immutable release: repository, tag and host. Odd characters are refused, not escaped."""

    repository: str
    tag: str
    host: str = "https://github.com"

    def __post_init__(self) -> None:
        for label, pattern in (("repository", _REPOSITORY), ("tag", _TAG), ("host", _HOST)):
            value = getattr(self, label)
            if not isinstance(value, str) or not pattern.fullmatch(value) or ".." in value:
                raise ConfigError(f"{label} is malformed: {bounded_echo(value)}")

    def asset_url(self, name: str) -> str:
        if not is_plain_asset_name(name):
            raise ConfigError(f"no plain asset name: {bounded_echo(name)}")
        return f"{self.host}/{self.repository}/releases/download/{self.tag}/{name}"


@dataclass(frozen=True)
class AssetRecord:
    name: str
    size: int
    sha256: str


@dataclass(frozen=True)
class SnapshotManifest:
    tag: str
    as_of: datetime
    first_timestamp: int
    last_timestamp: int
    row_count: int
    generation_revision: str
    assets: Mapping[str, AssetRecord]


def _field(data: Mapping[str, Any], key: str, kind: type, least: int | None = None) -> Any:
    if key not in data:
        raise SnapshotManifestError(f"the manifest lacks {key}")
    value = data[key]
    if not isinstance(value, kind) or isinstance(value, bool):
        raise SnapshotManifestError(f"{key} must be {kind.__name__}, got {type(value).__name__}")
    if least is not None and value < least:
        raise SnapshotManifestError(f"{key} must be at least {least}, got {value}")
    if kind is str and not value:
        raise SnapshotManifestError(f"{key} is empty")
    return value


def parse_manifest(raw: bytes) -> SnapshotManifest:
    """Read a manifest of schema version 1; whatever is missing, mistyped or oversized is refused."""
    if len(raw) > MAX_MANIFEST_BYTES:
        raise SnapshotManifestError(f"the manifest has {len(raw)} bytes, over {MAX_MANIFEST_BYTES}")
    try:
        data = json.loads(raw)
    except (ValueError, RecursionError) as e:
        raise SnapshotManifestError(f"the manifest is no JSON: {bounded_echo(str(e))}") from None
    if not isinstance(data, dict):
        raise SnapshotManifestError("the manifest is no object")
    if _field(data, "schema_version", int) != 1:
        raise SnapshotManifestError(f"unknown schema version {bounded_echo(data['schema_version'])}")
    try:
        as_of = datetime.fromisoformat(_field(data, "as_of", str))
    except ValueError:
        raise SnapshotManifestError(f"as_of is no instant: {bounded_echo(data['as_of'])}") from None
    if as_of.tzinfo is None:
        raise SnapshotManifestError("as_of has no offset")
    first, last = _field(data, "first_timestamp", int), _field(data, "last_timestamp", int)
    if last < first:
        raise SnapshotManifestError("last_timestamp is before first_timestamp")
    assets = {}
    for name, entry in _field(data, "assets", dict).items():
        if not is_plain_asset_name(name) or name == MANIFEST_NAME:
            raise SnapshotManifestError(f"unusable asset name {bounded_echo(name)}")
        if not isinstance(entry, dict) or not _DIGEST.fullmatch(_field(entry, "sha256", str)):
            raise SnapshotManifestError(f"asset {name} has no hex digest")
        assets[name] = AssetRecord(name, _field(entry, "bytes", int, 0), entry["sha256"])
    if not assets:
        raise SnapshotManifestError("the manifest names no assets")
    tag = _field(data, "tag", str)
    if not _TAG.fullmatch(tag):
        raise SnapshotManifestError(f"malformed tag {bounded_echo(tag)}")
    return SnapshotManifest(tag, as_of, first, last, _field(data, "row_count", int, 0), _field(data, "generation_revision", str), MappingProxyType(assets))
