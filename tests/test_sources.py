from __future__ import annotations

import gzip
import hashlib
import json
import math
import random

import pytest

from candlespark.columns import ROW
from candlespark.errors import ConfigError
from candlespark.operators.annotations import AnnotationValidationError
from candlespark.sources.profile import BITSTAMP_BTCUSD_1M
from candlespark.sources.reader import NoDataError, read_annotations, read_source_csv
from candlespark.sources.snapshot import (
    ExistingAssetPolicy,
    LocalAssetTransport,
    SnapshotContinuityError,
    SnapshotIntegrityError,
    SnapshotManifestError,
    SnapshotRelease,
    fetch_snapshot,
    parse_manifest,
    read_snapshot_frame,
    verify_snapshot_on_disk,
)
from candlespark.sources.validation import FindingKind, SourceValidationError, ValidationMode, find_gaps, validate_source_frame
from candlespark.streaming import stream_windows

T0 = 1_786_924_800
HEADER = "timestamp,open,high,low,close,volume\n"


def _csv(times, extra=""):
    return HEADER + "".join(f"{t},1.0,2.0,0.5,1.5,{k}.0{extra}\n" for k, t in enumerate(times))


def test_read_keeps_order_and_reports(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text(_csv([T0, T0 + 60, T0 + 120]))
    df = read_source_csv(spark, good, BITSTAMP_BTCUSD_1M)
    assert [r["timestamp"] for r in df.orderBy(ROW).collect()] == [T0, T0 + 60, T0 + 120]
    hidden = tmp_path / "packed.csv"  # gzip by content, not by name
    hidden.write_bytes(gzip.compress(good.read_bytes()))
    assert read_source_csv(spark, hidden, BITSTAMP_BTCUSD_1M, max_rows=2).count() == 2
    mixed = tmp_path / "mixed.csv"
    mixed.write_text("volume,timestamp,close,low,high,open,note\n1.0,%d,1.5,0.5,2.0,1.0,x\n" % T0)
    assert read_source_csv(spark, mixed, BITSTAMP_BTCUSD_1M).first()["volume"] == 1.0
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    with pytest.raises(NoDataError):
        read_source_csv(spark, empty, BITSTAMP_BTCUSD_1M)
    with pytest.raises(FileNotFoundError):
        read_source_csv(spark, tmp_path / "none.csv", BITSTAMP_BTCUSD_1M)
    with pytest.raises(ConfigError):
        read_source_csv(spark, good, BITSTAMP_BTCUSD_1M, max_rows=-1)


def test_capped_reads_keep_the_first_rows_and_extras_their_rare_values(spark, tmp_path):
    path = tmp_path / "many.csv"
    path.write_text(HEADER.rstrip() + ",note\n" + "".join(f"{T0 + 60 * k},1.0,2.0,0.5,1.5,{k}.0,{'rare' if k == 4321 else k}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        df = read_source_csv(spark, path, BITSTAMP_BTCUSD_1M)
        assert df.rdd.getNumPartitions() > 4 and df.where("note = 'rare'").count() == 1
        capped = read_source_csv(spark, path, BITSTAMP_BTCUSD_1M, max_rows=1234)
        assert sorted(r["timestamp"] for r in capped.collect()) == [T0 + 60 * k for k in range(1234)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_findings(spark):
    schema = f"timestamp long, open double, high double, low double, close double, volume double, {ROW} long"
    make = lambda times, v=1.0: spark.createDataFrame([(t, 1.0, 1.0, 1.0, 1.0, v, k) for k, t in enumerate(times)], schema)
    check = lambda df: validate_source_frame(df, BITSTAMP_BTCUSD_1M, mode=ValidationMode.REPORT)
    assert check(make([T0, T0 + 60])).passed
    gap = check(make([T0, T0 + 60, T0 + 180])).findings
    assert [(f.kind, f.count, f.sample_timestamps) for f in gap] == [(FindingKind.GAP, 1, (T0 + 120, T0 + 180))]
    kinds = lambda times, v=1.0: [f.kind for f in check(make(times, v)).findings]
    assert kinds([T0, T0]) == [FindingKind.NON_INCREASING_TIMESTAMPS]
    assert kinds([T0, T0 - 60]) == [FindingKind.NON_INCREASING_TIMESTAMPS]
    assert kinds([T0, T0 + 30]) == [FindingKind.OFF_PHASE, FindingKind.OVERLAPPING_INTERVALS]
    assert kinds([T0, T0 + 90]) == [FindingKind.OFF_PHASE, FindingKind.IRREGULAR_INTERVAL]
    assert kinds([T0], None) == [FindingKind.NULL_VALUES] and kinds([T0], float("nan")) == [FindingKind.NON_FINITE_VALUES]
    assert kinds([]) == []
    missing = check(make([T0]).drop("open").withColumnRenamed("low", "LOW2"))
    assert [f.kind for f in missing.findings] == [FindingKind.SCHEMA] and missing.findings[0].count == 2
    with pytest.raises(SourceValidationError) as e:
        validate_source_frame(make([T0, T0]), BITSTAMP_BTCUSD_1M)
    assert not e.value.report.passed
    assert [tuple(r) for r in find_gaps(make([T0, T0 + 240]), BITSTAMP_BTCUSD_1M).collect()] == [(T0 + 60, T0 + 240, 3)]


def test_order_across_stretches(spark, monkeypatch):
    from candlespark.sources import validation

    monkeypatch.setattr(validation, "STRETCH_ROWS", 2)
    schema = f"timestamp long, {ROW} long"
    times = [0, 60, 120, 240, 180, 300, 360]
    df = spark.createDataFrame(list(zip(times, range(7))), schema)
    got = [r["diff"] for r in validation.with_previous(df, BITSTAMP_BTCUSD_1M).orderBy("ord").collect()]
    assert got == [None, 60, 60, 120, -60, 120, 60]


def test_counts_of_one_scan_are_those_of_rows_in_order(spark, monkeypatch):
    from candlespark.sources import validation

    monkeypatch.setattr(validation, "STRETCH_ROWS", 3)
    monkeypatch.setattr(validation, "FLAG_BITS", 4)
    rng = random.Random(9)
    schema = f"timestamp long, open double, high double, low double, close double, volume double, {ROW} long"
    values = [1.0, 1.0, 1.0, 1.0, None, float("nan"), float("inf")]
    for width in (1, 60):
        times, rows = [], []
        for k in range(40):
            times.append((times[-1] if times else T0) + rng.choice([60, 60, 60, 120, width, -60, 0, 90]))
            rows.append((times[-1], *(rng.choice(values) for _ in range(5)), k + 5 * (k > 20)))
        steps = [b - a for a, b in zip(times, times[1:])]
        df = spark.createDataFrame(rows, schema).repartition(4)
        counts = {r["kind"]: r["count"] for r in validation.validation_counts(df, BITSTAMP_BTCUSD_1M).collect()}
        assert counts == {
            "off_phase": sum(t % 60 != 0 for t in times), "non_increasing_timestamps": sum(s <= 0 for s in steps), "overlapping_intervals": sum(0 < s < 60 for s in steps),
            "irregular_interval": sum(s > 60 and s % 60 != 0 for s in steps), "gap": sum(s > 60 and s % 60 == 0 for s in steps),
        }
        report = validate_source_frame(df, BITSTAMP_BTCUSD_1M, mode=ValidationMode.REPORT)
        cells = [v for r in rows for v in r[1:6]]
        odd = sum(v is not None and not math.isfinite(v) for v in cells)
        assert report.rows == 40 and [(f.kind, f.count) for f in report.findings[:2]] == [(FindingKind.NULL_VALUES, cells.count(None)), (FindingKind.NON_FINITE_VALUES, odd)]


def test_sidecar(spark, tmp_path):
    path = tmp_path / "side.csv"
    path.write_text("start_timestamp,end_timestamp,flag,note\n1,5,a,x\n7,9,b,y\n")
    assert read_annotations(spark, path).count() == 2
    with pytest.raises(AnnotationValidationError):
        read_annotations(spark, path, max_rows=1)
    path.write_text("start_timestamp,end_timestamp,flag\n1,x,a\n")
    with pytest.raises(AnnotationValidationError):
        read_annotations(spark, path)


def _release(folder, times, **more):
    data = gzip.compress(_csv(times).encode())
    (folder / "c.csv.gz").write_bytes(data)
    manifest = {
        "schema_version": 1, "tag": "v1", "as_of": "2026-01-01T00:00:00+00:00", "first_timestamp": T0, "last_timestamp": T0 + 120, "row_count": 3, "generation_revision": "r",
        "assets": {"c.csv.gz": {"bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}},
    } | more
    (folder / "manifest.json").write_text(json.dumps(manifest))
    return manifest


def test_snapshot(spark, tmp_path):
    source, target = tmp_path / "s", tmp_path / "t"
    source.mkdir()
    _release(source, [T0, T0 + 60, T0 + 120])
    release = SnapshotRelease("owner/name", "v1")
    first = fetch_snapshot(release, target, transport=LocalAssetTransport(source))
    again = fetch_snapshot(release, target, transport=LocalAssetTransport(source), expected_manifest_sha256=first.manifest_sha256)
    assert not first.assets["c.csv.gz"].reused and again.assets["c.csv.gz"].reused
    assert read_snapshot_frame(spark, verify_snapshot_on_disk(target, repository="owner/name"), asset_name="c.csv.gz").count() == 3
    (target / "c.csv.gz").write_bytes(b"x")
    with pytest.raises(SnapshotIntegrityError):
        verify_snapshot_on_disk(target, repository="owner/name")
    with pytest.raises(SnapshotIntegrityError):
        fetch_snapshot(release, target, transport=LocalAssetTransport(source))
    fetch_snapshot(release, target, transport=LocalAssetTransport(source), existing=ExistingAssetPolicy.REPLACE)
    with pytest.raises(SnapshotIntegrityError):
        fetch_snapshot(release, target, transport=LocalAssetTransport(source), expected_manifest_sha256="0" * 64)
    _release(source, [T0, T0 + 60, T0 + 120, T0 + 180])
    fetched = fetch_snapshot(release, tmp_path / "u", transport=LocalAssetTransport(source))
    with pytest.raises(SnapshotContinuityError) as e:
        read_snapshot_frame(spark, fetched, asset_name="c.csv.gz")
    assert {m.kind.value for m in e.value.report.mismatches} == {"row_count", "last_timestamp"}
    assert not list((tmp_path / "u").glob("*.part"))


def test_manifest_refusals(tmp_path):
    good = _release(tmp_path, [T0])
    for change in ({"schema_version": 2}, {"schema_version": True}, {"as_of": "2026-01-01"}, {"row_count": "3"}, {"assets": {}}, {"assets": {"../x": {"bytes": 1, "sha256": "0" * 64}}}, {"assets": {"manifest.json": {"bytes": 1, "sha256": "0" * 64}}}):
        with pytest.raises(SnapshotManifestError):
            parse_manifest(json.dumps(good | change).encode())
    with pytest.raises(SnapshotManifestError):
        parse_manifest(b" " * (2 << 20))
    for bad in ("x", "a/b/c", "../b"):
        with pytest.raises(ConfigError):
            SnapshotRelease(bad, "v1")


def test_stream(spark, tmp_path):
    from candlespark.sources.profile import candle_profile

    folder = tmp_path / "in"
    rows = [(60 * k, 1.0 + k, 2.0 + k, 0.5, 1.5 + k, float(k)) for k in range(30)]
    spark.createDataFrame(rows, "timestamp long, open double, high double, low double, close double, volume double").write.parquet(str(folder))
    profile = candle_profile("s", "1m")
    batch = spark.read.parquet(str(folder))
    stream = spark.readStream.schema(batch.schema).parquet(str(folder))
    query = stream_windows(stream, profile, window="5m", emit_every="1m").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("w").collect()))
    assert got == sorted(map(tuple, stream_windows(batch, profile, window="5m", emit_every="1m").collect())) and len(got) == 34
