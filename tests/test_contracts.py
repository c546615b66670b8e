"""Refusals and records: the error that each case ends with, or what it gives."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlespark.catalog import DAY0, queries
from candlespark.columns import ROW, require_absent, require_types
from candlespark.duration import Duration, coerce_duration, validate_cadence, validate_horizon_duration
from candlespark.errors import bounded_echo, enum_member
from candlespark.logs import get_logger
from candlespark.operators import annotations as notes
from candlespark.operators.grid import ExplicitRange, resolve_schedule
from candlespark.operators.indicators import CutlersRSI, FeatureIdentity, LogVolumeRatio, NormalizationClass, add_indicator, effective_history, effective_n
from candlespark.operators.phased import phased_lookback
from candlespark.operators.quality import QualityMode, WindowQualityPolicy, apply_quality_policy
from candlespark.operators.returns import ReturnMethod, add_backward_returns, add_forward_excursions, require_total_grid
from candlespark.operators.windows import compute_windows
from candlespark.plans import CadenceRule, HorizonSchedule, LookbackSchedule, WindowSchedule, explicit, explicit_horizons, explicit_lookback, explicit_pairs, log_spaced, named_schedule
from candlespark.operators.quality import GateMode
from candlespark.sources.profile import BITSTAMP_BTCUSD_1M, ColumnKind, SourceProfile, candle_profile
from candlespark.sources.reader import read_annotations, read_source_csv, scratch_folder
from candlespark.sources.snapshot import AssetRecord, SnapshotManifest, SnapshotRelease, parse_manifest
from candlespark.sources.validation import ValidationMode, validate_source_frame
from tests.oracle import windows

_COLUMNS = "timestamp long, open double, high double, low double, close double, volume double"
CASES = {}


def _cases(name, expected):
    def keep(f):
        CASES[name] = f, expected
        return f

    return keep


def _text(spark: SparkSession, text: str) -> str:
    """The path of a new file with these bytes."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_folder(spark)}/text.csv")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(text.encode()))
    out.close()
    return path.toString()


def _outcomes(spark: SparkSession, cases: dict[str, object]) -> dict[str, str]:
    """By case: the name of the error that a case ends with, or what it gives."""
    found = []
    for name, case in cases.items():
        try:
            found.append((name, str(case())))
        except Exception as e:  # the outcome is the error
            found.append((name, type(e).__name__))
    return dict(found)


def _manifest(**more) -> bytes:
    asset = {"candles.csv": {"bytes": 3, "sha256": hashlib.sha256(b"abc").hexdigest()}}
    return json.dumps({"schema_version": 1, "tag": "v1", "as_of": "2026-01-01T00:00:00+00:00", "first_timestamp": 0, "last_timestamp": 120, "row_count": 3, "generation_revision": "r", "assets": asset} | more).encode()


@_cases("source_refusals", {
    "no file": "FileNotFoundError", "empty file": "NoDataError", "header only": "0", "bad number": "refused", "row cap": "ConfigError", "column missing": "SourceValidationError", "wrong kind": "schema:1",
    "null timestamp": "null_values", "decreasing": "non_increasing_timestamps", "profile without timestamp": "ConfigError", "phase beyond cadence": "ConfigError", "profile without volume": "ConfigError", "names differ in case": "ConfigError",
})
def _source_refusals(spark):
    header = "timestamp,open,high,low,close,volume\n"
    make = lambda rows: spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], f"{_COLUMNS}, {ROW} long")
    report = lambda df: validate_source_frame(df, BITSTAMP_BTCUSD_1M, mode=ValidationMode.REPORT)
    row = (DAY0, 1.0, 2.0, 0.5, 1.5, 1.0)
    whole = {"timestamp": ColumnKind.INTEGER, "open": ColumnKind.FLOATING}

    def bad_number() -> str:
        try:
            return str(read_source_csv(spark, _text(spark, header + "1,x,2,0.5,1.5,1\n"), BITSTAMP_BTCUSD_1M).collect())
        except Exception:  # of the CSV parser
            return "refused"

    profile = lambda **more: SourceProfile.create(**{"name": "p", "timestamp_column": "timestamp", "raw_schema": whole, "cadence": "1m"} | more)
    return _outcomes(spark, {
        "no file": lambda: read_source_csv(spark, f"{scratch_folder(spark)}/none.csv", BITSTAMP_BTCUSD_1M),
        "empty file": lambda: read_source_csv(spark, _text(spark, ""), BITSTAMP_BTCUSD_1M),
        "header only": lambda: read_source_csv(spark, _text(spark, header), BITSTAMP_BTCUSD_1M).count(),
        "bad number": bad_number,
        "row cap": lambda: read_source_csv(spark, "x.csv", BITSTAMP_BTCUSD_1M, max_rows=-1),
        "column missing": lambda: validate_source_frame(make([row]).drop("low"), BITSTAMP_BTCUSD_1M),
        "wrong kind": lambda: "{}:{}".format(*next((f.kind.value, f.count) for f in report(make([row]).withColumn("low", F.lit("x"))).findings)),
        "null timestamp": lambda: report(make([(None, *row[1:])])).findings[0].kind.value,
        "decreasing": lambda: report(make([row, (DAY0 - 60, *row[1:])])).findings[0].kind.value,
        "profile without timestamp": lambda: profile(timestamp_column="when"),
        "phase beyond cadence": lambda: profile(phase=60),
        "profile without volume": lambda: compute_windows(make([row]), profile(), window="1m", emit_every="1m"),
        "names differ in case": lambda: profile(raw_schema=whole | {"Open": ColumnKind.FLOATING}),
    })


@_cases("annotation_refusals", {"null": "AnnotationValidationError", "reversed": "AnnotationValidationError", "empty file": "AnnotationValidationError", "too many": "AnnotationValidationError", "type": "ConfigError", "same names": "ConfigError", "taken": "ConfigError", "none": "0"})
def _annotation_refusals(spark):
    make = lambda rows: spark.createDataFrame(rows, "start_timestamp long, end_timestamp long, flag string")
    windows = spark.createDataFrame([(0, 60)], "open_time long, close_time long")
    return _outcomes(spark, {
        "null": lambda: notes.annotate_windows(windows, make([(1, 2, None)])),
        "reversed": lambda: notes.annotate_windows(windows, make([(2, 2, "x")])),
        "empty file": lambda: read_annotations(spark, _text(spark, "")),
        "too many": lambda: read_annotations(spark, _text(spark, "start_timestamp,end_timestamp,flag\n1,2,a\n3,4,b\n"), max_rows=1),
        "type": lambda: notes.annotate_windows(windows, make([]).withColumn("flag", F.lit(1))),
        "same names": lambda: notes.AnnotationColumns("a", "A", "f"),
        "taken": lambda: notes.annotate_windows(windows.withColumn("annotation_flags", F.lit(1)), make([])),
        "none": lambda: notes.annotate_windows(windows, make([])).first()["annotation_overlap_seconds"],
    })


@_cases("snapshot_records", {
    "manifest": "v1 3 rows, 1 asset", "digest": hashlib.sha256(b"abc").hexdigest(), "address": "owner/name v1", "bad version": "SnapshotManifestError", "naive time": "SnapshotManifestError", "no assets": "SnapshotManifestError",
    "path as name": "SnapshotManifestError", "not json": "SnapshotManifestError", "too long": "SnapshotManifestError", "bad repository": "ConfigError",
})
def _snapshot_records(spark):
    read = lambda **more: parse_manifest(_manifest(**more))

    def shown() -> str:
        m: SnapshotManifest = read()
        return f"{m.tag} {m.row_count} rows, {len(m.assets)} asset"

    def digest() -> str:
        assets = read().assets
        record: AssetRecord = assets["candles.csv"] if isinstance(assets, dict) or hasattr(assets, "keys") else assets[0]
        return record.sha256

    release = lambda: SnapshotRelease("owner/name", "v1")
    return _outcomes(spark, {
        "manifest": shown, "digest": digest, "address": lambda: f"{release().repository} {release().tag}",
        "bad version": lambda: read(schema_version=2), "naive time": lambda: read(as_of="2026-01-01"), "no assets": lambda: read(assets={}),
        "path as name": lambda: read(assets={"../x": {"bytes": 1, "sha256": "0" * 64}}), "not json": lambda: parse_manifest(b"{"), "too long": lambda: parse_manifest(b" " * (2 << 20)),
        "bad repository": lambda: SnapshotRelease("../b", "v1"),
    })


@_cases("quality_records", {
    "record": '{"gate_mode": "strict", "min_coverage": 0.75, "min_traded_seconds": 900, "mode": "filter"}', "round trip": "True", "old record": "0", "strict gate": "WindowCoverageError", "share": "ConfigError", "seconds": "ConfigError",
    "unknown mode": "ConfigError", "extra key": "ConfigError", "nine columns": "ConfigError", "window as number": "ConfigError",
})
def _quality_records(spark):
    policy = WindowQualityPolicy(QualityMode.FILTER, min_coverage=0.75, min_traded_seconds=900)
    frame = spark.createDataFrame([(60, 0, 0)], "close_time long, coverage_seconds long, traded_seconds long")
    gate = WindowQualityPolicy(QualityMode.GATE)
    return _outcomes(spark, {
        "record": lambda: json.dumps(policy.to_dict(), sort_keys=True),
        "round trip": lambda: WindowQualityPolicy.from_dict(policy.to_dict()) == policy,
        "old record": lambda: WindowQualityPolicy.from_dict({k: v for k, v in policy.to_dict().items() if k != "min_traded_seconds"}).min_traded_seconds,
        "strict gate": lambda: apply_quality_policy(frame, gate, window="1m"),
        "share": lambda: WindowQualityPolicy(QualityMode.GATE, min_coverage=1.5),
        "seconds": lambda: WindowQualityPolicy(QualityMode.GATE, min_traded_seconds=True),
        "unknown mode": lambda: WindowQualityPolicy.from_dict(policy.to_dict() | {"mode": "drop"}),
        "extra key": lambda: WindowQualityPolicy.from_dict(policy.to_dict() | {"x": 1}),
        "nine columns": lambda: apply_quality_policy(frame.drop("traded_seconds"), gate, window="1m"),
        "window as number": lambda: apply_quality_policy(frame, gate, window=60),
    })


@_cases("frame_refusals", {
    "name taken": "ConfigError", "name taken in another case": "ConfigError", "type": "ConfigError", "close time repeats": "ConfigError", "close time null": "ConfigError", "hole in the grid": "ConfigError", "rows out of order": "ConfigError", "total grid": "None",
    "horizon off cadence": "ConfigError", "window under cadence": "ConfigError", "anchor off grid": "ConfigError", "range reversed": "ConfigError", "nothing full": "ConfigError", "off the grid": "ConfigError", "one row": "ConfigError", "excursion over a hole": "ConfigError",
})
def _frame_refusals(spark):
    closes = lambda *t: spark.createDataFrame([(x, 1.0, 1.0, 1.0) for x in t], "close_time long, close double, high double, low double")
    numbered = lambda *t: spark.createDataFrame([(x, 1.0, k) for k, x in enumerate(t)], f"close_time long, close double, {ROW} long")
    back = lambda df, h="1m": add_backward_returns(df, horizon=h, cadence="1m", method=ReturnMethod.SIMPLE)
    candles = spark.createDataFrame([(DAY0, 1.0, 1.0, 1.0, 1.0, 1.0), (DAY0 + 90, 1.0, 1.0, 1.0, 1.0, 1.0)], _COLUMNS)
    minute = candle_profile("m", "1m")
    run = lambda **more: compute_windows(candles, minute, **{"window": "4m", "emit_every": "1m", "materialization": ExplicitRange(DAY0, DAY0 + 600)} | more)
    windows = spark.createDataFrame([(0, 60, *[1.0] * 5, 1, 60, 60)], "open_time long, close_time long, open double, high double, low double, close double, volume double, src_count long, coverage_seconds long, traded_seconds long")
    return _outcomes(spark, {
        "name taken": lambda: require_absent(closes(1), ["close"]), "name taken in another case": lambda: require_absent(closes(1), ["CLOSE"]), "type": lambda: require_types(closes(1), {"close": candles.schema["timestamp"].dataType}),
        "close time repeats": lambda: back(closes(60, 60)), "close time null": lambda: back(closes(60, None)), "hole in the grid": lambda: require_total_grid(closes(60, 180), 60),
        "rows out of order": lambda: require_total_grid(numbered(120, 60), 60), "total grid": lambda: require_total_grid(numbered(60, 120), 60), "horizon off cadence": lambda: back(closes(60), "90s"),
        "window under cadence": lambda: run(window="30s"), "anchor off grid": lambda: run(anchor="30s"), "range reversed": lambda: ExplicitRange(2, 1),
        "nothing full": lambda: run(materialization="skip_warmup"), "off the grid": lambda: run(plan="sweep"), "one row": lambda: phased_lookback(windows, window="1m", emit_every="1m", lookback=1),
        "excursion over a hole": lambda: add_forward_excursions(closes(60, 180), horizon="1m", cadence="1m", method=ReturnMethod.SIMPLE),
    })


@_cases("indicator_records", {
    "name": "rsi_p14_w21m", "parsed": "rsi p 14 1260", "spelling": "ConfigError", "history": "4h", "history n": "6", "lookback": "ConfigError", "volume not positive": "DataValidationError", "period": "ConfigError",
})
def _indicator_records(spark):
    from candlespark.operators.indicators import indicator_identity

    frame = spark.createDataFrame([(60 * k, 60 * k + 60, *[1.0] * 4, 0.0, 1, 60, 60) for k in range(6)], "open_time long, close_time long, open double, high double, low double, close double, volume double, src_count long, coverage_seconds long, traded_seconds long")
    phased = lambda n: phased_lookback(frame, window="1m", emit_every="1m", lookback=n)

    def parsed() -> str:
        x = FeatureIdentity.parse("rsi_p14_w21m", normalization=list(NormalizationClass)[0])
        return f"{x.indicator} {x.family.value} {x.period} {x.window.total_seconds}"

    return _outcomes(spark, {
        "name": lambda: indicator_identity(CutlersRSI(), period=14, window="21m").column_name, "parsed": parsed,
        "spelling": lambda: FeatureIdentity.parse("rsi_p14_w60s", normalization=list(NormalizationClass)[0]),
        "history": lambda: effective_history(4, "1h"), "history n": lambda: effective_n("1d", "1h", 4),
        "lookback": lambda: add_indicator(phased(2), CutlersRSI(), period=14), "volume not positive": lambda: add_indicator(phased(LogVolumeRatio().lookback(2)), LogVolumeRatio(), period=2), "period": lambda: CutlersRSI().lookback(0) and add_indicator(phased(1), CutlersRSI(), period=0),
    })


@_cases("schedule_records", {
    "explicit": "60|300", "explicit round trip": "True", "horizons": "HorizonSchedule 3600", "lookbacks": "3|5", "pairs": "3600:900", "pairs round trip": "True", "id has 64 digits": "True", "repeats": "ConfigError", "tampered": "ConfigError", "other kind": "False",
})
def _schedule_records(spark):
    windows, horizons, periods = explicit(["1m", "5m"], name="mine"), explicit_horizons(["1h"]), explicit_lookback([3, 5])
    pairs = explicit_pairs([("1h", "15m")], name="p")
    joined = lambda s: "|".join(map(str, s.members))

    def tampered() -> object:
        record = windows.to_dict()
        key = next(k for k, v in record.items() if isinstance(v, list))
        return WindowSchedule.from_dict(record | {key: ["1m", "6m"]})

    return _outcomes(spark, {
        "explicit": lambda: joined(windows), "explicit round trip": lambda: WindowSchedule.from_dict(windows.to_dict()) == windows,
        "horizons": lambda: f"{type(horizons).__name__} {joined(HorizonSchedule.from_dict(horizons.to_dict()))}", "lookbacks": lambda: joined(LookbackSchedule.from_dict(periods.to_dict())),
        "pairs": lambda: "|".join(f"{p.window.total_seconds}:{p.emit_every.total_seconds}" for p in pairs.pairs), "pairs round trip": lambda: CadenceRule.from_dict(pairs.to_dict()) == pairs,
        "id has 64 digits": lambda: len(windows.schedule_id) == 64, "repeats": lambda: explicit(["1m", "60s"]), "tampered": tampered, "other kind": lambda: explicit(["1h"]) == horizons,
    })


@_cases("durations_and_errors", {
    "parse": "9000", "spell": "2h30m", "number": "ConfigError", "order": "ConfigError", "cadence": "ConfigError", "horizon": "14400", "echo is bounded": "True", "enum": "QualityMode.GATE", "enum unknown": "ConfigError", "canonical": '{"a":1,"b":[2]}', "logger": "candlespark.x", "log spaced": "900|2700|9000|27900|86400", "ticks": "3",
})
def _durations(spark):
    from candlespark.plans.schedules import canonical_json

    return _outcomes(spark, {
        "parse": lambda: Duration.parse("2h30m").total_seconds, "spell": lambda: Duration(9000), "number": lambda: coerce_duration(60), "order": lambda: Duration.parse("1m1h"), "cadence": lambda: validate_cadence("0s"),
        "horizon": lambda: validate_horizon_duration("4h").total_seconds, "echo is bounded": lambda: len(bounded_echo("x" * 1000)) < 120, "enum": lambda: enum_member(QualityMode, "gate", "mode"), "enum unknown": lambda: enum_member(QualityMode, "x", "mode"),
        "canonical": lambda: canonical_json({"b": [2], "a": 1}), "logger": lambda: get_logger("candlespark.x").name,
        "log spaced": lambda: "|".join(map(str, log_spaced(count=5, minimum="15m", maximum="1d", grain="15m").members)), "ticks": lambda: resolve_schedule(candle_profile("m", "1m"), window="2m", emit_every="2m").count_ticks(1, 361),
    })


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    make, expected = CASES[name]
    assert make(spark) == expected


def test_a_published_ladder():
    assert [m // 60 for m in named_schedule("metallic-legacy-2025").members] == [1, 3, 7, 18, 47, 122, 318, 829, 2163, 5643, 14_723]


def test_findings_and_their_samples(spark):
    spoilt = [
        (DAY0, 1.0, 2.0, 0.5, 1.5, 1.0), (DAY0 + 60, None, 2.0, 0.5, 1.5, None), (DAY0 + 120, 1.0, float("inf"), 0.5, float("nan"), 1.0),
        (DAY0 + 150, 1.0, 2.0, 0.5, 1.5, 1.0), (DAY0 + 300, 1.0, 2.0, 0.5, 1.5, 1.0), (DAY0 + 510, 1.0, 2.0, 0.5, 1.5, 1.0), (DAY0 + 690, 1.0, 2.0, 0.5, 1.5, 1.0),
    ]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(spoilt)], f"{_COLUMNS}, {ROW} long")
    found = validate_source_frame(df, BITSTAMP_BTCUSD_1M, mode=ValidationMode.REPORT).findings
    assert [(f.kind.value, f.count, [t - DAY0 for t in f.sample_timestamps]) for f in found] == [
        ("null_values", 2, []), ("non_finite_values", 2, []), ("off_phase", 3, [150, 510, 690]), ("overlapping_intervals", 1, [150]), ("irregular_interval", 2, [300, 510]), ("gap", 2, [570, 690]),
    ]


def test_a_reporting_gate_gives_every_window_and_its_counts(spark, tmp_path):
    slots = [(day * 96 + k, k % 3 > 0) for day in (0, 3, 29) for k in (0, 1, 2, 3, 4, 9, 40)]  # quarters of an hour with an event, whether it is a purchase
    events = [(n, DAY0 + 900 * k + n, 10.0 + n * 7 % 5, "purchase" if bought else "view") for n, (k, bought) in enumerate(slots)]
    df = spark.createDataFrame(events, "event_id long, s long, value double, event_type string")
    df.select("event_id", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, s)").alias("ts"), "value", "event_type").write.parquet(str(tmp_path / "events.parquet"))
    expected = windows([(s - s % 900, v, v, v, v, float(kind == "purchase")) for _, s, v, kind in events], 900, 3600, 900, 0, DAY0, DAY0 + 31 * 86_400)
    low, idle = {t for _, t, *_, covered, _ in expected if covered < 2700}, {t for _, t, *_, traded in expected if traded < 900}
    counts = {
        "rows": len(expected), "min_coverage_seconds": 2700, "min_traded_seconds": 900, "below_either": len(low | idle), "below_coverage": len(low), "below_traded": len(idle),
        "null_coverage": 0, "null_traded": 0, "first_offending_close_time": min(low | idle),
    }
    assert 0 < len(low - idle) and 0 < len(expected) - len(low | idle)
    out = queries()["quality_gate_report"](spark, str(tmp_path))
    names = ["open_time", "close_time", "open", "high", "low", "close", "volume", "src_count", "coverage_seconds", "traded_seconds"]
    assert out.columns == names + list(counts)
    assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == [(*row, *counts.values()) for row in expected]
