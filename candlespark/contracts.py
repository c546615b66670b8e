"""Queries over readers, sidecars, snapshots, schedules and specification forms: what the engine promises beside its frames.

Those that read files write them first, to the folder that all machines share.
"""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlespark import catalog
from candlespark.adapters import epoch_seconds
from candlespark.catalog import DAY0, PRICES, RANGE, WINDOW
from candlespark.columns import ROW
from candlespark.duration import Duration
from candlespark.operators import annotations as notes
from candlespark.operators.grid import resolve_schedule
from candlespark.operators.quality import GateMode, QualityMode, WindowQualityPolicy, apply_quality_policy
from candlespark.operators.reference import compute_reference_windows, phased_lookback_reference
from candlespark.operators.windows import compute_windows
from candlespark.plans import log_spaced, metallic_horizons, metallic_lookback, metallic_recurrence, w_over_k
from candlespark.sources.ordered import read_ascending, write_ascending
from candlespark.sources.profile import candle_profile
from candlespark.sources.reader import read_annotations, read_source_csv, scratch_folder
from candlespark.sources.snapshot import parse_manifest
from candlespark.sources.snapshot.continuity import continuity_report
from candlespark.sources.validation import FindingKind, SourceValidationError, ValidationMode, validate_source_frame

_query = catalog._query


def _csv(df: DataFrame, header: bool = True) -> str:
    """The path of one new CSV file of ``df``, which must be small."""
    folder = f"{scratch_folder(df.sparkSession)}/csv"
    df.coalesce(1).write.option("header", header).csv(folder)
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    where = jvm.org.apache.hadoop.fs.Path(folder)
    return next(str(s.getPath()) for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where) if s.getPath().getName().endswith(".csv"))


# --- readers and validation ----------------------------------------------------------------------

#: Every event as a candle at its own second, some of them spoilt: without a price, without end, no number, without volume.
_RAW = "SELECT event_id, epoch_us(ts) // 1000000 AS s, event_type, value FROM events"


def _raw_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind, value, nothing = F.col("event_type"), F.col("value"), F.lit(None).cast("double")
    return events.select(
        epoch_seconds(F.col("ts")).alias("timestamp"), F.when(kind == "error", nothing).otherwise(value).alias("open"), F.when(kind == "signup", F.lit(float("inf"))).otherwise(value).alias("high"),
        value.alias("low"), F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(value).alias("close"), F.when(kind == "view", nothing).otherwise(F.lit(1.0)).alias("volume"), F.col("event_id").alias(ROW),
    )


@_query("validation_findings", f"""WITH r AS ({_RAW}), z AS (SELECT *, s - lag(s) OVER (ORDER BY event_id) AS diff FROM r),
    k AS (SELECT 'null_values' AS kind, count(*) FILTER (WHERE event_type IN ('error', 'view')) AS count, NULL::BIGINT AS first, TRUE AS always FROM z
    UNION ALL SELECT 'non_finite_values', count(*) FILTER (WHERE event_type = 'signup') + count(*) FILTER (WHERE event_id % 97 = 0), NULL, TRUE FROM z
    UNION ALL SELECT 'off_phase', count(*) FILTER (WHERE s % 60 <> 0), arg_min(s, event_id) FILTER (WHERE s % 60 <> 0), TRUE FROM z
    UNION ALL SELECT 'non_increasing_timestamps', count(*) FILTER (WHERE diff <= 0), arg_min(s, event_id) FILTER (WHERE diff <= 0), TRUE FROM z
    UNION ALL SELECT 'overlapping_intervals', count(*) FILTER (WHERE diff > 0 AND diff < 60), arg_min(s, event_id) FILTER (WHERE diff > 0 AND diff < 60), FALSE FROM z
    UNION ALL SELECT 'irregular_interval', count(*) FILTER (WHERE diff > 60 AND diff % 60 <> 0), arg_min(s, event_id) FILTER (WHERE diff > 60 AND diff % 60 <> 0), FALSE FROM z)
    SELECT kind, count, first FROM k WHERE count > 0 AND (always OR NOT EXISTS (SELECT 1 FROM z WHERE diff <= 0))""")  # fmt: skip
def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate_source_frame(_raw_candles(spark, sf_dir), candle_profile("raw events", "1m"), mode=ValidationMode.REPORT).findings
    rows = [(f.kind.value, f.count, f.sample_timestamps[0] if f.sample_timestamps else None) for f in found if f.kind is not FindingKind.GAP]
    return spark.createDataFrame(rows, "kind string, count long, first long")


@_query("validation_refusals", f"""WITH r AS ({_RAW}), z AS (SELECT *, s - lag(s) OVER (PARTITION BY event_type ORDER BY event_id) AS diff FROM r)
    SELECT event_type, count(*) AS rows, (count(*) FILTER (WHERE event_type IN ('error', 'view')) > 0)::INT + 1 + (count(*) FILTER (WHERE s % 60 <> 0) > 0)::INT + (count(*) FILTER (WHERE diff <= 0) > 0)::INT AS kinds
    FROM z GROUP BY event_type""")  # fmt: skip
def _refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict validation of each event type's candles: what it refuses them for. Kinds of steps are left out where time runs back."""
    candles, profile = _raw_candles(spark, sf_dir), candle_profile("raw events", "1m")
    kinds = [r[0] for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct().collect()]  # five
    own = candles.join(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias(ROW), "event_type"), ROW)
    rows = []
    for kind in kinds:
        try:
            validate_source_frame(own.where(F.col("event_type") == kind).drop("event_type"), profile)
        except SourceValidationError as e:
            steps = (FindingKind.OVERLAPPING_INTERVALS, FindingKind.IRREGULAR_INTERVAL, FindingKind.GAP)
            rows.append((kind, e.report.rows, len({f.kind for f in e.report.findings} - set(steps))))
    return spark.createDataFrame(rows, "event_type string, rows long, kinds int")


@_query("read_source", f"WITH {catalog._candles_sql(900)} SELECT timestamp, {PRICES}, row_number() OVER (ORDER BY timestamp) - 1 AS position FROM c")
def _read_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    candles, profile = catalog._candles(spark, sf_dir, 900)
    path = _csv(candles.select("volume", "close", "timestamp", "low", "high", "open").orderBy("timestamp"))
    result = read_source_csv(spark, path, profile, mode=ValidationMode.REPORT)
    return result.frame.select("timestamp", "open", "high", "low", "close", "volume", F.col(ROW).alias("position"))


@_query("read_source_capped", f"WITH {catalog._candles_sql(900)} SELECT timestamp, {PRICES} FROM c ORDER BY timestamp LIMIT 1000")
def _read_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    candles, profile = catalog._candles(spark, sf_dir, 900)
    return read_source_csv(spark, _csv(candles.orderBy("timestamp")), profile, mode=ValidationMode.REPORT, max_rows=1000).frame.drop(ROW)


@_query("validation_gaps_reported", f"WITH {catalog._candles_sql(900)}, z AS (SELECT timestamp, timestamp - lag(timestamp) OVER (ORDER BY timestamp) AS diff FROM c), g AS (SELECT * FROM z WHERE diff > 900 ORDER BY timestamp LIMIT 1000) SELECT diff // 900 - 1 AS count, timestamp - diff + 900 AS first, timestamp AS next FROM g")
def _gaps_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    candles, profile = catalog._candles(spark, sf_dir, 900)
    found = validate_source_frame(candles, profile, mode=ValidationMode.REPORT).findings
    return spark.createDataFrame([(f.count, *f.sample_timestamps) for f in found], "count long, first long, next long")





@_query("interval_bounds", f"WITH {catalog._candles_sql(900)} SELECT timestamp AS open_time, timestamp + 900 AS close_time FROM c")
def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    candles, profile = catalog._candles(spark, sf_dir, 900)
    return profile.derive_interval_bounds(candles)


# --- annotations -----------------------------------------------------------------------------------


_ORDER_INTERVALS = "SELECT epoch_us(o_orderdate) // 1000000 + o_orderkey % 86400 AS s, epoch_us(o_orderdate) // 1000000 + o_orderkey % 86400 + 60 + o_custkey % 3000 AS e, o_orderpriority AS f FROM orders"


def _order_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as an interval of up to an hour on its day."""
    start = epoch_seconds(F.col("o_orderdate")) + F.col("o_orderkey") % 86_400
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(start.alias("start_timestamp"), (start + 60 + F.col("o_custkey") % 3000).alias("end_timestamp"), F.col("o_orderpriority").alias("flag"))


@_query("read_annotations", f"SELECT s AS start_timestamp, e AS end_timestamp, f AS flag FROM ({_ORDER_INTERVALS})")
def _read_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _csv(_order_intervals(spark, sf_dir).select(F.lit(1).alias("note"), "flag", "end_timestamp", "start_timestamp"))
    return read_annotations(spark, path).select("start_timestamp", "end_timestamp", "flag")


@_query("merge_intervals", f"WITH i AS ({_ORDER_INTERVALS}), {catalog._U} SELECT s AS start, e AS \"end\" FROM u")
def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.merge_intervals(_order_intervals(spark, sf_dir))


@_query("annotate_windows_joined", catalog.SQL["annotate_windows"])
def _annotate_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = catalog._windows(spark, sf_dir, 900, 3600, 900, 0, RANGE)
    out = notes._joined(windows, catalog._sidecar(spark), notes.AnnotationColumns(), "annotation_flags", "overlap_seconds")
    return out.select("open_time", "close_time", "src_count", F.array_join("annotation_flags", "|").alias("flags"), "overlap_seconds")





# --- snapshots -------------------------------------------------------------------------------------


def _manifest(**more) -> bytes:
    asset = {"candles.csv": {"bytes": 3, "sha256": hashlib.sha256(b"abc").hexdigest()}}
    return json.dumps({"schema_version": 1, "tag": "v1", "as_of": "2026-01-01T00:00:00+00:00", "first_timestamp": 0, "last_timestamp": 120, "row_count": 3, "generation_revision": "r", "assets": asset} | more).encode()


@_query("snapshot_continuity", f"""WITH {catalog._candles_sql(900)}, x AS (SELECT count(*) AS n, min(timestamp) AS a, max(timestamp) AS b FROM c)
    SELECT kind, expected, found FROM (SELECT 'manifest_span' AS kind, ({DAY0 + 9000} - {DAY0}) // 900 + 1 AS expected, 12 AS found, TRUE AS bad UNION ALL SELECT 'row_count', 12, n, n <> 12 FROM x
    UNION ALL SELECT 'first_timestamp', {DAY0}, a, a <> {DAY0} FROM x UNION ALL SELECT 'last_timestamp', {DAY0 + 9000}, b, b <> {DAY0 + 9000} FROM x) WHERE bad""")  # fmt: skip
def _continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    candles, profile = catalog._candles(spark, sf_dir, 900)
    stated = parse_manifest(_manifest(first_timestamp=DAY0, last_timestamp=DAY0 + 9000, row_count=12))
    found = continuity_report(candles, stated, profile).mismatches
    return spark.createDataFrame([(m.kind.value, m.expected, m.found) for m in found], "kind string, expected long, found long")





# --- specification forms ---------------------------------------------------------------------------

@_query("windows_reference_form", f"WITH {catalog._windows_sql(3600, 14_400, 3600, 0, RANGE)} SELECT {WINDOW} FROM w")
def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    candles, profile = catalog._candles(spark, sf_dir, 3600)
    return compute_reference_windows(candles, profile, window="4h", emit_every="1h", materialization=RANGE)


@_query("phased_lookback_reference_form", catalog.SQL["phased_lookback"])
def _phased_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = catalog._windows(spark, sf_dir, 3600, catalog._PW, 3600, 0, RANGE, positive=True)
    out = phased_lookback_reference(frame, window=Duration(catalog._PW), emit_every=Duration(catalog._PE), lookback=3).frame
    return out.select("close_time", *(F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(c) for c in ("close", "volume", "src_count", "traded_seconds")))


@_query("windows_swept", f"WITH {catalog._windows_sql(300, 86_400, 300, 0, RANGE)} SELECT {WINDOW} FROM w")
def _swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog._windows(spark, sf_dir, 300, 86_400, 300, 0, RANGE, plan="sweep")


@_query("windows_pane", f"WITH {catalog._windows_sql(300, 14_400, 3600, 1800, RANGE)} SELECT {WINDOW} FROM w")
def _pane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog._windows(spark, sf_dir, 300, 14_400, 3600, 1800, RANGE)


# --- policies, refusals and records ------------------------------------------------------------------


@_query("windows_off_grid", f"""WITH c AS ({_RAW}), t AS (SELECT unnest(range({RANGE.start}, {RANGE.end}, 1800)) AS t),
    w AS (SELECT t, arg_min(CASE WHEN event_type <> 'error' THEN value END, s::HUGEINT * 10000000000 + event_id) FILTER (WHERE s IS NOT NULL) AS unused, max(value) FILTER (WHERE event_type <> 'signup') AS top, bool_or(event_type = 'signup') AS endless, min(value) AS low,
    arg_min(event_id, s::HUGEINT * 10000000000 + event_id) AS early, arg_max(event_id, s::HUGEINT * 10000000000 - event_id) AS late, count(*) FILTER (WHERE event_type <> 'view') AS volume, count(s) AS n
    FROM t LEFT JOIN c ON s >= t - 14400 AND s + 60 <= t GROUP BY t)
    SELECT t - 14400 AS open_time, t AS close_time, CASE WHEN a.event_type <> 'error' THEN a.value END AS open, CASE WHEN endless THEN 'inf'::DOUBLE ELSE top END AS high, low, CASE WHEN b.event_id % 97 = 0 THEN 0 ELSE b.value END AS close,
    CASE WHEN volume > 0 THEN volume::DOUBLE END AS volume, n AS src_count, n * 60 AS coverage_seconds, volume * 60 AS traded_seconds
    FROM w LEFT JOIN events a ON a.event_id = early LEFT JOIN events b ON b.event_id = late""")  # fmt: skip
def _off_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as candles of a minute at their own second, searched; a close that is no number is shown as 0."""
    out = compute_windows(_raw_candles(spark, sf_dir), candle_profile("raw events", "1m"), window="4h", emit_every="30m", materialization=RANGE, plan="search")
    return out.withColumn("close", F.when(F.isnan("close"), F.lit(0.0)).otherwise(F.col("close")))


@_query("windows_ascending", f"WITH {catalog._windows_sql(300, 3600, 300, 0, RANGE)} SELECT row_number() OVER (ORDER BY close_time) - 1 AS position, close_time, close FROM w")
def _ascending(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_folder(spark)}/ascending"
    write_ascending(catalog._windows(spark, sf_dir, 300, 3600, 300, 0, RANGE), path)
    return read_ascending(spark, path).select(F.col(ROW).alias("position"), "close_time", "close")


# --- policies ----------------------------------------------------------------------------------------


@_query("quality_gate_report", f"WITH {catalog._windows_sql(900, 3600, 900, 0, RANGE)} SELECT {WINDOW}, r.* FROM w CROSS JOIN ({catalog.SQL['quality_report']}) r")
def _gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window, as a reporting gate drops none, with the counts of the gate's report beside it."""
    policy = WindowQualityPolicy(QualityMode.GATE, min_coverage=0.75, min_traded_seconds=900, gate_mode=GateMode.REPORT)
    gated = apply_quality_policy(catalog._windows(spark, sf_dir, 900, 3600, 900, 0, RANGE), policy, window="1h")
    return gated.frame.select("*", *(F.lit(n).cast("long").alias(name) for name, n in vars(gated.report).items()))


# --- schedules ---------------------------------------------------------------------------------------

_RATIO = math.sqrt(math.e + math.sqrt(5))
_METALLIC = "m(k, a, b) AS (SELECT 0, 1.0::DOUBLE, sqrt(exp(1) + sqrt(5)) + 1 UNION ALL SELECT k + 1, b, sqrt(exp(1) + sqrt(5)) * b + a FROM m WHERE k < 10)"


@_query("schedule_windows", f"""WITH RECURSIVE {catalog._candles_sql(900)}, {_METALLIC}, x AS (SELECT max(timestamp) + 900 AS until FROM c),
    w AS (SELECT 'metallic' AS schedule, 60 * round(a)::BIGINT AS member FROM m UNION ALL SELECT 'log_spaced', 900 * round(power(96, i / 4.0))::BIGINT FROM range(5) r(i)
    UNION ALL SELECT 'lookback', round(a)::BIGINT FROM m WHERE round(a) BETWEEN 3 AND 21 UNION ALL SELECT 'horizon', 60 * round(a)::BIGINT FROM m WHERE round(a) BETWEEN 146 AND 993)
    SELECT schedule, member, count(timestamp) AS candles, max(high) AS high FROM w CROSS JOIN x LEFT JOIN c ON timestamp >= until - member GROUP BY ALL""")  # fmt: skip
def _schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each member of the generated schedules, with the candles of the last so many seconds."""
    found = {
        "metallic": metallic_recurrence(coefficient=_RATIO, seed="1m", grain="1m", maximum="2w"),
        "log_spaced": log_spaced(count=5, minimum="15m", maximum="1d", grain="15m"),
        "lookback": metallic_lookback(coefficient=_RATIO, seed=1, grain=1, minimum=3, maximum=21),
        "horizon": metallic_horizons(coefficient=_RATIO, seed="1m", grain="1m", minimum="2h26m", maximum="16h33m"),
    }
    candles, _ = catalog._candles(spark, sf_dir, 900)
    members = [(k, n) for k, s in found.items() for n in s.members]
    ages = candles.select("high", (candles.select(F.max("timestamp") + 900).scalar() - F.col("timestamp")).alias("age"))
    held = F.filter(F.lit([n for _, n in members]), lambda n: F.col("age") <= n)  # the members that a candle counts for
    counts = ages.select("high", F.explode(F.array_distinct(held)).alias("member")).groupBy("member").agg(F.count("*").alias("candles"), F.max("high").alias("high"))
    listed = spark.createDataFrame(members, "schedule string, member long")
    return listed.join(counts, "member", "left").select("schedule", "member", F.coalesce("candles", F.lit(0).cast("long")).alias("candles"), "high")


@_query("cadence_pairs", f"""WITH RECURSIVE {catalog._candles_sql(900)}, {_METALLIC}, x AS (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM c), w AS (SELECT 60 * round(a)::BIGINT AS w FROM m),
    p AS (SELECT w, coalesce((SELECT max(a) FROM (VALUES (60), (300), (900), (3600), (14400)) l(a) WHERE a * 8 <= w), 60)::BIGINT AS e FROM w)
    SELECT w AS window_seconds, e AS emit_seconds, hi // e - (lo - 1) // e AS ticks FROM p, x""")  # fmt: skip
def _cadences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of window and emit cadence, with their ticks from the first candle's open time to the last one's."""
    rule = w_over_k(metallic_recurrence(coefficient=_RATIO, seed="1m", grain="1m", maximum="2w"), divisor=8, allowed=["1m", "5m", "15m", "1h", "4h"], source_cadence="1m")
    pairs = spark.createDataFrame([(p.window.total_seconds, p.emit_every.total_seconds) for p in rule.pairs], "window_seconds long, emit_seconds long")
    low, high = catalog._candles(spark, sf_dir, 900)[0].agg(F.min("timestamp"), F.max("timestamp")).first()
    minute = candle_profile("m", "1m")
    ticks = {p.emit_every.total_seconds: resolve_schedule(minute, window=p.window, emit_every=p.emit_every).count_ticks(low, high + 1) for p in rule.pairs}
    return pairs.withColumn("ticks", F.create_map(*(F.lit(x) for pair in ticks.items() for x in pair))[F.col("emit_seconds")].cast("long"))
