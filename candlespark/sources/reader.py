"""CSV readers: declared types pinned, rows numbered in file order, empty files told from short ones."""

from __future__ import annotations

import csv
import re
import tempfile
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from candlespark.columns import LONG, ROW, STRING
from candlespark.errors import ConfigError, bounded_echo
from candlespark.logs import get_logger
from candlespark.operators.annotations import AnnotationColumns, AnnotationValidationError, require_annotations
from candlespark.sources.profile import SourceProfile
from candlespark.sources.validation import ValidationMode, ValidationReport, validate_source_frame

logger = get_logger(__name__)
GZIP_MAGIC = b"\x1f\x8b"


class NoDataError(Exception):
    """The file has nothing in it, not even a header."""


@dataclass(frozen=True)
class SourceReadResult:
    frame: DataFrame
    report: ValidationReport


def _begin(spark: SparkSession, path: str) -> tuple[bool, str | None]:
    """(gzip by content, the first line or None of a file that decompresses to nothing), through Spark's file systems."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        logger.error("no such file: %s", path)
        raise FileNotFoundError(path)
    if store.getFileStatus(where).isDirectory():
        raise IsADirectoryError(path)
    stream = store.open(where)
    try:
        zipped = bytes(b for b in (stream.read(), stream.read()) if b >= 0) == GZIP_MAGIC
        stream.seek(0)
        text = jvm.java.util.zip.GZIPInputStream(stream) if zipped else stream
        return zipped, jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(text, "UTF-8")).readLine()
    finally:
        stream.close()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which all machines share; a temporary one where this machine is all there is."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return f"{named}/{uuid.uuid4().hex}"
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp()


def _spark_path(spark: SparkSession, path: str, zipped: bool) -> str:
    """Spark tells gzip by the suffix; a file that belies its own is copied to one that does not, store to store."""
    if zipped == path.endswith(".gz"):
        return path
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source = jvm.org.apache.hadoop.fs.Path(path)
    target = jvm.org.apache.hadoop.fs.Path(f"{scratch_folder(spark)}/{'source.csv.gz' if zipped else 'source.csv'}")
    store = target.getFileSystem(conf)
    jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, store, target, False, conf)
    store.deleteOnExit(target)
    return target.toString()


def _read(spark: SparkSession, path: str, types: dict, max_rows: int | None) -> DataFrame:
    """The file with ``types`` for declared columns and types inferred over all rows for the others, rows numbered in ``__row`` in file order."""
    zipped, line = _begin(spark, path)
    if line is None:
        raise NoDataError(f"{path} is empty")
    names = next(csv.reader([line]), [""])
    seen: dict[str, int] = {}
    unique = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        unique.append(n if seen[n] == 1 else f"{n}__{seen[n]}")
    source = _spark_path(spark, path, zipped)
    inferred = {}
    if any(n not in types for n in unique):
        probe = spark.read.option("header", True).option("inferSchema", True).csv(source)
        inferred = {n: f.dataType for n, f in zip(unique, probe.schema.fields)}
    schema = StructType([StructField(n, types.get(n, inferred.get(n, StringType()))) for n in unique])
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(source)
    df = df.withColumn(ROW, F.monotonically_increasing_id())  # splits of a file are numbered in its order
    return df if max_rows is None else df.orderBy(ROW).limit(max_rows)


def _row_cap(value: int | None) -> None:
    if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 0):
        raise ConfigError(f"max_rows must be a non-negative int, got {bounded_echo(value)}")


def read_source_csv(spark: SparkSession, path: str | Path, profile: SourceProfile, *, mode: ValidationMode = ValidationMode.STRICT, max_rows: int | None = None) -> DataFrame | SourceReadResult:
    """Read a candle CSV (plain or gzip by content). STRICT gives the frame or raises; REPORT gives frame and report.

    ``max_rows`` keeps the first rows of the file. Nothing is sorted, filled, dropped or merged.
    """
    _row_cap(max_rows)
    df = _read(spark, str(path), {c: k.read_as for c, k in profile.raw_schema.items()}, max_rows)
    report = validate_source_frame(df, profile, mode=mode)
    return df if mode is ValidationMode.STRICT else SourceReadResult(df, report)


def read_annotations(spark: SparkSession, path: str | Path, *, columns: AnnotationColumns = AnnotationColumns(), max_rows: int | None = None) -> DataFrame:
    """Read an annotation sidecar: three typed columns, extras kept. A file over ``max_rows`` is refused whole."""
    _row_cap(max_rows)
    path = str(path)
    try:
        df = _read(spark, path, {columns.start: LONG, columns.end: LONG, columns.flag: STRING}, None if max_rows is None else max_rows + 1)
    except NoDataError as e:
        raise AnnotationValidationError(str(e)) from e
    try:
        n = require_annotations(df, columns)
    except (ConfigError, AnnotationValidationError):
        raise
    except Exception as e:  # a malformed row ends the job with an error of the CSV parser
        if "MALFORMED" in str(e) or "CANNOT_PARSE" in str(e) or "FAILED_READ_FILE" in str(e):
            raise AnnotationValidationError(f"{path} cannot be read as a sidecar: {bounded_echo(str(e))}") from e
        raise
    if max_rows is not None and n > max_rows:
        raise AnnotationValidationError(f"{path} has more than {max_rows} rows")
    return df
