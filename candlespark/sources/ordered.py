"""An ascending sink: Parquet files whose names and rows are in the order of a column.

A frame has no order of its own, so what comes out of windows or returns is unordered. Written here it is
cut into ranges of the column, one or more files each, sorted inside; that is read back in order by file name and row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlespark.columns import ROW, require_absent
from candlespark.errors import DataValidationError


def write_ascending(df: DataFrame, path: str, by: str = "close_time") -> None:
    """Write ``df`` to a new folder in ascending order of ``by``, nulls first, and check what was written.

    Ranges are drawn from a sample of the column, so files are of about equal size and no task sorts
    more than its own range. Rows of equal value stay together in no order of their own.
    """
    df.repartitionByRange(F.asc_nulls_first(by)).sortWithinPartitions(F.asc_nulls_first(by)).write.parquet(path)
    bad = _descents(df.sparkSession, path, by)
    if bad:
        raise DataValidationError(f"{bad} rows of {path} do not follow the row before by {by}")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumns({"__file": F.col("_metadata.file_name"), "__at": F.col("_metadata.row_index")})


def _files(rows: DataFrame, *more) -> DataFrame:
    """A row for each file, with the number of rows in those before it."""
    files = rows.groupBy("__file").agg(F.count("*").alias("n"), *more)
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # few: one a file
    return files.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))


def _descents(spark: SparkSession, path: str, by: str) -> int:
    """Places where the order falls, within files and from one to the next."""
    rows = _rows(spark, path).select("__file", "__at", F.col(by).alias("v"))
    falls = lambda now, last: now.isNull() & last.isNotNull() | (now < last)
    # row groups of a file are pieces of their own: each is compared within by its numbers in stretches
    stretch = F.floor(F.col("__at") / F.lit(1 << 20))
    cut = rows.withColumn("b", stretch)
    last = F.lag(F.struct("v")).over(Window.partitionBy("__file", "b").orderBy("__at"))
    inside = cut.withColumn("last", last).where(F.col("last").isNotNull() & F.coalesce(falls(F.col("v"), F.col("last.v")), F.lit(False)))
    ends = cut.groupBy("__file", "b").agg(F.min_by(F.struct("v"), "__at").alias("first"), F.max_by(F.struct("v"), "__at").alias("last"))
    edge = F.lag("last").over(Window.orderBy("__file", "b"))  # a row for each stretch
    seams = ends.withColumn("edge", edge).where(F.col("edge").isNotNull() & F.coalesce(falls(F.col("first.v"), F.col("edge.v")), F.lit(False)))
    return inside.count() + seams.count()


def read_ascending(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_ascending` wrote, with each row's number in ``__row`` from 0, which the guards of this library read as the order."""
    rows = _rows(spark, path)
    names = [c for c in rows.columns if c not in ("__file", "__at")]
    require_absent(rows.select(names), [ROW])
    starts = _files(rows).select("__file", "start")
    return rows.join(F.broadcast(starts), "__file").select(*names, (F.col("start") + F.col("__at")).alias(ROW))
