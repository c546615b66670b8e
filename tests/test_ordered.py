"""The ascending sink: files and rows in order, and what is refused."""

from __future__ import annotations

import random

import pytest

from candlespark.columns import ROW
from candlespark.sources import ordered


def test_files_and_rows_ascend(spark, tmp_path):
    rng = random.Random(71)
    rows = [(rng.choice([None, *range(500)]), k) for k in range(4000)]
    df = spark.createDataFrame(rows, "close_time long, note long").repartition(7)
    path = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few rows would be one file
    try:
        ordered.write_ascending(df, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = ordered.read_ascending(spark, path).collect()
    by_row = sorted(got, key=lambda r: r[ROW])
    assert [r[ROW] for r in by_row] == list(range(4000)) and sorted((r["note"], r["close_time"]) for r in got) == sorted(((k, t) for t, k in rows), key=lambda x: x[0])
    values = [r["close_time"] for r in by_row]
    assert values == sorted(values, key=lambda v: (v is not None, v or 0))
    assert len(list((tmp_path / "out").glob("part-*"))) > 1
    empty = str(tmp_path / "empty")
    ordered.write_ascending(df.limit(0), empty)
    assert ordered.read_ascending(spark, empty).collect() == []


def test_disorder_is_found(spark, tmp_path):
    path = str(tmp_path / "bad")
    spark.createDataFrame([(3,), (1,), (2,)], "close_time long").coalesce(1).write.parquet(path)
    assert ordered._descents(spark, path, "close_time") == 1
    spark.createDataFrame([(5,), (None,)], "close_time long").coalesce(1).write.mode("overwrite").parquet(path)
    assert ordered._descents(spark, path, "close_time") == 1
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match=ROW):
        spark.range(3).select(F.col("id").alias(ROW)).write.mode("overwrite").parquet(path)
        ordered.read_ascending(spark, path)
