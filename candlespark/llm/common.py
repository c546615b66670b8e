"""What the text operators share: table access, lineage cuts and Arrow text buffers."""

from __future__ import annotations

import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; bounds the temporaries of a Python worker.
PIECE_BYTES = 1 << 20

#: Bytes of one Arrow batch on its way to a Python worker, where the session has Spark's default of 64 MiB.
BATCH_BYTES = 8 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read with Spark so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    One is made only where the session names none and runs on this machine alone; on a cluster
    a folder of one machine would lose rows, so that ends in an error.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp())
    return context._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    Checkpoints survive a lost executor, unlike cached or locally checkpointed blocks.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_name(columns: list[str], name: str) -> str:
    """``name``, or a longer one that none of ``columns`` has in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_rows(df: DataFrame, name: str = "__row") -> DataFrame:
    """``df`` with a number of its own for each row, as written to the shared folder: it stays when a task is run again."""
    path = shared_path(df.sparkSession, "rows")
    df.withColumn(name, F.monotonically_increasing_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bucketed(df: DataFrame, column: str, buckets: int, name: str) -> DataFrame:
    """``df`` as written to the shared folder, bucketed by ``column``, so that grouping by it needs no shuffle.

    Only tables can be bucketed: for the time of the write the catalog has one of a name of its own, so ``spark_catalog.default`` must be writable.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    table = f"spark_catalog.default.{path.rsplit('/', 1)[1].replace('-', '_')}"
    df.write.bucketBy(buckets, column).option("path", path).saveAsTable(table, format="parquet")
    out = spark.table(table)
    out.schema  # noqa: B018  resolves the files, so that the catalog need not keep the name
    spark.sql(f"DROP TABLE {table}")
    return out


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes, and workers that give freed memory back when a task ends.

    Workers are used again by later stages; what they keep would add up in an executor.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key) == f"{64 << 20}b":
        df.sparkSession.conf.set(key, f"{BATCH_BYTES}b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory of Arrow and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def learning_bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def drawn(hash64: Column, share: float) -> Column:
    """Whether a signed 64-bit hash falls into ``share`` of its range; no share above 1e-19 rounds to nothing."""
    return hash64 <= F.lit(min((1 << 63) - 1, math.ceil(share * 2.0**64) - (1 << 63))).cast("long")


#: Bits of the largest screen: 16 MiB. It serves up to one key in eight bits; with more keys, all rows pass.
SCREEN_BITS, SCREEN_SHARE = 27, 8


def screened(rows: DataFrame, keys: DataFrame, hash64: str, n_keys: int) -> DataFrame:
    """The rows whose ``hash64`` may be among that of ``keys``, before the join that decides: most others go without a shuffle.

    The screen is a bitmap of bounded size, which is broadcast; it grows with the number of keys
    up to that bound. Beyond it no screen is made, which costs a shuffle and changes no result.
    """
    bits = max(15, math.ceil(math.log2(SCREEN_SHARE * max(1, n_keys))))
    if bits > SCREEN_BITS:
        return rows
    slot = F.shiftrightunsigned(hash64, 64 - bits) + 1
    bucket, bit = F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot)
    screen = keys.select(bucket.alias("__page"), bit.alias("__bit")).groupBy("__page").agg(F.bitmap_construct_agg("__bit").alias("__map"))
    set_bit = F.expr("shiftright(cast(conv(hex(substring(__map, cast(__bit div 8 as int) + 1, 1)), 16, 10) as int), cast(__bit % 8 as int)) & 1") == 1
    return rows.withColumn("__page", bucket).withColumn("__bit", bit).join(F.broadcast(screen), "__page").where(set_bit).select(rows.columns)


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z; every other code point unchanged."""
    return F.translate(col, UPPER, LOWER)


def utf8(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of ``batch`` whose texts have about ``limit`` bytes; a longer text is a slice of its own."""
    _, at = utf8(batch.column(text))
    start, rows = 0, batch.num_rows
    while start < rows:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def segment_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``values[at[i]:at[i+1]]`` for each i, in float64; an empty segment sums to 0."""
    if not len(values):
        return np.zeros(len(at) - 1)
    full = at[1:] > at[:-1]
    out = np.zeros(len(at) - 1)
    out[full] = np.add.reduceat(values, at[:-1][full], dtype=np.float64)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x
