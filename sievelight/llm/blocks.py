"""Moving whole documents between tasks as compressed Arrow blocks.

A shuffled row is one block: the Arrow rows that one map task has for one bucket, zstandard-compressed.  Blocks
keep the number of shuffled rows low, compress across documents and carry any columns along unchanged.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An Arrow batch's rows and bytes, a row at least.
BATCH_ROWS, BATCH_BYTES = 400, 8 << 20
#: Raw bytes that a map task gathers before it ships blocks.
FLUSH_BYTES = 12 << 20
#: Raw bytes of text for each bucket; a bucket is handled by one task at a time.
BUCKET_BYTES = 12 << 20


def session_limits(spark: SparkSession) -> None:
    """Keep Arrow batches small, in rows and in bytes, so that long texts can't fill a Python worker.

    Spark reads these limits when a plan runs, so they stay set in the session; lower ones of the caller's are kept.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = (spark.conf.get(key) or "").removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; in local mode a temp folder will do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sievelight-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def until_the_end(spark: SparkSession, path: str) -> None:
    """Have a folder that is there deleted when the driver's JVM ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors.  The folder goes when the driver ends."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    until_the_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def pack(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write(table)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def unpack(block: bytes) -> pa.Table:
    with zstandard.ZstdDecompressor().stream_reader(block, read_across_frames=True) as raw:
        return pa.ipc.open_stream(pa.BufferReader(raw.read())).read_all()


def bucket_count(n_bytes: int, bucket_bytes: int = BUCKET_BYTES, growth: int = 8) -> int:
    """Buckets for so many bytes.  From some hundreds of GB on they grow with the root of the input (by 8: 80 MB at 100 TB), so
    that neither their number nor their size gets out of hand."""
    n = int(n_bytes or 0)
    return max(1, -(-n // max(bucket_bytes, growth * math.isqrt(n))))


def spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash() of 32-bit integers (Murmur3 with seed 42)."""

    def turned(v: np.ndarray, bits: int) -> np.ndarray:
        return (v << np.uint32(bits)) | (v >> np.uint32(32 - bits))

    k = turned(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turned(k ^ np.uint32(42), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def even_labels(spark: SparkSession, n: int) -> np.ndarray:
    """n integers that Spark's hash deals to the shuffle's partitions in turn, so that no task gets several buckets by chance
    while another gets none.  Four bytes a bucket."""
    parts = int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or spark.conf.get("spark.sql.shuffle.partitions"))
    each, m = -(-n // parts), n + 32 * parts
    while True:
        to = spark_hash(np.arange(m, dtype=np.int32)).astype(np.int64) % parts
        if np.bincount(to, minlength=parts).min() >= each:
            break
        m *= 2
    order = np.argsort(to, kind="stable")
    first = np.searchsorted(to[order], np.arange(parts))
    at = np.arange(n)
    return order[first[at % parts] + at // parts].astype(np.int32)


def extent(df: DataFrame, text_col: str) -> tuple[int, int]:
    """Rows and bytes of text."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_col))).first()
    return int(row[0]), int(row[1] or 0)


def splitters(df: DataFrame, column: str, n: int) -> np.ndarray:
    """At most n - 1 increasing values that cut `column` into n parts of about as many rows each (nulls go first)."""
    if n < 2:
        return np.array([], dtype=np.int64)
    cuts = df.agg(F.percentile_approx(F.col(column).cast("long"), [i / n for i in range(1, n)], min(max(10_000, 20 * n), 1_000_000))).first()[0]
    return np.unique(np.array(cuts or [], dtype=np.int64))


def column(name: str) -> Column:
    """The column of that name, whatever the name holds."""
    return F.col(f"`{name.replace('`', '``')}`")


def numbered(names: list[str]) -> list[Column]:
    """These columns as c_0, c_1, ...: any names get through Arrow functions and can't clash."""
    return [column(c).alias(f"c_{i}") for i, c in enumerate(names)]


def named(names: list[str]) -> list[Column]:
    """Numbered columns under their names again."""
    return [F.col(f"c_{i}").alias(c) for i, c in enumerate(names)]


def deal(df: DataFrame, assign: Callable[[pa.Table], Iterable[tuple[int, np.ndarray | None]]]) -> DataFrame:
    """Rows (bucket int, block binary) of df's rows; assign(table) yields (bucket, row numbers, None for all)."""

    def ship(gathered: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(gathered).combine_chunks()
        for bucket, rows in assign(table):
            block = pack(table if rows is None else table.take(pa.array(rows)))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([block], pa.binary())], ["bucket", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, held = [], 0
        for batch in batches:
            if batch.num_rows:
                gathered.append(batch)
                held += batch.nbytes
            if held >= FLUSH_BYTES:
                yield from ship(gathered)
                gathered, held = [], 0
        if gathered:
            yield from ship(gathered)

    return df.mapInArrow(run, "bucket int, block binary")


def by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, row numbers in their order) for each bucket that occurs."""
    order = np.argsort(buckets, kind="stable")
    at = buckets[order]
    edges = np.flatnonzero(np.diff(at)) + 1
    for rows in np.split(order, edges) if len(order) else ():
        yield int(buckets[rows[0]]), rows


def rejoined(blocks: pa.Table, column: str = "block") -> pa.Table | None:
    """All rows of a bucket's blocks."""
    tables = [unpack(b.as_buffer()) for b in blocks.column(column)]
    return pa.concat_tables(tables) if tables else None


def ids_of(table: pa.Table, column: str = "doc_id") -> np.ndarray:
    """The ids as int64; null sorts before all others."""
    return table.column(column).cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def release() -> None:
    """Give freed memory back: Python workers stay for other tasks, and what they hold counts for their executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def releasing(f: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """A grouped function that releases what it leaves behind; the number of arguments is kept, as Spark counts them."""
    if f.__code__.co_argcount == 1:

        def one(table: pa.Table) -> pa.Table:
            out = f(table)
            release()
            return out

        return one

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        release()
        return out

    return two
