"""Helpers shared by the training-data operators: shared scratch tables and Arrow text batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of text that one Arrow batch brings to a Python worker (a single longer row still travels whole).
BATCH_BYTES = 4 << 20
#: Most bytes of text that the vectorised kernels look at together.
BLOCK_BYTES = 1 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where it is unset a local session (tests) gets a temporary one; on a cluster, whose executors
    don't share such folders, that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="skeinwork-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
        except Exception:  # the JVM may be gone already
            pass

    atexit.register(remove)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is common if more than one in so many rows have it; so there are at most so many such keys.
COMMON = 4096


def joined_evenly(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``facts`` (one row a key, stored), where ``count`` is a key's number of rows and ``total`` that of all: common keys, which
    would each bring a large share of the rows to one task, are broadcast, at most COMMON of them; the others are shuffled. ``count`` is dropped."""
    often = facts.where(F.col(count) * COMMON > total).drop(count)
    rest = facts.where(F.col(count) * COMMON <= total).drop(count)
    return rows.join(F.broadcast(often), keys).unionByName(rows.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(rest, keys))


def text_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, so that very long texts cannot pile up in a worker or in the buffers beside the JVM's heap. All operators ask
    for the same bounds, and smaller ones that the session has already stay; so plans may be made in any order."""
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", 4096)):
        name = f"spark.sql.execution.arrow.{name}"
        have = spark.conf.get(name, None)
        if not (have and have.isdigit() and 0 < int(have) <= most):
            spark.conf.set(name, str(most))


@contextlib.contextmanager
def steady_heap(most: int = 32 << 20, after: int = 1 << 20) -> Iterator[None]:
    """Keep freed memory in the process meanwhile: where arrays of the same sizes come and go, mapping them anew each time costs a third of the time."""
    trim, mmap = -1, -3  # fixed values: glibc's names for mallopt
    libc = ctypes.CDLL(None)
    able = hasattr(libc, "mallopt")
    if able:
        libc.mallopt(trim, 8 * most)
        libc.mallopt(mmap, most)
    try:
        yield
    finally:
        if able:
            libc.mallopt(trim, 2 * after)
            libc.mallopt(mmap, after)


Batches = Iterator[pa.RecordBatch]


def tidied(run: Callable[[Batches], Batches], steady: bool = False) -> Callable[[Batches], Batches]:
    """``run``, giving freed memory back to the system at its end: workers live on, and share their executor's memory. ``steady``: not before its end."""

    def wrapped(batches: Batches) -> Batches:
        with steady_heap() if steady else contextlib.nullcontext():
            yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def text_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1) of a string column, without making Python strings; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose texts hold about ``most`` bytes (at least one row each)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
