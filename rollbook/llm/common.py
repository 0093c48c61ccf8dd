"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker expands into numpy arrays at a time.
SLICE_BYTES = 8 << 20
#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 8 << 20


_OWNER: list = [None]
_CACHES: dict = {}


def trim():
    """Give memory that is free back to the system: workers are reused, and several share an
    executor's memory with the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def claim(owner: str):
    """What a Python worker remembers belongs to one operator; another one's work drops it."""
    if _OWNER[0] != owner:
        _OWNER[0] = owner
        _CACHES.clear()
        trim()


def trimmed(rows):
    """A generator over batches that gives memory back when a task ends."""

    @functools.wraps(rows)
    def run(batches, *more):
        try:
            yield from rows(batches, *more)
        finally:
            trim()

    return run


def remembered(owner: str, key, make):
    """The operator's own object for a key, made once in a worker."""
    claim(owner)
    if key not in _CACHES:
        _CACHES[key] = make()
    return _CACHES[key]


def bounded_batches(spark: SparkSession):
    """Batches that go to Python hold BATCH_BYTES at most: ten thousand long documents at once would
    be held several times over, by the JVM and by Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(df: DataFrame, rows, schema) -> DataFrame:
    """mapInArrow over batches of bounded bytes."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(rows, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A session that names none has a temporary one if all of
    it is one process; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.rollbook.scratch.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='rollbook-')}"
        spark.conf.set("spark.rollbook.scratch.dir", named)
    return named


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and reread: cuts the lineage, and a lost executor costs no
    recomputation. The table goes by `dropped`, or when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, system = _file_system(spark, path)
    system.deleteOnExit(where)
    return at_path(spark.read.schema(df.schema).parquet(path), path)


def at_path(df: DataFrame, path: str | None) -> DataFrame:
    df._settled_at = path
    return df


def settled_at(df: DataFrame) -> str | None:
    return getattr(df, "_settled_at", None)


def dropped(*tables: DataFrame):
    """Delete settled tables, once everything that reads them is settled itself."""
    for df in tables:
        if path := settled_at(df):
            where, system = _file_system(df.sparkSession, path)
            system.delete(where, True)


def held_out(doc_id="doc_id"):
    """crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The `rows` rows with the smallest hash of `key`: the same at every partitioning."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)


def texts_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column without nulls (null: empty)."""
    col = batch.column(name)
    return pc.fill_null(col.cast(pa.large_string()), "")


def byte_slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(first, last) row ranges of about `limit` bytes, one row at least."""
    n = len(texts)
    if not n:
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield at, stop
        at = stop


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    lens = lens.astype(np.int64)
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lens), lens)
