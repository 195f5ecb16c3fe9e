"""Shared pieces of the training-data operators: shared storage, Arrow text access and word scanning."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that the numpy code works on at a time (a longer document makes a longer chunk).
CHUNK_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: the cluster's ``spark.checkpoint.dir``, or in local mode one of our own where unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tracemill-")
        _scratch.append(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What this process has written to the shared folder and not deleted yet.
_scratch: list[str] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted by ``clear_scratch`` or when the process ends."""
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors. Its shuffle files go at once."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def scratch_mark() -> int:
    """For ``clear_scratch``: what is written from now on."""
    return len(_scratch)


def clear_scratch(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete what was written since a mark, but for the tables in ``keep``. Frames that read the rest are no use afterwards."""
    kept = {getattr(k, "scratch", None) for k in keep}
    gone = [p for p in _scratch[since:] if p not in kept]
    _scratch[since:] = [p for p in _scratch[since:] if p in kept]
    _delete(spark, gone)


def drop_scratch(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more."""
    for df in tables:
        path = getattr(df, "scratch", None)
        if path in _scratch:
            _scratch.remove(path)
            _delete(df.sparkSession, [path])


def _delete(spark: SparkSession | None, paths: list[str]) -> None:
    for p in paths:
        parts = urlparse(p)
        if parts.scheme in ("", "file"):
            shutil.rmtree(parts.path, ignore_errors=True)
        elif spark is not None:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clear_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _scratch else None
    try:
        clear_scratch(spark)
    except Exception:  # the session may be gone already; what is left is the shared folder's owner's
        pass


def small_batches(spark: SparkSession, records: int = 500) -> None:
    """Text rows can be long: keep the Arrow batches that reach Python workers small, for the rest of the session (Spark reads the setting when a plan runs)."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > records:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))


def extend(schema: T.StructType, ddl: str) -> T.StructType:
    """A new schema with further columns."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def release_memory() -> None:
    """Give freed memory back to the system, where the C library can: a reused worker does not keep its peak."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def set_aside(df: DataFrame, names: list[str]):
    """``df`` with columns of these names renamed, and the function that selects its columns under their own names again."""
    aside = {c: f"__own_{c}" for c in df.columns if c in names}

    def restore(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(aside[c]).alias(c) if c in aside else F.col(c) for c in df.columns])

    return df.withColumnsRenamed(aside), restore


def id_text(col: str = "doc_id"):
    """The id as text; null counts as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the len+1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    lo, hi = int(offs[0]), int(offs[-1])
    body = np.frombuffer(data, np.uint8, hi - lo, lo) if hi > lo else np.zeros(0, np.uint8)
    return body, offs - lo


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES):
    """Row ranges (a, b) whose texts hold about ``size`` bytes together; each row falls in one range."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Byte classes: words of letters, digits and any non-ASCII character; words of anything but white space.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """Starts and ends of the maximal runs of ``inside`` bytes; no run crosses a row's border.

    Also returns, for every word, the index of its row.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    mask = inside[data]
    begin = mask.copy()
    begin[1:] &= ~mask[:-1]
    first = offsets[:-1]
    first = first[first < n]
    begin[first] |= mask[first]
    starts = np.flatnonzero(begin)
    end = mask.copy()
    end[:-1] &= ~mask[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] |= mask[last]
    ends = np.flatnonzero(end) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


_POWERS = np.ones(1, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd base modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 2 * len(_POWERS)), _BASE, np.uint64)
        grown[0] = 1
        _POWERS = np.cumprod(grown, dtype=np.uint64)
    return _POWERS[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word, alike at any place; callers verify bytes where it must be exact."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lens = ends - starts
    # position of each byte inside its word, by a running index minus the word's start
    width = int(lens.max())
    pw = powers(width + 1)
    at = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    src = np.repeat(starts, lens) + at
    terms = (data[src].astype(np.uint64) + np.uint64(1)) * pw[at]
    sums = np.add.reduceat(terms, np.cumsum(lens) - lens)
    return mix(sums + lens.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
