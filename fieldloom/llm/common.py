"""What several corpus operators share: shared-folder tables, Arrow text buffers, hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder used only where a session on one machine sets no spark.checkpoint.dir (tests).
LOCAL_SHARED = "/tmp/fieldloom-shared"

WORD_5 = 5
U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; only a session on one machine may leave it out."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (base or LOCAL_SHARED).rstrip("/")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet under the shared folder and reads it back.

    This cuts the lineage with files every executor can read, so a lost
    executor costs the lost tasks and not the steps before them. A table that a
    result still reads when its function returns stays until clean() is called,
    or this process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fieldloom_path = path
    _STAGED.add(path)
    return out


#: Stage tables of this process that are still there.
_STAGED: set[str] = set()


def clean(spark: SparkSession) -> int:
    """Deletes the stage tables that this process has left, and says how many; for after the last action on results that read them."""
    n = len(_STAGED)
    for at in [*_STAGED]:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _STAGED.discard(at)
    return n


@atexit.register
def _clean_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _STAGED else None
    if spark is not None:
        with contextlib.suppress(Exception):  # the driver's JVM may be gone already
            clean(spark)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes stage tables, and lets Spark drop the shuffle files of steps that ended some time ago."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t._fieldloom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _STAGED.discard(t._fieldloom_path)
    gc.collect()
    spark._jvm.System.gc()


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of the step that has just ended.

    It does so once the driver's garbage collection has found the step's plan,
    and listeners hold that for a moment longer; so it is asked for twice.
    """
    release(spark)
    time.sleep(0.5)
    release(spark)


#: Arrow batches end at so many bytes, so that very long texts don't meet in one batch.
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches end at BATCH_BYTES; each operator that sends texts to Python asks for it."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(documents: DataFrame, id_column: str) -> DataFrame:
    """(doc_id, text) of each row, with a null text made empty."""
    return bounded_batches(documents).select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def keep_where(docs: DataFrame, decide: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """The rows of docs whose texts decide() accepts, half a megabyte of texts at a time.

    Only the texts go to Python and one boolean of each comes back; whole rows
    stay in the JVM. A null text is decided as an empty one.
    """

    @F.arrow_udf("boolean")
    def accepted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.concat_arrays([pa.array([], pa.bool_()), *(decide(part) for part in slices(column))])
            trim()

    return bounded_batches(docs).where(accepted(F.coalesce("text", F.lit(""))))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one array, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(texts: pa.Array, limit: int):
    """(first row, rows) of stretches with at most about limit bytes of text, or one row."""
    ends, start = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)), 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop - start
        start = stop


def slices(texts: pa.Array, limit: int = 1 << 19) -> Iterator[pa.Array]:
    """Slices of a text column of at most about limit bytes, or one row."""
    for cut in _cuts(texts, limit):
        yield texts.slice(*cut)


def rows_of(batch: pa.RecordBatch, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold at most about limit bytes of text, or one row."""
    for cut in _cuts(batch.column(batch.schema.get_field_index("text")), limit):
        yield batch.slice(*cut)


def trim() -> None:
    """Gives memory that this worker no longer uses back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_BASE = 0x5851F42D4C957F2D | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @staticmethod
    def _grow(have, factor, n):
        while len(have) < n:
            have = np.concatenate([have, have * U64(pow(factor, len(have), 1 << 64))])
        return have

    def get(self, n):
        self.up, self.down = self._grow(self.up, _BASE, n), self._grow(self.down, _INVERSE, n)
        return self.up, self.down


_POWERS = _Powers()


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of table[byte] * base**i modulo 2**64."""
    up, _ = _POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of data[start:stop], the same for equal bytes wherever they stand; not yet mixed."""
    _, down = _POWERS.get(len(prefix))
    return (prefix[stop] - prefix[start]) * down[start]


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About bound rows of different keys chosen by a hash of the key; all of them where there are fewer.

    The bound is a parameter of the fits that use it. The result's size is
    proven by it, so it may be broadcast.
    """
    n = rows.count()
    if n <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1_000_003)) < int(1_000_003 * bound / n))


def no_text(df: DataFrame, text: str = "text") -> DataFrame:
    """The frame with a null text made empty."""
    return df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
