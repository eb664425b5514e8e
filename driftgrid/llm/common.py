"""Shared helpers of the training-data operators.

Texts reach the Python workers as Arrow string columns. The helpers below read
the UTF-8 buffer of a whole batch as one numpy array, so words, lines and their
hashes are found for many documents at once without a Python object per word.

Defined results for odd input: a null text counts as an empty one; byte
positions never cross a document; invalid UTF-8 never arises from Spark.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy step handles; a longer document is a step of its own.
BLOCK_BYTES = 1 << 21
#: Bytes of an Arrow batch that a task hands to Python.
ARROW_BYTES = 4 << 20

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACES = [9, 10, 11, 12, 13, 32]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[_SPACES] = True
_WORD_BYTE = _BYTE.copy()
_WORD_BYTE[_SPACES] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master may go without one and use a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="driftgrid-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as a Parquet table in the shared folder and read it back.

    `dropped` deletes such tables; what is left goes when the driver ends.
    """
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/driftgrid/{spark.sparkContext.applicationId}"
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    system, at = _file_system(spark, top)
    system.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete what `written` wrote; nothing that is still to be computed may read these tables."""
    for df in tables:
        system, at = _file_system(df.sparkSession, df.written_to)
        system.delete(at, True)


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow with batches of at most ARROW_BYTES, but for single longer rows.

    The bound is a setting of the session (spark.sql.execution.arrow.maxBytesPerBatch); a lower one stays.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark = df.sparkSession
    held = re.fullmatch(r"(\d+)b?", spark.conf.get(setting))
    if not held or int(held[1]) > ARROW_BYTES:
        spark.conf.set(setting, str(ARROW_BYTES))
    return df.mapInArrow(function, schema)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a hash depend on all bits of h."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the n + 1 offsets of its rows; nulls are empty."""
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else column.type)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes; rows are never cut."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at the offsets of the rows."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before &= ~fresh[:n]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after &= ~fresh[1:]
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words [^\\x20\\x09-\\x0D]+ of all rows."""
    return runs_of(~IS_SPACE[data], offsets)


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + (1 << 20))))
        first, last = int(starts[lo]), int(ends[hi - 1])
        rel = starts[lo:hi] - first
        length = np.diff(np.append(rel, last - first))
        at = np.arange(last - first) - np.repeat(rel, length)
        power = np.full(int(length.max()), BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        out[lo:hi] = np.add.reduceat(codes[data[first:last]] * power[at], rel)
        lo = hi
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words; equal on every machine."""
    return mix(_span_hashes(data, starts, ends, _WORD_BYTE))


def line_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of adjoining spans that each end before a byte not hashed (a line feed counts)."""
    return mix(_span_hashes(data, starts, ends, _BYTE))


def window_sums(hashes: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all windows of `width` consecutive hashes (modulo 2**64)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    power = np.uint64(1)
    done, chunk, step = 0, hashes, 1
    # binary decomposition of the width: S(2k) = S(k) + B**k * S(k) shifted by k
    bits = []
    while step <= width:
        if width & step:
            bits.append((step, chunk))
        if step * 2 <= width:
            chunk = chunk[: len(chunk) - step] + np.uint64(pow(int(BASE), step, 1 << 64)) * chunk[step:]
        step *= 2
    for step, part in bits:
        out += power * part[done : done + n]
        done += step
        power = np.uint64(pow(int(BASE), done, 1 << 64))
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of `width` values."""
    if len(values) < width:
        return values[:0]
    part, step = values, 1
    while step * 2 <= width:
        part = np.minimum(part[:-step], part[step:])
        step *= 2
    n = len(values) - width + 1
    return np.minimum(part[:n], part[width - step : width - step + n])


def rows_of(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The row that each byte position lies in (empty rows hold none)."""
    return np.searchsorted(offsets, positions, "right") - 1


def is_hot(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which keys are among a few sorted ones."""
    low = np.zeros(1 << 16, bool)
    low[(hot & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = low[(keys & np.uint64(0xFFFF)).astype(np.int64)]
    at = np.flatnonzero(out)
    out[at] = hot[np.minimum(np.searchsorted(hot, keys[at]), len(hot) - 1)] == keys[at]
    return out


def _weighed(batches: Iterator[pa.RecordBatch], weigh, least: int) -> Iterator[pa.RecordBatch]:
    total = 0
    for size, keys, weights in weigh(batches):
        total += size
        own, of = np.unique(keys, return_inverse=True)
        weight = np.bincount(of, weights, len(own)).astype(np.int64)
        some = weight >= least
        yield pa.RecordBatch.from_arrays([pa.array(own[some].view(np.int64)), pa.array(weight[some])], names=["key", "weight"])
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], names=["key", "weight"])


def hot_keys(docs: DataFrame, weigh, bucket: int, most: int, least: int = 1024) -> tuple[int, np.ndarray]:
    """The bytes of all texts, and the sorted keys whose weights add up to a bucket or more, at most `most` of them.

    `weigh` gives (bytes of text, keys, weights) for each part of the texts; keys that weigh under `least` in a part are
    not counted there, as they only tell how to spread the work.
    """
    counted = in_arrow(docs.select("text"), partial(_weighed, weigh=weigh, least=least), "key long, weight long").groupBy("key").agg(F.sum("weight").alias("weight"))
    rows = counted.filter(F.col("key").isNull() | (F.col("weight") >= bucket)).orderBy(F.col("key").isNotNull(), F.desc("weight")).limit(most + 1).collect()
    hot = np.array([r["key"] for r in rows if r["key"] is not None], np.int64).view(np.uint64)
    return sum(r["weight"] for r in rows if r["key"] is None), np.sort(hot)


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zip_up = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = [zip_up((t.as_py() or "").encode()) for t in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary())], names=batch.schema.names)


def squeezed(df: DataFrame) -> DataFrame:
    """df with its last column, a text, packed by zstd (null: empty), so that a shuffle moves less."""
    return in_arrow(df, _squeezed, T.StructType([*df.schema.fields[:-1], T.StructField(df.columns[-1], T.BinaryType())]))
