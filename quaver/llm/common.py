"""Shared helpers: stored tables, Arrow text buffers, byte-level words and their fingerprints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in groups of about this many bytes, so that arrays of a group stay small.
GROUP_BYTES = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C13)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="quaver-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` from a written table: lineage ends here and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def drop(table: DataFrame) -> None:
    """Delete a table of ``stored`` that no later step reads, not even to make lost rows again."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished steps that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def key_rank(column: Column) -> Column:
    """A row order that does not depend on partitions."""
    return F.xxhash64(column)


def text_groups(batch: pa.RecordBatch, column: str = "text", most: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of consecutive rows; null texts are empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, ends, data = texts.buffers()
    n = len(texts)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def lower_ascii(data: np.ndarray) -> np.ndarray:
    # Differences of bytes wrap, so one comparison tells a range; it is much faster than a look-up for each byte.
    return data + ((data - np.uint8(0x41) < 26).view(np.uint8) << np.uint8(5))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, per text, the position of its first word."""
    inside = (data != 0x20) & (data - np.uint8(0x09) >= 5)
    n = len(data)
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def powers(n: int, back: bool = False) -> np.ndarray:
    """Powers 0 to n - 1 of the fingerprint's step, or of its inverse, modulo 2**64."""
    name = "back" if back else "on"
    if name not in _powers or len(_powers[name]) < n:
        size = max(n, GROUP_BYTES + 4096)
        steps = np.full(size, _BACK if back else _STEP, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit mix of each number (wrapping)."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit fingerprints of byte spans: differences of one running polynomial sum (``sums``, where it is there already)."""
    if sums is None:
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES.take(data) * powers(len(data)), out=sums[1:])
    value = (sums[ends] - sums[starts]) * powers(len(data) + 1, back=True)[starts]
    return mixed(value + (ends - starts).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)
