"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.session import scratch_path

BROADCAST_BYTES = 32 << 20      # most that is broadcast, after the size has been counted
CHUNK_BYTES = 2 << 20           # text handled by one numpy pass; one longer text is a pass


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a fresh folder under the shared checkpoint folder and read it back: the
    lineage ends at files that every executor sees, so a lost executor costs no recomputation.
    The shuffle files of the write go when it ends; nothing reads them again."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` (already materialized) is small enough, counted, to be sent to every task."""
    return df.count() * row_bytes <= limit


def hint_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint when its counted size allows, else as it is (shuffle join)."""
    return F.broadcast(df) if fits_broadcast(df, row_bytes) else df


def utf8_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (n + 1) of a string column; null is the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64, len(col) + 1 + col.offset)[col.offset:]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of rows of about ``limit`` bytes each (one row at least)."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi
        lo = hi


def ragged_arange(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for every length l, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public murmur3 / splitmix shape)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
