"""Shared helpers: scratch tables on the cluster's shared folder, columns by
name, dense counters of fixed size."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Only a local
    session, where driver and executor are one process, gets a temporary one."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="newslake-llm-"))
    return spark.sparkContext.getCheckpointDir()


class Scratch:
    """Intermediate tables of one run, written below the shared folder. A lost
    executor loses none of them, and they cut the lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
        self.n = 0

    def save(self, df: DataFrame, parts: int | None = None) -> DataFrame:
        """Write and read again; ``parts`` bounds the number of files of a
        result whose rows cost little to make."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        (df.coalesce(parts) if parts else df).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column, without a copy. Null
    texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer row is a range of
    its own. Bounds the working arrays of numpy code, not what is processed."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def dense_counts(df: DataFrame, count: Callable[[pa.RecordBatch], np.ndarray], cells: int) -> np.ndarray:
    """Sum of ``count(batch)`` (indices into ``cells``) over all rows, as an
    array of ``cells`` counters on the driver: its size depends on ``cells``
    only."""
    def run(batches):
        total = np.zeros(cells, np.int64)
        for b in batches:
            total += np.bincount(count(b), minlength=cells)
        yield packed(total)
    return unpacked(df.mapInArrow(run, PACKED), cells)


PACKED = "piece int, counts binary"
PIECE = 1 << 16


def packed(total: np.ndarray) -> pa.RecordBatch:
    pieces = range(0, len(total), PIECE)
    return pa.RecordBatch.from_arrays([pa.array([p // PIECE for p in pieces], pa.int32()), pa.array([_pack(total[p: p + PIECE]) for p in pieces], pa.binary())], ["piece", "counts"])


def _pack(v: np.ndarray) -> bytes:
    wide = v.max(initial=0) >> 31
    return zlib.compress((b"8" if wide else b"4") + v.astype(np.int64 if wide else np.int32).tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    raw = zlib.decompress(b)
    return np.frombuffer(raw[1:], np.int64 if raw[:1] == b"8" else np.int32).astype(np.int64)


def _sum(batches):
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for p, c in zip(b.column("piece").to_pylist(), b.column("counts").to_pylist()):
            sums[p] = sums[p] + _unpack(c) if p in sums else _unpack(c)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_pack(v) for v in sums.values()], pa.binary())], ["piece", "counts"])


def unpacked(pieces: DataFrame, cells: int) -> np.ndarray:
    """Sum of packed counters: 32 tasks add up what all others sent, each with
    one total in memory, and one adds up theirs."""
    done = pieces.repartition(32).mapInArrow(_sum, PACKED).repartition(1).mapInArrow(_sum, PACKED)
    total = np.zeros(cells, np.int64)
    for r in done.collect():  # cells / PIECE pieces
        v = _unpack(r["counts"])
        total[r["piece"] * PIECE: r["piece"] * PIECE + len(v)] += v
    return total
