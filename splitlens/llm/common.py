"""Shared pieces: tables written to the cluster's shared folder, slots, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from splitlens.session import shared_dir

LONG_MAX = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage with
    files that outlive a lost executor, and gives later joins plain exchanges that adaptive
    execution can split."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Queries that run inside the block hand Python at most ``most`` rows at once, so that the batches of whole texts held by a
    task on both sides stay small.  The session's own setting, if lower, holds, and is put back at the end."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was, now = spark.conf.get(key, None), int(spark.conf.get(key))
    if now <= 0 or now > most:
        spark.conf.set(key, str(most))
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


def slots(spark: SparkSession) -> int:
    """Number of hash slots for packed exchanges: grows with the shuffle partitions, which the
    cluster sizes by its input."""
    return 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


class Shipped:
    """A broadcast of any object of this package, pickled by value; for data of a bounded size."""

    def __init__(self, spark: SparkSession, value):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def __getstate__(self):
        return {"_sent": self._sent}

    @property
    def value(self):
        if not hasattr(self, "_value"):
            self._value = cloudpickle.loads(self._sent.value)
        return self._value


def scalar(df: DataFrame):
    """The single value of a one-row, one-column frame (None when there is no row)."""
    row = df.first()
    return None if row is None else row[0]


def binary_array(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Arrow binary array over the rows ``data[bounds[i]:bounds[i + 1]]`` of a packed array."""
    raw = np.ascontiguousarray(data)
    off = (np.asarray(bounds, dtype=np.int64) * raw.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(raw)])


def unpack(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """Concatenate the binary values of ``column`` into one structured array."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out = []
    for part in parts:
        if len(part) == 0:
            continue
        wide = np.int64 if pa.types.is_large_binary(part.type) else np.int32
        off = np.frombuffer(part.buffers()[1], dtype=wide, count=part.offset + len(part) + 1)
        lo, hi = int(off[part.offset]), int(off[part.offset + len(part)])
        if hi > lo:
            out.append(np.frombuffer(part.buffers()[2], dtype=np.uint8, count=hi)[lo:hi])
    if not out:
        return np.zeros(0, dtype=dtype)
    return np.concatenate(out).view(dtype)


def pack_by_slot(rows: np.ndarray, slot: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Group packed ``rows`` by ``slot``: (slot numbers, one binary value per slot)."""
    order = np.argsort(slot, kind="stable")
    sorted_slot = slot[order]
    first = np.flatnonzero(np.r_[True, sorted_slot[1:] != sorted_slot[:-1]]) if len(slot) else np.zeros(0, np.int64)
    bounds = np.r_[first, len(slot)]
    return pa.array(sorted_slot[first].astype(np.int32)), binary_array(rows[order], bounds)


def runs(values: np.ndarray) -> np.ndarray:
    """Boundaries of the runs of equal neighbours: starts, then the length."""
    if len(values) == 0:
        return np.zeros(1, dtype=np.int64)
    return np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)]
