"""What the operators share: written tables, blocks of whole texts, ordered parts."""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from shelfline.sources.scratch import fresh_path

CHECKOUT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Texts are worked on in blocks of about so many bytes and of so many texts, however large a batch is.
BLOCK_BYTES, BLOCK_TEXTS = 1 << 19, 2048


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import the package from its checkout.

    A cluster gets it by ``--py-files`` or has it installed.
    """
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if CHECKOUT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), CHECKOUT])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Writes a table into the shared folder and reads it from there.

    Cuts lineage: an executor lost later costs no earlier stage.
    """
    path = fresh_path(df.sparkSession, label)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def widened(df: DataFrame, **kinds: str) -> StructType:
    """The frame's schema and more fields, given by name and type."""
    return StructType([*df.schema.fields, *(StructField(name, StructType.fromDDL(f"x {kind}")[0].dataType) for name, kind in kinds.items())])


class Block(NamedTuple):
    """Consecutive texts of a batch: ``data`` holds their bytes end to end."""

    first: int  # row of the batch
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than texts

    def __len__(self) -> int:
        return len(self.offsets) - 1


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column in blocks of whole texts, of ``size`` bytes (or one longer text) and ``BLOCK_TEXTS`` texts at most."""
    if not len(column):
        return
    data, offsets = utf8(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), first + BLOCK_TEXTS, n)
        yield Block(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def binaries(chunks: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column: value i has the next ``counts[i]`` items of ``chunks``."""
    width = chunks.dtype.itemsize
    at = np.concatenate(([0], np.cumsum(counts))) * width
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(counts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(chunks))]
    ).cast(pa.binary())


def n_parts(spark: SparkSession) -> int:
    """Ordered parts: four for each shuffle partition the session is sized for."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def part_bounds(df: DataFrame, key: str, parts: int) -> np.ndarray:
    """Upper bounds of ``parts - 1`` ranges of an integer key with about as many rows each.

    The driver gets this many numbers, whatever the table's size.
    """
    if parts < 2:
        return np.zeros(0, np.int64)
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(key, shares, max(10_000, 20 * parts)).alias("q")).first()["q"]
    return np.unique(np.array(found or [], np.int64))


def part_of(keys: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """Part of each key: equal keys share one; null goes first, to part 0."""
    low = np.iinfo(np.int64).min
    return np.searchsorted(bounds, pc.fill_null(keys, low).to_numpy(zero_copy_only=False), "left").astype(np.int32)
