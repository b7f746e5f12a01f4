"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import shared_dir

#: Words are runs of anything but these six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder name below the folder that all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/tidewake-{tag}-{uuid.uuid4().hex}"


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, tag: str, schema: StructType | None = None) -> DataFrame:
    """Written once to the shared folder and read again (as ``schema``, if given): cuts lineage and survives lost executors.

    The shuffle files of the job are removed as soon as its result is stored.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(schema or df.schema).parquet(path)


def mix64(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session set to hand Arrow batches of a bounded size (not row count) to Python."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df


def release() -> None:
    """Gives memory that a worker has freed back to the machine: workers live on after a task and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` over batches of a bounded size; what the task has freed is released at its end."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return in_batches(df).mapInArrow(whole, schema)


def extended(schema, **columns: str) -> str:
    """DDL of ``schema`` with columns added or replaced."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name not in columns)
    return own + "".join(f", {k} {v}" for k, v in columns.items())


def fresh_name(columns, name: str) -> str:
    """``name``, made longer until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def row_slices(batches, column: str, limit: int = 4 << 20):
    """Record batches cut into runs of rows whose ``column`` (text or list) has about ``limit`` bytes or items; no row is split."""
    for b in batches:
        col = b.column(column)
        sizes = pc.list_value_length(col) if pa.types.is_list(col.type) else pc.binary_length(col)
        ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right"))
            stop = max(start + 1, stop)
            yield b.slice(start, stop - start)
            start = stop
