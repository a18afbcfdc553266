"""Shared handling of input frames."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame without the columns an operator is about to add, whatever their case."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def adding(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    """The frame's schema with further nullable fields."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in fields)])


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidied(run: Run) -> Run:
    """A function for mapInArrow after whose task the worker gives free memory back to the system.

    Workers are used again by other stages; what allocators keep would add up over a pipeline.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # no glibc
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return whole
