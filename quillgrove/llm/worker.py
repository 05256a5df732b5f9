"""What a Python worker keeps between tasks.

Spark reuses its Python workers from stage to stage.  A worker keeps the cache of
one operator only: asking for another's drops it, so a pipeline's stages don't
add up in an executor's memory.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import SparkSession

V = TypeVar("V")
_held: dict[str, object] = {}
#: Bytes of an Arrow batch on its way to Python, about; a longer row is a batch of its own.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of texts that stay small beside an executor's memory, unless the session asks for smaller ones."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).removesuffix("b")
    if not now.isdecimal() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def held(name: str, make: Callable[[], V]) -> V:
    """The worker's cache of this name, made on first use; any other is dropped."""
    if name not in _held:
        release()
        _held[name] = make()
    return _held[name]


def release() -> None:
    """Drop whatever the worker holds and give free memory back: for tasks that keep nothing."""
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library is glibc
    if trim:
        trim(0)
