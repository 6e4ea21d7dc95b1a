"""The size of the batches in which texts reach Python, and what workers keep afterwards."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
SIZE = "8m"


def in_small_batches(docs: DataFrame) -> DataFrame:
    """The same rows; from now on the session hands Python 8 MB at a time.

    The default of 64 MB is held several times over by the JVM and by Python, for
    each task at once, which is too much for small executors.
    """
    docs.sparkSession.conf.set(SETTING, SIZE)
    return docs


def slices(batch: pa.RecordBatch, size: int, rows: int = 1 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of about ``size`` bytes of a column, and of at most ``rows`` rows."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        to = max(at + 1, min(to, at + rows))
        yield batch.slice(at, to - at)
        at = to


def tidy() -> None:
    """Gives freed memory back to the system; a worker that waits for its next task would hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidied(work: Callable) -> Callable:
    """A task's function that ends with ``tidy``; for functions on batches, on groups and on pairs of groups."""

    def finish(out):
        if isinstance(out, Iterator):
            return _to_the_end(out)
        tidy()
        return out

    if work.__code__.co_argcount == 2:  # Spark looks at the number of arguments
        return lambda left, right: finish(work(left, right))
    return lambda batches: finish(work(batches))


def _to_the_end(batches: Iterator) -> Iterator:
    yield from batches
    tidy()
