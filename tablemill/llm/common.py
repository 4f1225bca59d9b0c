"""What several operators of this package share."""

from __future__ import annotations

import gc
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F

from tablemill.session import staged, work_path

# Words are runs of anything but ASCII white space; ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def free(names: Sequence[str], wanted: str) -> str:
    """``wanted``, or with underscores behind it until no column has the name in any case."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished phases.

    Spark removes them once the plan that made them is garbage to the driver's JVM,
    which may not collect for an hour; between two heavy phases that is disk held in vain.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of text that go to Python at once, at most; Spark's own bound is 10,000 rows or 64 MB.
BATCH_ROWS = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of this session to some MB of text, on both sides of the pipe.

    A batch is held by the JVM and by the Python worker at once, outside the heap. The setting
    is read when a job starts, so it stays; a smaller one of the session's own is left alone.
    """
    if not 0 < int(spark.conf.get(_BATCH_KEY)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))


def text_bytes(column: str | Column) -> Column:
    """A text as bytes, so that Python gets it without decoding; NULL stays NULL."""
    return (F.col(f"`{column}`") if isinstance(column, str) else column).cast("binary")


class Gathered:
    """Columns of many small results, handed on in batches of a bounded number of rows."""

    def __init__(self, names: Sequence[str], rows: int = 1 << 16):
        self.names, self.most = list(names), rows
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Keep the rows; yields what is full."""
        n = len(columns[0])
        for at in range(0, n, self.most):
            part = tuple(c[at : at + self.most] for c in columns)
            self.parts.append(part)
            self.rows += len(part[0])
            if self.rows >= self.most:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            columns = [pa.array(np.concatenate(c)) for c in zip(*self.parts, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, self.names)
            self.parts, self.rows = [], 0


__all__ = ["Gathered", "WORD", "free", "release", "small_batches", "staged", "text_bytes", "work_path"]
