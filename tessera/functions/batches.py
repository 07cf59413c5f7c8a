"""Arrow batches in small pieces, so that what a Python worker holds depends on neither the table nor the engine's batch size."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes that are turned into Python values at a time.
ROWS, BYTES = 256, 1 << 18
SENT = "spark.sql.execution.arrow.maxRecordsPerBatch"


def pieces(batch: pa.RecordBatch, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of at most ``rows`` rows and ``size`` bytes; a row that is larger comes alone. An empty batch gives none."""
    open_ = [batch.slice(lo, rows) for lo in range(0, batch.num_rows, rows)][::-1]
    while open_:
        part = open_.pop()
        if part.num_rows > 1 and part.nbytes > size:
            half = part.num_rows // 2
            open_ += [part.slice(half), part.slice(0, half)]
        else:
            yield part


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2 * ROWS) -> Iterator[None]:
    """While it lasts, the engine sends its workers batches of at most ``rows`` rows; a worker holds two of them."""
    before = spark.conf.get(SENT)
    if not 0 < int(before) <= rows:
        spark.conf.set(SENT, str(rows))
    try:
        yield
    finally:
        spark.conf.set(SENT, before)
