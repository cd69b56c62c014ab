"""Arrow batches of few rows and bytes: what a task holds in Python does not grow with the table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_BYTES = "4m"
#: As Python objects, rows take many times what they take as Arrow.
ROWS, BYTES = 256, 1 << 20


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most ``rows`` rows and, by their mean, ``most`` bytes; one row at least."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * most // max(batch.nbytes, 1)))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


def mapped(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` on slices; ``work`` yields what it makes of one before it takes the next.

    Spark counts rows unless told otherwise. The bound is a setting of the session, which keeps it.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(slices(batches))

    return df.mapInArrow(run, schema)
