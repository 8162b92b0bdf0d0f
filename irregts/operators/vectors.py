"""Sums of numpy vectors that tasks make, added up in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Vectors that a task adds up.
FAN = 64


def vector_row(values: np.ndarray) -> pa.RecordBatch:
    """One vector as the row that :func:`sum_vectors` takes."""
    return pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary())], names=["values"])


def sum_vectors(vectors: DataFrame, dtype: str, fan: int = FAN) -> np.ndarray | None:
    """The sum of vectors of one length and type (column ``values``: their bytes), one per task of
    a scan.

    One job: tasks add up about ``fan`` vectors each, others theirs, until one is left and
    reaches the driver. None if there are no vectors.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("values"):
                values = np.frombuffer(raw.as_buffer(), dtype)
                total = values.copy() if total is None else np.add(total, values, out=total)
        if total is not None:
            yield vector_row(total)

    rows = vectors.select("values")
    tasks = vectors.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // fan)
        rows = rows.repartition(tasks).mapInArrow(add, "values binary")
    found = rows.collect()  # one row at most
    return np.frombuffer(bytes(found[0]["values"]), dtype) if found else None
