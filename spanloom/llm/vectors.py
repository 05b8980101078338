"""What the operators on embeddings share: which vectors count, and sums over all rows that never meet in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups that partitions' sums are added in before the driver adds those: so many arrays reach it, however many partitions there are.
SLOTS = 32


def usable(rows: DataFrame, key: str, vector: str, zeros: bool = True) -> DataFrame:
    """key, vector of the rows whose vector is not null or empty and holds finite numbers only; without zeros: none that are all 0.

    Vectors of another length than most have (of lengths equally common the smallest counts) can't be compared and take no part.
    """
    entry = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    good = rows.select(F.col(key).alias("_key"), F.col(vector).alias("_vector")).where(F.col("_vector").isNotNull() & (F.size("_vector") > 0) & F.forall("_vector", entry))
    if not zeros:
        good = good.where(F.exists("_vector", lambda x: x != 0))
    lengths = good.groupBy(F.size("_vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return good.where(F.size("_vector") == (lengths[0]["n"] if lengths else 0)).select(F.col("_key").alias(key), F.col("_vector").alias(vector))


def matrix(column: pa.Array, dtype: type = np.float64) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def summed(rows: DataFrame, shape: tuple[int, ...], make: Callable[[pa.RecordBatch], np.ndarray], dtype: type = np.float64) -> np.ndarray:
    """The sum of make(batch), an array of a fixed shape, over all batches: first of each partition, then of SLOTS groups of partitions, then of these. Always added in the order of the partitions."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(shape, dtype), TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                total += make(batch)
        yield pa.RecordBatch.from_pydict({"slot": pa.array([part % SLOTS], pa.int32()), "part": pa.array([part], pa.int32()), "total": pa.array([total.tobytes()], pa.binary())})

    def together(group: pa.Table) -> pa.Table:
        total = np.zeros(shape, dtype)
        for _, one in sorted(zip(group["part"].to_pylist(), group["total"].to_pylist(), strict=True)):
            total += np.frombuffer(one, dtype).reshape(shape)
        return pa.table({"slot": group["slot"][:1], "total": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(partial, "slot int, part int, total binary")
    found = parts.groupBy("slot").applyInArrow(together, "slot int, total binary").collect()  # SLOTS rows at most
    return sum((np.frombuffer(r["total"], dtype).reshape(shape) for r in sorted(found, key=lambda r: r["slot"])), np.zeros(shape, dtype))
