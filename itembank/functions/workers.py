"""Python workers."""

from __future__ import annotations

import os
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession


def ready(spark: SparkSession) -> None:
    """Let workers import this package from where the driver has it, unless it was shipped to them."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def flat(lists: pa.Array) -> pa.Array:
    """The values of all lists. Spark sends arrays without rows without their offsets, which pyarrow's own
    ``flatten`` and ``nbytes`` read none the less and may crash by; here such arrays are left alone."""
    values = lists.flatten() if len(lists) else []
    return values if len(values) else pa.array([], lists.type.value_type)


def bytes_of(x: pa.Array) -> int:
    """Bytes that an array's rows take, its lists' values included."""
    if not len(x):
        return 0
    if pa.types.is_list(x.type):
        return 4 * len(x) + bytes_of(flat(x))
    return sum(map(bytes_of, x.flatten())) if pa.types.is_struct(x.type) else x.nbytes


def slices(batches, rows: int = 64, most_bytes: int = 1 << 20):
    """Arrow batches in slices of at most ``rows`` rows and, unless one row has more, ``most_bytes``, so that
    what a worker makes of a slice stays small, however many rows Spark puts into a batch."""
    for b in batches:
        todo = [(i, min(rows, b.num_rows - i)) for i in range(0, b.num_rows, rows)][::-1]
        while todo:
            at, n = todo.pop()
            part = b.slice(at, n)
            if n > 1 and sum(map(bytes_of, part.columns)) > most_bytes:
                todo += [(at + n // 2, n - n // 2), (at, n // 2)]
            else:
                yield part
