"""Sum numpy blocks over a DataFrame: per task, then in rounds of merge tasks, then on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulake.models.base import matrix

FAN_IN = 64  # blocks that one merge task adds up on average
LAST = 8  # blocks that the driver adds up at most


def merged(parts: DataFrame, merge: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], tasks: int | None = None) -> DataFrame:
    """``parts``, at most one row per task, brought down to ``LAST`` rows or fewer.

    The number of rounds grows with the logarithm of the number of tasks, so no merge task and no driver sees more
    blocks because the input has more splits. ``tasks`` is counted where it is not given; a table that takes a shuffle
    to make should be stored first.
    """
    left = parts.rdd.getNumPartitions() if tasks is None else tasks
    while left > LAST:
        left = math.ceil(left / FAN_IN)
        parts = parts.repartition(left).mapInPandas(merge, parts.schema)
    return parts


def summed(df: DataFrame, columns: dict[str, Sequence[str]], block: Callable[..., np.ndarray]) -> np.ndarray | None:
    """Total of ``block(**arrays)`` over all Arrow batches; ``columns`` names the matrices handed to it.

    Each task returns one block and rounds of merge tasks add them, so the driver receives ``LAST`` blocks at most.
    The block's size depends on the model, never on the rows.
    """
    packed = df.select(*[F.array(*[F.col(c).cast("double") for c in cols]).alias(name) for name, cols in columns.items()])
    names = list(columns)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = block(**{n: matrix(batch.column(n)) for n in names})
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"b": [np.ascontiguousarray(total, dtype=np.float64).tobytes()]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            for raw in pdf["b"]:
                part = np.frombuffer(raw, dtype=np.float64)
                total = part.copy() if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"b": [total.tobytes()]})

    parts = packed.mapInArrow(per_task, "b binary")
    got = merged(parts, merge).collect()
    if not got:
        return None
    return np.sum([np.frombuffer(r.b, dtype=np.float64) for r in got], axis=0)
