"""Small helpers shared by the operators: stored tables, worker-long values, sums of blocks, document keys."""

from __future__ import annotations

import math
import sys
import types
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emulake.session import new_path

#: Rows of an Arrow batch that are held as Python objects at a time.
SLICE_ROWS = 500
#: Rows of documents in an Arrow batch. JVM and worker each hold a batch whole, the JVM outside its heap.
BATCH_ROWS = 1000
BATCH_ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def store(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python workers ``BATCH_ROWS`` at a time, unless the session has a number of its own.

    Spark takes the number when a table is written, after its operator has returned; so it is set, not only for a while.
    """
    if spark.conf.get(BATCH_ROWS_CONF, None) is None:
        spark.conf.set(BATCH_ROWS_CONF, str(BATCH_ROWS))


@contextmanager
def same_batches(spark: SparkSession) -> Iterator[None]:
    """What is inside may call ``small_batches``; afterwards the session is as before."""
    before = spark.conf.get(BATCH_ROWS_CONF, None)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_ROWS_CONF)


def worker_value(kind: str, key: tuple, make: Callable[[], Any]) -> Any:
    """A value made once per Python worker process and kept across its tasks, until another kind or key is asked for.

    The package travels to the executors by value, so its own modules are new in each task; a module object made
    in the worker is not.
    """
    home = sys.modules.setdefault("_emulake_llm_worker", types.ModuleType("_emulake_llm_worker"))
    values = home.__dict__.setdefault("values", {})
    if kind not in values or values[kind][0] != key:
        values.clear()
        values[kind] = key, make()
    return values[kind][1]


def forget_values() -> None:
    """Frees what ``worker_value`` keeps in this worker process; for tasks that use none, as workers serve one operator after the other."""
    if home := sys.modules.get("_emulake_llm_worker"):
        home.__dict__.get("values", {}).clear()


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows, without the empty ones."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The text column as strings; NULL is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    name = stem
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def typed(df: DataFrame, *names: str) -> str:
    """DDL of the named columns, for the schema of mapInArrow."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def fold(key: str, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo ``modulus``; NULL counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def content_key(key: str = "doc_id", text: str = "text") -> Column:
    """(no id, id, text hash): orders rows, NULL ids last; only rows that are equal in id and text share it."""
    return F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text"))


def summed(df: DataFrame, block: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], scans: int) -> np.ndarray | None:
    """Sum of ``block(batches of a task)``, in rounds, so that neither a task nor the driver adds up more than about
    the square root of the number of tasks. ``scans`` is that number. The block's size depends on a model only."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = block(batches)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"b": [np.ascontiguousarray(total, dtype=np.float64).tobytes()]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in slices(batches, 1):
            part = np.frombuffer(batch.column(0)[0].as_py(), dtype=np.float64)
            total = part.copy() if total is None else np.add(total, part, out=total)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"b": [total.tobytes()]})

    parts, left = df.mapInArrow(first, "b binary"), scans
    while left > 8:
        left = math.ceil(math.sqrt(left))
        parts = parts.repartition(left).mapInArrow(merge, "b binary")
    got = parts.collect()
    return np.sum([np.frombuffer(r.b, dtype=np.float64) for r in got], axis=0) if got else None


def scan_tasks(df: DataFrame) -> int:
    return max(1, df.rdd.getNumPartitions())
