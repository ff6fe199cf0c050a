"""Session defaults, the shared scratch folder, and small-table helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "emulake", **conf: str) -> SparkSession:
    """A session with the engine's defaults. On a cluster leave ``master`` unset."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; a new local one only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    path = tempfile.mkdtemp(prefix="emulake-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder for a table another job will read."""
    return os.path.join(shared_dir(spark), f"{tag}-{uuid.uuid4().hex[:12]}")


OPEN_FILES = 12  # files a task writes side by side
OPEN_BLOCK = 32 << 20  # bytes a Parquet file among them holds back
OPEN_FILES_CONF = "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def open_files(spark: SparkSession) -> Iterator[None]:
    """Inside, a task that writes to few partition folders keeps a file open in each instead of sorting, and spilling, all its rows
    by folder first. Where there are more folders, Spark sorts the rows from then on."""
    before = spark.conf.get(OPEN_FILES_CONF)
    spark.conf.set(OPEN_FILES_CONF, str(max(int(before), OPEN_FILES)))
    try:
        yield
    finally:
        spark.conf.set(OPEN_FILES_CONF, before)


def materialize(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    if partition_by:
        with open_files(spark):
            df.write.option("parquet.block.size", OPEN_BLOCK).partitionBy(*partition_by).parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SMALL_ROWS = 5_000_000


def spread_small(df: DataFrame, n_rows: int) -> DataFrame:
    """Give a small table one partition per core before iterative work. Larger tables already have many
    splits and are left alone, so the shuffle this may cost is bounded."""
    if n_rows > SMALL_ROWS:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def bounded(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Broadcast a summary only after seeing that it has at most ``max_rows`` rows.

    Within the bound the rows come back as a local table with a broadcast hint, so the job that made
    them is not repeated. Beyond it the frame is returned untouched and Spark shuffles the join.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def join_on(left: DataFrame, right: DataFrame, cols: list[str], how: str = "left") -> DataFrame:
    """Equi-join that also matches NULL keys and keeps the left copy of the key columns.

    The key is one struct, whose comparison treats NULL fields as equal; being a plain equality it hashes,
    broadcasts and splits skewed partitions like any other join.
    """
    if not cols:
        raise ValueError("join_on needs key columns")
    key = F.struct(*cols)
    rest = [c for c in right.columns if c not in cols]
    return left.withColumn("__k", key).join(right.select(key.alias("__k"), *rest), "__k", how).drop("__k")
