"""Choosing a reader, case-file discovery, JSON-line logs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulake.operators.campaign import CASE_PREFIX, natural, parse_paths
from emulake.operators.rank import sample_exact
from emulake.sources.listing import FileListing
from emulake.sources.npy import StackedNpy

# Schemas of campaign snapshots and of epoch logs.
SNAPSHOT_SCHEMA = "case_id bigint, run string, eq string, path string, status string, started_ts bigint, finished_ts bigint"
EPOCH_SCHEMA = "epoch bigint, train_loss double, train_rmse_scaled double, train_rows_this_epoch bigint, val_loss double, val_rmse_scaled double, hpo_trial bigint"
FORMATS = {"parquet": "parquet", "pq": "parquet", "csv": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "npy": "npy", "stacked": "npy"}


def _names_in(spark: SparkSession, path: str) -> list[str] | None:
    """File names directly in a folder of any store that Spark reads; None if there is no such folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(hadoop) or not store.getFileStatus(hadoop).isDirectory():
        return None
    return [s.getPath().getName() for s in store.listStatus(hadoop)]


def pick_format(path: str, fmt: str = "auto", spark: SparkSession | None = None) -> str:
    """Explicit format, else by suffix, else a directory of stacked arrays or of parquet parts."""
    name = (fmt or "auto").lower()
    if name == "auto":
        suffix = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
        if suffix:
            name = suffix
        elif (entries := _names_in(spark or SparkSession.active(), path)) is not None:
            name = "npy" if any(e.endswith(".npy") for e in entries) else "parquet"
    if name not in FORMATS:
        raise ValueError(f"unsupported dataset format {name!r} for {path}")
    return FORMATS[name]


def load_table(spark: SparkSession, path: str, fmt: str = "auto", schema: str | None = None, sample: int | None = None,
               key: list[str] | None = None, seed: int = 42, **options) -> DataFrame:
    """One reader for every supported format; ``sample`` keeps an exact seeded number of rows by ``key``."""
    kind = pick_format(path, fmt, spark)
    reader = spark.read.options(**options)
    if schema:
        reader = reader.schema(schema)
    if kind == "parquet":
        df = reader.parquet(path)
    elif kind == "csv":
        reader = reader.option("header", True)
        df = (reader if schema else reader.option("inferSchema", True)).csv(path)
    elif kind == "json":
        df = reader.option("multiLine", True).json(path)
    elif kind == "jsonl":
        df = reader.json(path)
    else:
        df = load_npy(spark, folder=path, **options)
        key = key or ["row_idx"]
    if sample is not None:
        if not key:
            raise ValueError("sampling needs key columns")
        df = sample_exact(df, sample, key, seed)
    return df


def load_npy(spark: SparkSession, data: str | None = None, target: str | None = None, folder: str | None = None, set_name: str = "set1",
             row_range: tuple[int, int] | None = None, input_names: list[str] | None = None, output_names: list[str] | None = None,
             rows_per_partition: int = 1_000_000) -> DataFrame:
    """Stacked arrays by explicit paths or by set name, optionally a row range."""
    spark.dataSource.register(StackedNpy)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # row_idx comparisons become row ranges
    r = spark.read.format("stacked_npy").option("rows_per_partition", rows_per_partition)
    r = r.option("data", data) if data else r.option("dir", folder).option("set_name", set_name)
    if data and target:
        r = r.option("target", target)
    if row_range:
        r = r.option("start", row_range[0]).option("stop", row_range[1])
    if input_names:
        r = r.option("input_names", ",".join(input_names))
    if output_names:
        r = r.option("output_names", ",".join(output_names))
    return r.load()


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, mtime) of every file in the folders below ``folder``, empty marker files included."""
    spark.dataSource.register(FileListing)
    return spark.read.format("file_listing").load(folder)


def find_case_files(spark: SparkSession, folder: str, leaf: str, first_n: int | None = None, prefix: str = CASE_PREFIX) -> DataFrame:
    """(run, case, path) of every case's file, in natural order when ``first_n`` limits them."""
    files = spark.read.format("binaryFile").load(f"{folder}/run*/{prefix}*/{leaf}").select("path")
    found = parse_paths(files, prefix=prefix).select("run", "case", "path")
    if first_n is not None:
        found = found.orderBy(natural(F.col("run")), natural(F.col("case")), "path").limit(first_n)
    return found


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Campaign snapshot lines; blank lines are skipped by the reader."""
    return spark.read.schema(SNAPSHOT_SCHEMA).json(path).where("case_id IS NOT NULL")


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EPOCH_SCHEMA).json(path).where("epoch IS NOT NULL")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(run, case, line_no, line) of small input files; each file is read whole, so line numbers are real."""
    text = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("path"))
    parts = parse_paths(text).select("run", "case", "value")
    return parts.select("run", "case", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
