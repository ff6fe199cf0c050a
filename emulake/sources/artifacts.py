"""Prediction, metric and range artifacts as partitioned tables and small JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emulake.functions.arrays import only
from emulake.session import OPEN_BLOCK, open_files

SPLITS = "train|val|test"
PREDICTION_SCHEMA = "row_key string, output string, y_true double, y_pred double, model string, split string"


#: Name of a part file inside a folder that stands for one prediction file, and what precedes that folder's name.
PART, NAMED = r"/part-[^/]*$", "file="


def _stem(path: Column) -> Column:
    """Name without suffixes of a file, or of the folder whose part files stand for it."""
    return F.regexp_extract(F.regexp_replace(path, PART, ""), rf"(?:{NAMED})?([^/=]+?)(\.[A-Za-z]+)*$", 1)


def file_split(path: Column) -> Column:
    """Split named at the end of a prediction file's stem; '' when there is none."""
    return F.regexp_extract(_stem(path), rf"_({SPLITS})$", 1)


def file_model(path: Column) -> Column:
    """Model part of a prediction file's stem."""
    return F.regexp_extract(_stem(path), rf"^(.+)_(?:{SPLITS})$", 1)


def write_predictions(pred: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One dataset for all models and splits, partitioned by both. CSV files are gzip-compressed, as their keys repeat."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown prediction format {fmt!r}")
    names = [c.split()[0] for c in PREDICTION_SCHEMA.split(", ")]
    writer = pred.select(*names).write.mode("overwrite").partitionBy("model", "split")
    with open_files(pred.sparkSession):
        writer.options(header=True, compression="gzip", **{"zlib.compress.level": "BEST_SPEED"}).csv(path) if fmt == "csv" else writer.option("parquet.block.size", OPEN_BLOCK).parquet(path)


def read_predictions(spark: SparkSession, path: str, fmt: str = "parquet", splits: list[str] | None = None) -> DataFrame:
    """Stored predictions in long form; asking for splits prunes their partitions."""
    reader = spark.read.schema(PREDICTION_SCHEMA)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)
    return df.where(F.col("split").isin(*splits)) if splits else df


#: A file, or a folder of part files, whose stem ends so holds uncertainties.
UNCERTAIN = r"_uq\.[A-Za-z]+(/part-[^/]*)?$"


def write_prediction_files(wide: DataFrame, path: str, fmt: str = "parquet", uncertain: bool = False) -> None:
    """Wide predictions (model, split, index, y_true_00.., y_pred_00..) as one named set of part files per model and split.

    A set is a folder ``file=<model>_<split>.<fmt>``, with ``_uq`` before the suffix if ``uncertain``. One job writes them all, every task
    its own part files; Spark's committer makes them visible together, and a task that runs again leaves no second copy. Sets of these
    names that are there are replaced, others stay.
    """
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown prediction format {fmt!r}")
    name = F.concat("model", F.lit("_"), "split", F.lit(f"{'_uq' if uncertain else ''}.{fmt}"))
    writer = wide.withColumn("file", name).drop("model", "split").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file")
    with open_files(wide.sparkSession):
        writer.option("header", True).csv(path) if fmt == "csv" else writer.option("parquet.block.size", OPEN_BLOCK).parquet(path)


def read_prediction_files(spark: SparkSession, path: str, n_outputs: int, fmt: str = "parquet") -> DataFrame:
    """One file, or one folder of part files, per model and split with columns ``index, y_true_00.., y_pred_00..`` to long form.

    Model and split come from the file name, uncertainty files are skipped, outputs are numbered, not sorted.
    """
    names = [f"{kind}_{i:02d}" for kind in ("y_true", "y_pred") for i in range(n_outputs)]
    schema = "index bigint, " + ", ".join(f"{n} double" for n in names)
    reader = spark.read.schema(schema).option("pathGlobFilter", f"*.{fmt}").option("recursiveFileLookup", True)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)
    file = F.col("_metadata.file_path")
    tagged = df.select("*", file.alias("__f")).where(~F.col("__f").rlike(UNCERTAIN))
    cells = F.array(*[F.struct(F.lit(i).alias("output"), F.col(f"y_true_{i:02d}").alias("y_true"), F.col(f"y_pred_{i:02d}").alias("y_pred")) for i in range(n_outputs)])
    return tagged.select(file_model(F.col("__f")).alias("model"), file_split(F.col("__f")).alias("split"), F.col("index").alias("row_key"), F.inline(cells))


def spread_payload(df: DataFrame, key: str, arrays: dict[str, int]) -> DataFrame:
    """Array payloads to ``<name>_00, <name>_01, ...`` columns, as the wide file layout wants.

    An array with more positions than ``arrays`` gives it is an error."""
    cols = [only(a, i, n).alias(f"{a}_{i:02d}") for a, n in arrays.items() for i in range(n)]
    return df.select(key, *cols)


def flatten_metrics(docs: DataFrame, column: str = "json") -> DataFrame:
    """JSON ``{model: {split: {metric: value}}}`` to (name ``model.split.metric``, value), numbers only."""
    parsed = docs.select(F.from_json(column, "map<string,map<string,map<string,string>>>").alias("m"))
    a = parsed.select(F.explode("m").alias("model", "s"))
    b = a.select("model", F.explode("s").alias("split", "v"))
    c = b.select("model", "split", F.explode("v").alias("metric", "text"))
    value = F.col("text").try_cast("double")
    return c.select(F.concat_ws(".", "model", "split", "metric").alias("name"), value.alias("value")).where("value IS NOT NULL")


def metrics_json(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Metric rows (model, split, ...) to one JSON document per model: {split: {metric: value}}."""
    body = F.struct(*[F.col(n) for n in names])
    return metrics.groupBy("model").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", body))))).alias("json"))


def write_small_json(df: DataFrame, path: str) -> None:
    """Summaries, ranges, cards: small tables as JSON lines."""
    df.write.mode("overwrite").json(path)
