"""Training ranges, block checks and the drift policy.

A block is a run of consecutive rows (or a stream window). Everything per block comes from mergeable
aggregates, so blocks of any size and number are judged in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emulake.functions.numeric import known
from emulake.operators.metrics import output_metrics
from emulake.operators.scale import column_stats

# The accuracy drop that counts as drift, and the length of the listed inputs.
R2_DROP = 0.1
RMSE_RATIO = 1.5
LISTED_INPUTS = 20
TOP_INPUTS = 6
RANGE_SCHEMA = "column string, role string, ord bigint, lo double, hi double"


def training_ranges(train: DataFrame, inputs: Sequence[str], outputs: Sequence[str]) -> DataFrame:
    """(column, role, ord, lo, hi) in the space the model sees; one row per role column."""
    got = column_stats(train, [*inputs, *outputs], {"lo": F.min, "hi": F.max})
    rows = [(c, "input", i, got[c]["lo"], got[c]["hi"]) for i, c in enumerate(inputs)]
    rows += [(c, "output", i, got[c]["lo"], got[c]["hi"]) for i, c in enumerate(outputs)]
    return train.sparkSession.createDataFrame(rows, RANGE_SCHEMA)


def ranges_from_predictions(train_pred: DataFrame, data: DataFrame, key: str, inputs: Sequence[str], outputs: Sequence[str]) -> DataFrame:
    """Rebuild ranges from the stored training predictions by joining their keys to the data."""
    return training_ranges(data.join(train_pred.select(key), key, "left_semi"), inputs, outputs)


def with_blocks(df: DataFrame, row_idx: str, size: int, first: int = 0, max_blocks: int | None = None) -> DataFrame:
    """Rows with their fixed-size ``block`` number, from block ``first`` on; the last block may be short.

    The row filter is a range on ``row_idx``, so file statistics prune the scan.
    """
    rows = df.where(F.col(row_idx) >= first * size)
    if max_blocks is not None:
        rows = rows.where(F.col(row_idx) < (first + max_blocks) * size)
    return rows.withColumn("block", F.floor(F.col(row_idx) / size).cast("bigint"))


def block_extremes(df: DataFrame, ranges: DataFrame, by: Sequence[str] = ("block",)) -> DataFrame:
    """Long (by..., column, lo, hi) minima and maxima of the role columns per block."""
    cols = [r["column"] for r in ranges.select("column").collect()]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), known(F.col(c).cast("double")).alias("v")) for c in cols])
    return df.select(*by, F.inline(cells)).groupBy(*by, "column").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def out_of_range(extremes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Block columns that leave the training range (strictly), with both ranges.

    ``ranges`` holds one row per role column, so the schema bounds what is broadcast.
    """
    t = ranges.select("column", "role", "ord", F.col("lo").alias("train_lo"), F.col("hi").alias("train_hi"))
    j = extremes.join(F.broadcast(t), "column")
    return j.where((F.col("lo") < F.col("train_lo")) | (F.col("hi") > F.col("train_hi")))


def in_range_report(extremes: DataFrame, ranges: DataFrame, by: Sequence[str] = ("block",)) -> DataFrame:
    """Per block: counts and names of columns outside the training range. Lists are bounded by the schema."""
    t = ranges.select("column", "role", "ord", F.col("lo").alias("train_lo"), F.col("hi").alias("train_hi"))
    j = extremes.join(F.broadcast(t), "column")
    bad = F.coalesce((F.col("lo") < F.col("train_lo")) | (F.col("hi") > F.col("train_hi")), F.lit(False))
    j = j.withColumn("bad", bad)

    def names(role: str) -> Column:
        hit = F.when((F.col("role") == role) & F.col("bad"), F.struct("ord", "column"))
        return F.transform(F.array_sort(F.collect_list(hit)), lambda s: s["column"])

    g = j.groupBy(*by).agg(
        F.count_if((F.col("role") == "input") & F.col("bad")).alias("n_inputs_out"),
        F.count_if((F.col("role") == "output") & F.col("bad")).alias("n_outputs_out"),
        F.slice(names("input"), 1, LISTED_INPUTS).alias("inputs_out"), names("output").alias("outputs_out"))
    return g.withColumns({"inputs_in_range": F.col("n_inputs_out") == 0, "outputs_in_range": F.col("n_outputs_out") == 0})


def block_metrics(pred: DataFrame, by: Sequence[str] = ("block", "model", "output")) -> DataFrame:
    return output_metrics(pred, by).select(*by, "n", "r2", "rmse", "mae", "mean_error", "std_error")


def drift_policy(report: DataFrame, metrics: DataFrame, reference: DataFrame, output: str, by: Sequence[str] = ("block",),
                 r2_drop: float = R2_DROP, rmse_ratio: float = RMSE_RATIO, per_model_reference: bool = False, fallback: str = "output_0") -> DataFrame:
    """Triggers per block: input_ood, output_ood, accuracy_drop, and the flag they imply.

    ``metrics`` has one row per (block, model, output); ``reference`` has (model, ord, r2, rmse) of the
    training split. By default the first model that has training metrics sets the bar for every model;
    ``per_model_reference`` compares each model with itself. A model without metrics of ``output`` is judged by
    its metrics of ``fallback``.
    """
    named = F.max((F.col("output") == output).cast("int")).over(Window.partitionBy("model"))
    m = metrics.withColumn("__named", named).where((F.col("output") == output) | (F.col("__named") == 0) & (F.col("output") == fallback)).drop("__named")
    if per_model_reference:
        ref = reference.select("model", F.col("r2").alias("ref_r2"), F.col("rmse").alias("ref_rmse"))
        j = m.join(ref, "model", "left")
    else:
        first = reference.where("r2 IS NOT NULL OR rmse IS NOT NULL").orderBy("ord", "model").limit(1).first()
        r2, rmse = (first["r2"], first["rmse"]) if first else (None, None)
        j = m.withColumns({"ref_r2": F.lit(r2).cast("double"), "ref_rmse": F.lit(rmse).cast("double")})
    fell = F.coalesce(F.col("r2") < F.col("ref_r2") - r2_drop, F.lit(False))
    grew = F.coalesce((F.col("ref_rmse") > 0) & (F.col("rmse") > F.col("ref_rmse") * rmse_ratio), F.lit(False))
    drop = j.groupBy(*by).agg(F.bool_or(fell | grew).alias("dropped"))
    k = report.join(drop, list(by), "left")
    triggers = F.array_compact(F.array(
        F.when(~F.col("inputs_in_range"), F.lit("input_ood")),
        F.when(~F.col("outputs_in_range"), F.lit("output_ood")),
        F.when(F.coalesce(F.col("dropped"), F.lit(False)), F.lit("accuracy_drop"))))
    return k.withColumn("triggers", triggers).withColumn("drift_detected", F.size("triggers") > 0).drop("dropped")


def drift_summary(judged: DataFrame) -> DataFrame:
    """One row: blocks evaluated, blocks with drift, overall warning."""
    return judged.agg(
        F.count(F.lit(1)).alias("n_blocks"), F.count_if("drift_detected").alias("n_drifted"),
        F.coalesce(F.bool_or("drift_detected"), F.lit(False)).alias("drift_warning"))


def r2_degradation(metrics: DataFrame, reference_r2: float, by: Sequence[str] = ("block", "model", "output")) -> DataFrame:
    """Training R2 minus block R2."""
    return metrics.select(*by, (F.lit(reference_r2) - F.col("r2")).alias("r2_loss"), "mae")


def ood_evolution(extremes: DataFrame, ranges: DataFrame, by: Sequence[str] = ("block",), top: int = TOP_INPUTS) -> DataFrame:
    """Block extremes of the most often out-of-range inputs, scaled so the training range is 0..1.

    Values are NULL in blocks where that input is in range.
    """
    t = F.broadcast(ranges.where("role = 'input'").select("column", "ord", F.col("lo").alias("train_lo"), F.col("hi").alias("train_hi")))
    j = extremes.join(t, "column")
    bad = F.coalesce((F.col("lo") < F.col("train_lo")) | (F.col("hi") > F.col("train_hi")), F.lit(False))
    span = F.when(F.col("train_hi") == F.col("train_lo"), F.lit(1.0)).otherwise(F.col("train_hi") - F.col("train_lo"))
    rows = j.select(*by, "column", "ord", F.when(bad, (F.col("lo") - F.col("train_lo")) / span).alias("lo_scaled"),
                    F.when(bad, (F.col("hi") - F.col("train_lo")) / span).alias("hi_scaled"))
    chosen = [r["column"] for r in top_ood_inputs(extremes, ranges, top).collect()]
    return rows.where(F.col("column").isin(*chosen) if chosen else F.lit(False)).drop("ord")


def top_ood_inputs(extremes: DataFrame, ranges: DataFrame, top: int = TOP_INPUTS) -> DataFrame:
    """Inputs by the number of blocks in which they leave the range; ties by column order."""
    bad = out_of_range(extremes, ranges).where("role = 'input'")
    return bad.groupBy("column").agg(F.count(F.lit(1)).alias("n_blocks"), F.min("ord").alias("ord")).orderBy(
        F.col("n_blocks").desc(), "ord").limit(top).select("column", "n_blocks")


def ranges_frame(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), RANGE_SCHEMA)
