"""Block evaluation with drift judgement as one plan, for a caller's predictions or for a stored run."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulake.models import REGISTRY
from emulake.models.base import Model
from emulake.operators import drift
from emulake.operators.scale import Scaler, original_units
from emulake.plans.tuning import scored_long
from emulake.sources import artifacts


def evaluate_blocks(
    df: DataFrame, row_idx: str, size: int, ranges: DataFrame, predict: Callable[[DataFrame], DataFrame], reference: DataFrame,
    output: str, first: int = 0, max_blocks: int | None = None, per_model_reference: bool = False,
) -> DataFrame:
    """One row per (block, model, output): accuracy, range counts and drift triggers of the block.

    ``predict`` turns the block rows into ``(block, model, output, y_true, y_pred)``.
    """
    blocks = drift.with_blocks(df, row_idx, size, first, max_blocks)
    report = drift.in_range_report(drift.block_extremes(blocks, ranges), ranges)
    metrics = drift.block_metrics(predict(blocks))
    judged = drift.drift_policy(report, metrics, reference, output, per_model_reference=per_model_reference)
    return metrics.join(judged, "block")


@dataclass
class StoredRun:
    """What ``run_workflow`` left in its ``output_dir``."""

    path: str
    models: dict[str, Model]
    inputs: list[str]
    outputs: list[str]
    input_scaler: Scaler | None
    output_scaler: Scaler | None
    reference: DataFrame
    ranges: DataFrame | None

    def scaled(self, df: DataFrame) -> DataFrame:
        """The rows in the space that the models see."""
        for s in (self.input_scaler, self.output_scaler):
            df = s.transform(df) if s else df
        return df

    def predict(self, blocks: DataFrame) -> DataFrame:
        """(block, model, output, y_true, y_pred) of scaled rows, in original units."""
        out = None
        for label, model in self.models.items():
            one = scored_long(model, blocks, ["block"]).withColumn("model", F.lit(label))
            out = one if out is None else out.unionByName(one)
        return original_units(out, self.output_scaler)


def stored(read: Callable[[str], DataFrame], path: str) -> DataFrame | None:
    """The table at ``path``, or None where there is none."""
    try:
        return read(path)
    except Exception as exc:  # noqa: BLE001 - only an absent path is expected
        if "PATH_NOT_FOUND" in str(exc):
            return None
        raise


def stored_scalers(spark: SparkSession, run: str) -> tuple[Scaler | None, Scaler | None]:
    """Scalers of the inputs and outputs; None for a side that was not scaled."""
    found = [stored(spark.read.parquet, os.path.join(run, "scalers", name)) for name in ("inputs", "outputs")]
    return tuple(Scaler.from_frame(f) if f is not None else None for f in found)


def load_run(spark: SparkSession, path: str) -> StoredRun:
    """Models, scalers, training metrics and training ranges of a stored run."""
    cards = spark.read.json(os.path.join(path, "model_cards")).collect()  # one row per model
    models = {c["model"]: REGISTRY.load(spark, os.path.join(path, "models", c["model"])) for c in cards}
    scores = [(c["model"], i, json.loads(c["metrics"]).get("train", {})) for i, c in enumerate(cards)]
    reference = spark.createDataFrame([(m, i, t.get("r2"), t.get("rmse")) for m, i, t in scores], "model string, ord int, r2 double, rmse double")
    ranges = stored(spark.read.schema(drift.RANGE_SCHEMA).json, os.path.join(path, "train_ranges"))
    return StoredRun(path, models, cards[0]["inputs"], cards[0]["outputs"], *stored_scalers(spark, path), reference, ranges)


def evaluate_run(spark: SparkSession, path: str, df: DataFrame, row_idx: str, size: int, output: str | None = None, key: list[str] | None = None,
                 first: int = 0, max_blocks: int | None = None, per_model_reference: bool = False) -> DataFrame:
    """Judge the blocks of ``df`` (original units) by a stored run; ``output`` is its first one if not given.

    Where the run has no stored ranges, they are rebuilt from the rows of ``df`` that it was trained on, found by ``key``
    in its stored training predictions.
    """
    run = load_run(spark, path)
    rows, ranges = run.scaled(df), run.ranges
    if ranges is None:
        if not key:
            raise ValueError("the run has no stored ranges; give the key columns to rebuild them")
        seen = artifacts.read_predictions(spark, os.path.join(path, "predictions"), splits=["train"])
        keyed = rows.withColumn("row_key", F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
        ranges = drift.ranges_from_predictions(seen, keyed, "row_key", run.inputs, run.outputs)
    return evaluate_blocks(rows, row_idx, size, ranges, run.predict, run.reference, output or run.outputs[0], first, max_blocks, per_model_reference)
