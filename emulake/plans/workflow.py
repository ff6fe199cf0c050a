"""The declarative run: load, roles, clean, split, scale, tune, fit, score, measure, store."""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulake.models import REGISTRY, Model
from emulake.models.mlp import MLP
from emulake.operators import drift, metrics, split
from emulake.operators.rank import duplicate_keys, sample_exact
from emulake.operators.roles import dataset_spec
from emulake.operators.scale import Scaler, fit_standard, original_units
from emulake.plans.evaluation import stored_scalers
from emulake.plans.tuning import TuneResult, cross_validate, scored_long, tune
from emulake.session import materialize, spread_small
from emulake.sources import artifacts
from emulake.sources.readers import load_table
from emulake.spec import DatasetSpec, ModelSpec, RunSpec
from emulake.streaming.progress import append_epochs


@dataclass
class RunResult:
    """Everything a run produced; the frames are lazy tables."""

    dataset: DatasetSpec
    data: DataFrame
    input_scaler: Scaler | None
    output_scaler: Scaler | None
    ranges: DataFrame
    models: dict[str, Model] = field(default_factory=dict)
    predictions: DataFrame | None = None
    uncertainty: DataFrame | None = None
    metrics: DataFrame | None = None
    timings: list[tuple] = field(default_factory=list)
    tuning: dict[str, TuneResult] = field(default_factory=dict)
    folds: DataFrame | None = None
    raw: DataFrame | None = None  # the rows of ``data`` in original units


def prepare(df: DataFrame, spec: RunSpec, scalers: tuple[Scaler | None, Scaler | None] | None = None) -> RunResult:
    """Roles, cleaning, split and scaling; the result is stored once and read by every model."""
    roles = dataset_spec(df, spec.metadata, spec.hints, spec.key)
    cols = [*roles.inputs, *roles.outputs]
    typed = df.withColumns({c: F.col(c).cast("double") for c in cols})
    clean = typed.na.drop(subset=cols)
    if spec.check_keys and spec.shuffle and duplicate_keys(clean, spec.key):
        raise ValueError(f"key {spec.key} repeats: split sizes would not be exact")
    if spec.sample:
        clean = sample_exact(clean, spec.sample, spec.key, spec.seed)
    if spec.shuffle:
        plan = split.fit_split(clean, spec.key, spec.test_fraction, spec.val_fraction, spec.seed)
        marked, n = plan.apply(clean), plan.cuts.n
    else:
        marked, n = split.split_tail(clean, spec.row_idx, spec.test_fraction, spec.val_fraction), clean.count()
    marked = materialize(spread_small(marked.select(*dict.fromkeys([*spec.key, *cols, "split"])), n), "split")
    train = marked.where("split = 'train'")
    if scalers is not None:
        x_scaler, y_scaler = scalers
    else:
        x_scaler = fit_standard(train, roles.inputs) if spec.standardize_inputs else None
        y_scaler = fit_standard(train, roles.outputs) if spec.standardize_outputs else None
    data = marked
    for s in (x_scaler, y_scaler):
        data = s.transform(data) if s else data
    ranges = drift.training_ranges(data.where("split = 'train'"), roles.inputs, roles.outputs)
    return RunResult(roles, data, x_scaler, y_scaler, ranges, raw=marked)


def run_workflow(spark: SparkSession, spec: RunSpec | Mapping[str, Any], df: DataFrame | None = None) -> RunResult:
    """Run a specification on a path or on a given table."""
    if not isinstance(spec, RunSpec):
        spec = RunSpec.from_dict(spec)
    if df is None:
        df = load_table(spark, spec.path, spec.format)
    if not spec.models:
        raise ValueError("the run names no models")
    stored = stored_scalers(spark, spec.finetune_from) if spec.finetune_from else None
    result = prepare(df, spec, stored)
    roles, data = result.dataset, result.data
    train, val = data.where("split = 'train'"), data.where("split = 'val'")
    preds, sigmas, folds = [], [], []
    for m in spec.models:
        if m.tune:
            found = tune(m, data, roles.inputs, roles.outputs, spec.key, output_scaler=result.output_scaler)
            result.tuning[m.label] = found
            m = replace(m, params=found.best_params, tune=None)
        began = time.time()
        result.models[m.label] = model = _fit(spark, m, result, train, val, spec)
        fitted = time.time()
        result.timings.append((m.label, "fit_seconds", fitted - began))
        for name, count in model.size().items():
            result.timings.append((m.label, name, float(count)))
        p = scored_long(model, data, [*spec.key, "split"]).withColumn("model", F.lit(m.label))
        preds.append(original_units(p, result.output_scaler))
        if m.uncertainty and model.has_std:
            u = model.score_std(val, spec.key).withColumn("model", F.lit(m.label))
            scaler = result.output_scaler
            if scaler:
                u = original_units(u, scaler, ("y_pred",)).withColumn(
                    "std", F.col("std") * F.create_map(*[x for o, (_, s) in scaler.params.items() for x in (F.lit(o), F.lit(float(s)))])[F.col("output")])
            sigmas.append(u)
        if spec.cv_folds:
            folds.append(cross_validate(m, result.raw.drop("split"), roles.inputs, roles.outputs, spec.key, spec.cv_folds, spec.seed,
                                        spec.standardize_inputs, spec.standardize_outputs))
    stored = preds[0]
    for p in preds[1:]:
        stored = stored.unionByName(p)
    out = spec.output_dir
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in spec.key])
    long = stored.select(key.alias("row_key"), "output", "y_true", "y_pred", "model", "split")
    if out:
        path = os.path.join(out, "predictions")
        artifacts.write_predictions(long, path, spec.predictions_format)
        result.predictions = artifacts.read_predictions(spark, path, spec.predictions_format)
    else:
        result.predictions = materialize(long, "predictions", ["model", "split"])
    result.metrics = materialize(metrics.split_metrics(result.predictions), "metrics")
    for parts, name in ((sigmas, "uncertainty"), (folds, "folds")):
        if parts:
            whole = parts[0]
            for p in parts[1:]:
                whole = whole.unionByName(p)
            setattr(result, name, materialize(whole, name))
    if out:
        _store(spark, result, out)
    return result


def _fit(spark: SparkSession, m: ModelSpec, result: RunResult, train: DataFrame, val: DataFrame, spec: RunSpec) -> Model:
    roles = result.dataset
    model = REGISTRY.create(m.key, roles.inputs, roles.outputs, **m.params)
    if spec.finetune_from and isinstance(model, MLP):
        before = REGISTRY.load(spark, os.path.join(spec.finetune_from, "models", m.label))
        return model.fit(train, val, start=before, lr_scale=0.1)
    return model.fit(train, val)


def _store(spark: SparkSession, result: RunResult, out: str) -> None:
    scores = {(r["model"], r["split"]): r.asDict() for r in result.metrics.collect()}
    cards = []
    for name, model in result.models.items():
        model.save(spark, os.path.join(out, "models", name))
        append_epochs(spark, model.history, os.path.join(out, "epochs", name))
        body = {k: v for k, v in model.params.items() if isinstance(v, (str, int, float, bool, list, type(None)))}
        cards.append((name, model.key, json.dumps(body), model.inputs, model.outputs,
                      json.dumps({s: {m: got[m] for m in ("n", "r2", "rmse", "mae", "mape")} for (n, s), got in scores.items() if n == name})))
    schema = "model string, key string, params string, inputs array<string>, outputs array<string>, metrics string"
    artifacts.write_small_json(spark.createDataFrame(cards, schema).coalesce(1), os.path.join(out, "model_cards"))
    for name, s in (("inputs", result.input_scaler), ("outputs", result.output_scaler)):
        if s:
            s.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(os.path.join(out, "scalers", name))
    artifacts.write_small_json(result.ranges, os.path.join(out, "train_ranges"))
    result.metrics.coalesce(1).write.mode("overwrite").parquet(os.path.join(out, "metrics"))
    artifacts.write_small_json(artifacts.metrics_json(result.metrics, ["n", "r2", "rmse", "mae", "mape"]), os.path.join(out, "metrics_json"))
    spark.createDataFrame(result.timings, "model string, name string, value double").coalesce(1).write.mode("overwrite").json(os.path.join(out, "profile"))
    for name, found in result.tuning.items():
        found.trials.coalesce(1).write.mode("overwrite").json(os.path.join(out, "tuning", name))
        append_epochs(spark, found.epochs, os.path.join(out, "epochs_by_trial", name))
    for name in ("uncertainty", "folds"):
        if getattr(result, name) is not None:
            getattr(result, name).write.mode("overwrite").parquet(os.path.join(out, name))


def scoring_profile(model: Model, df: DataFrame, label: str, trials: int = 5) -> DataFrame:
    """Timed scoring jobs over the whole table: (model, metric, value) with the median over trials."""
    n = df.count()
    seconds = []
    for i in range(trials + 1):
        began = time.time()
        model.score(df, []).write.format("noop").mode("overwrite").save()
        if i:  # the first job warms up
            seconds.append(time.time() - began)
    mid = statistics.median(seconds)
    rows = [(label, "rows", float(n)), (label, "seconds", mid), (label, "ms_per_row", 1000 * mid / max(n, 1)), (label, "rows_per_second", n / mid)]
    rows += [(label, k, float(v)) for k, v in model.size().items()]
    return df.sparkSession.createDataFrame(rows, "model string, metric string, value double")


def leaderboard(run_metrics: DataFrame, profile: DataFrame, split_name: str = "test") -> DataFrame:
    """Models with accuracy and profile side by side, best R2 first."""
    names = [r["metric"] for r in profile.select("metric").distinct().orderBy("metric").collect()]
    wide = profile.groupBy("model").pivot("metric", names).agg(F.first("value"))
    return run_metrics.where(F.col("split") == split_name).join(wide, "model", "left").orderBy(F.col("r2").desc(), "model")
