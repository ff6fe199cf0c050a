"""Tuning by random search or successive halving, and cross-validation, over registered models."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulake.models import REGISTRY, Model
from emulake.functions.hashing import uniform
from emulake.operators import design, metrics, split
from emulake.operators import trials as trial_tables
from emulake.operators.scale import Scaler, fit_standard, original_units
from emulake.spec import ModelSpec, TuneSpec

TRIAL_SCHEMA = "number bigint, value double, params map<string,string>, state string, seconds double, val_r2 double, val_rmse double, rung bigint, budget double"


def scored_long(model: Model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Predictions next to their truth: (keep..., output, y_true, y_pred)."""
    carried = [o for o in model.outputs if o not in keep]
    wide = model.score(df, [*keep, *carried])
    truth = F.coalesce(*[F.when(F.col("output") == o, F.col(o).cast("double")) for o in model.outputs])
    return wide.select(*keep, "output", truth.alias("y_true"), "y_pred")


def split_scores(model: Model, df: DataFrame, key: Sequence[str] = (), output_scaler: Scaler | None = None) -> dict[str, dict[str, float]]:
    """{split: {metric: value}} of a fitted model over a table with a ``split`` column, in the outputs' original units."""
    pred = original_units(scored_long(model, df, [*key, "split"]), output_scaler)
    rows = metrics.split_metrics(pred, ["split"]).collect()
    return {r["split"]: r.asDict() for r in rows}


def trial_params(row, space: Mapping[str, Any]) -> dict[str, Any]:
    """Typed parameters of a sampled trial; lists come back whole under their own name."""
    return {k: json.loads(row["params"][k]) if row["params"][k] is not None else None for k in space}


@dataclass
class TuneResult:
    trials: DataFrame
    best_params: dict[str, Any]
    best_value: float
    best_number: int
    epochs: list[dict]


def tune(spec: ModelSpec, data: DataFrame, inputs: Sequence[str], outputs: Sequence[str], key: Sequence[str], workers: int = 2,
         output_scaler: Scaler | None = None) -> TuneResult:
    """Fit trials on train, score ``<split>_<metric>``, keep the best. Trials of a rung are independent Spark jobs.

    With ``method="halving"`` the trials of a rung are fitted on the training rows whose hash of ``key`` is below the rung's budget, so the rows
    of a rung are among those of the next, and ``operators.trials.promoted`` says which go on; the best of the last rung, which has all rows, wins.
    Where the outputs of ``data`` are scaled, ``output_scaler`` brings them back, so that trials compete in original units.

    ``data`` has a ``split`` column and should be a stored or cached table: every trial reads it.
    """
    t: TuneSpec = spec.tune
    if t.method not in ("random", "halving"):
        raise ValueError(f"unknown tuning method {t.method!r}")
    which, metric = t.metric.split("_", 1)
    spark = data.sparkSession
    left = design.sample_space(spark, t.space, t.n_trials, t.seed).orderBy("number").collect()
    train, val = data.where("split = 'train'"), data.where("split = 'val'")
    cls = REGISTRY.get(spec.key)
    epochs: list[dict] = []

    def one(row, rows: DataFrame, rung: int, budget: float) -> tuple:
        began = time.time()
        params = {**spec.params, **trial_params(row, t.space)}
        try:
            model = cls(inputs, outputs, **params).fit(rows, val)
            epochs.extend({**h, "hpo_trial": row["number"]} for h in model.history)
            got = split_scores(model, data.where(F.col("split").isin(which, "val")), key, output_scaler)
            return (row["number"], float(got[which][metric]), row["params"], "complete", time.time() - began, got["val"]["r2"], got["val"]["rmse"], rung, budget)
        except (ValueError, ArithmeticError) as exc:
            return (row["number"], None, row["params"], f"failed: {exc}", time.time() - began, None, None, rung, budget)

    rungs = t.rungs if t.method == "halving" else 1
    if rungs > 1 and not key:
        raise ValueError("halving needs key columns")
    rows: list[tuple] = []
    for rung in range(rungs):
        budget = float(t.eta) ** (rung + 1 - rungs)
        some = train if rung == rungs - 1 else train.where(uniform(t.seed, F.lit("rung"), *key) < budget)  # not the hash that made the split
        with ThreadPoolExecutor(max_workers=workers) as pool:
            here = list(pool.map(lambda row: one(row, some, rung, budget), left))
        rows += here
        if all(r[1] is None for r in here):
            raise RuntimeError("every trial failed")
        if rung < rungs - 1:
            ranked = trial_tables.promoted(spark.createDataFrame(here, TRIAL_SCHEMA), t.eta, ["rung"], direction=t.direction)
            on = {r["number"] for r in ranked.where("goes_on").select("number").collect()}  # trials of one search
            left = [r for r in left if r["number"] in on]
    sign = 1 if t.direction == "minimize" else -1
    best = min((r for r in here if r[1] is not None), key=lambda r: (sign * r[1], r[0]))
    row = next(r for r in left if r["number"] == best[0])
    return TuneResult(spark.createDataFrame(rows, TRIAL_SCHEMA), {**spec.params, **trial_params(row, t.space)}, best[1], best[0], epochs)


def cross_validate(spec: ModelSpec, df: DataFrame, inputs: Sequence[str], outputs: Sequence[str], key: Sequence[str], k: int = 5, seed: int = 42,
                   standardize: bool = True, standardize_outputs: bool = False) -> DataFrame:
    """Metrics per fold, in original units; the scalers are fitted inside each fold's training part."""
    folds = split.kfold(df, key, k, seed)
    out = None
    for f in range(k):
        train, held = folds.where(F.col("fold") != f), folds.where(F.col("fold") == f)
        if standardize:
            scaler = fit_standard(train, inputs)
            train, held = scaler.transform(train), scaler.transform(held)
        y_scaler = fit_standard(train, outputs) if standardize_outputs else None
        if y_scaler:
            train, held = y_scaler.transform(train), y_scaler.transform(held)
        model = REGISTRY.create(spec.key, inputs, outputs, **spec.params).fit(train)
        per = metrics.split_metrics(original_units(scored_long(model, held, [*key, "fold"]), y_scaler), ["fold"]).withColumn("model", F.lit(spec.label))
        out = per if out is None else out.unionByName(per)
    return out
