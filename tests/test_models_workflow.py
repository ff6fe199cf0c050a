from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from emulake.models import REGISTRY, explain
from emulake.models.base import FunctionModel
from emulake.models.mlp import Net
from emulake.operators import metrics
from emulake.plans import tuning, workflow
from emulake.plans.reports import dataset_report
from emulake.session import new_path
from emulake.spec import ModelSpec, RunSpec, TuneSpec

X, Y = ["x1", "x2", "x3"], ["y1", "y2"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (600, 3))
    y1 = 2 * x[:, 0] - x[:, 1] + 0.5
    y2 = np.sin(3 * x[:, 0]) + x[:, 2] ** 2
    rows = [(i, *map(float, v)) for i, v in enumerate(np.column_stack([x, y1, y2]))]
    df = spark.createDataFrame(rows, "k bigint, x1 double, x2 double, x3 double, y1 double, y2 double")
    from emulake.operators.split import split_shuffled

    return split_shuffled(df, ["k"], 0.2, 0.2).persist()


def r2(model, df, split="test"):
    per = metrics.output_metrics(tuning.scored_long(model, df, ["split"]).where(F.col("split") == split), ["output"]).collect()
    return {r.output: r.r2 for r in per}


def part(df, s):
    return df.where(F.col("split") == s)


def test_linear_recovers_its_weights(spark, table):
    m = REGISTRY.create("linear", X, ["y1"]).fit(part(table, "train"))
    assert np.allclose(m.weights[:, 0], [2, -1, 0], atol=1e-9) and abs(m.bias[0] - 0.5) < 1e-9
    path = new_path(spark, "linear")
    m.save(spark, path)
    again = REGISTRY.load(spark, path)
    assert np.allclose(again.weights, m.weights)
    phi = m.shapley(part(table, "test"), ["k"])
    back = phi.groupBy("k").agg(F.sum("phi").alias("s")).join(m.score(part(table, "test"), ["k"]), "k")
    base = float(m.bias[0] + m.centre @ m.weights[:, 0])
    assert back.where(F.abs(F.col("s") + base - F.col("y_pred")) > 1e-9).count() == 0


def test_fourier_bayes_fits_a_curve_and_knows_its_doubt(spark, table):
    m = REGISTRY.create("gp", X, Y, n_features=150, kernel="rbf", lengthscale=1.5).fit(part(table, "train"))
    got = r2(m, table)
    assert got["y1"] > 0.99 and got["y2"] > 0.95
    inside = m.score_std(part(table, "test"), ["k"]).agg(F.avg("std")).first()[0]
    far = part(table, "test").withColumns({c: F.col(c) * 10 for c in X})
    assert m.score_std(far, ["k"]).agg(F.avg("std")).first()[0] > 3 * inside
    path = new_path(spark, "gp")
    m.save(spark, path)
    again = REGISTRY.load(spark, path)
    a, b = (mm.score(part(table, "test"), ["k"]).agg(F.sum("y_pred")).first()[0] for mm in (m, again))
    assert abs(a - b) < 1e-9
    draws = m.sample_posterior(part(table, "test"), ["k"], 30)
    assert draws.count() == 120 * 30 * 2
    spread = draws.groupBy("k", "output").agg(F.avg("y_pred").alias("m")).join(m.score(part(table, "test"), ["k"]), ["k", "output"])
    assert spread.agg(F.max(F.abs(F.col("m") - F.col("y_pred")))).first()[0] < 1.0


def test_evidence_prefers_the_right_scale(spark, table):
    m = REGISTRY.create("gp", X, ["y2"], n_features=100)
    rows = m.search(part(table, "train"), kernels=("rbf", "matern32"), lengthscales=(0.1, 1.0), variances=(1.0,))
    best = max(rows, key=lambda r: r["log_evidence"])
    assert len(rows) == 4 and best["lengthscale"] == 1.0 and m.params["lengthscale"] == 1.0
    assert r2(m, table)["y2"] > 0.9


def test_forest_mean_over_trees_is_the_prediction(spark, table):
    m = REGISTRY.create("rf", X, Y, n_estimators=8, max_depth=6).fit(part(table, "train"))
    a = m.score(part(table, "val"), ["k"])
    b = m.score_std(part(table, "val"), ["k"]).withColumnRenamed("y_pred", "mean")
    j = a.join(b, ["k", "output"])
    assert j.count() == 240 and j.where(F.abs(F.col("y_pred") - F.col("mean")) > 1e-9).count() == 0
    assert b.agg(F.max("std")).first()[0] > 0
    imp = {(r.output, r.feature): r.importance for r in m.importances(spark).collect()}
    assert imp[("y1", "x1")] > imp[("y1", "x3")]
    path = new_path(spark, "rf")
    m.save(spark, path)
    assert abs(REGISTRY.load(spark, path).score(table, []).agg(F.sum("y_pred")).first()[0] - m.score(table, []).agg(F.sum("y_pred")).first()[0]) < 1e-6


def test_ensemble_is_the_mean_of_its_members(spark, table):
    m = REGISTRY.create("ensemble", X, ["y2"], base="gp", n_members=3, base_params={"n_features": 30}).fit(part(table, "train"))
    assert [b.params["seed"] for b in m.members] == [42, 43, 44]
    got = m.score_std(part(table, "val"), ["k"])
    want = m.member_scores(part(table, "val"), ["k"]).groupBy("k").agg(F.avg("y_pred").alias("a"), F.stddev_pop("y_pred").alias("s"))
    assert got.join(want, "k").where((F.abs(F.col("y_pred") - F.col("a")) > 1e-9) | (F.abs(F.col("std") - F.col("s")) > 1e-9)).count() == 0
    trees = REGISTRY.create("ensemble", X, ["y2"], base="rf", n_members=2, key=["k"], base_params={"n_estimators": 3, "max_depth": 4}).fit(part(table, "train"))
    assert trees.score(part(table, "val"), ["k"]).count() == 120
    with pytest.raises(ValueError, match="key"):
        trees.score(part(table, "val"), ["split"])
    path = new_path(spark, "ensemble")
    m.save(spark, path)
    again = REGISTRY.load(spark, path).score(part(table, "val"), ["k"])
    assert got.join(again.withColumnRenamed("y_pred", "again"), ["k", "output"]).where(F.abs(F.col("y_pred") - F.col("again")) > 1e-9).count() == 0


def test_gradient_matches_differences():
    for act in ("tanh", "sigmoid", "relu", "leaky_relu"):
        net = Net([3, 5, 2], act)
        rng = np.random.default_rng(1)
        w, x, y = net.start(0), rng.normal(size=(7, 3)), rng.normal(size=(7, 2))
        g, _ = net.gradient(w, x, y, rng)
        for i in (0, 4, 11, len(w) - 1):
            d = np.zeros_like(w)
            d[i] = 1e-6
            num = (np.mean((net.forward(w + d, x) - y) ** 2) - np.mean((net.forward(w - d, x) - y) ** 2)) / 2e-6
            assert abs(num - g[i]) < 1e-5


def test_mlp_learns_stops_and_continues(spark, table):
    p = {"hidden_layers": [24, 24], "learning_rate": 0.01, "batch_size": 32, "shards": 2, "key": ["k"], "activation": "tanh"}
    m = REGISTRY.create("mlp", X, Y, n_epochs=25, patience=10, **p).fit(part(table, "train"), part(table, "val"))
    assert r2(m, table)["y1"] > 0.9
    assert [h["epoch"] for h in m.history] == list(range(1, len(m.history) + 1)) and m.history[0]["val_loss"] > m.history[-1]["val_loss"]
    assert m.history[0]["train_rows_this_epoch"] == 360
    more = REGISTRY.create("mlp", X, Y, n_epochs=3, **p).fit(part(table, "train"), part(table, "val"), start=m, lr_scale=0.1)
    assert np.allclose(more.mx, m.mx) and r2(more, table)["y1"] > 0.9
    half = REGISTRY.create("mlp", X, Y, n_epochs=2, epoch_fraction=0.5, **p).fit(part(table, "train"))
    assert [h["train_rows_this_epoch"] for h in half.history] == [180, 180]


def test_permutation_attributions_add_up(spark, table):
    m = REGISTRY.create("linear", X, ["y1"]).fit(part(table, "train"))
    phi = explain.shapley(m, part(table, "test"), ["k"], background=part(table, "train"), permutations=30, max_rows=None, background_rows=50)
    assert phi.count() == 120 * 3
    got = explain.global_importance(phi).collect()
    exact = {r.feature: r.importance for r in explain.global_importance(m.shapley(part(table, "test"), ["k"])).collect()}
    assert all(abs(r.importance - exact[r.feature]) < 0.2 for r in got)
    assert explain.shapley(m, part(table, "test"), ["k"], permutations=2, max_rows=10).select("k").distinct().count() == 10


def test_registry(spark):
    assert "rf" in REGISTRY and REGISTRY.get("rf") is REGISTRY.get("random_forest")
    with pytest.raises(KeyError):
        REGISTRY.get("absent")
    REGISTRY.register(FunctionModel, key="double", aliases=["twice"])
    df = spark.range(5).select(F.col("id").alias("k"), F.col("id").cast("double").alias("x"))
    got = REGISTRY.create("twice", ["x"], ["y"], predict=lambda x: 2 * x).score(df, ["k"]).orderBy("k").collect()
    assert [r.y_pred for r in got] == [0.0, 2.0, 4.0, 6.0, 8.0]


def test_tuning_keeps_failed_trials_and_folds_lists_back(spark, table):
    space = {"n_features": {"type": "int", "low": 20, "high": 60, "step": 20}, "lengthscale": {"type": "float", "low": 0.5, "high": 3.0},
             "kernel": {"type": "categorical", "choices": ["rbf", "bogus"]}}
    got = tuning.tune(ModelSpec("gp", tune=TuneSpec(space, n_trials=12, metric="val_r2", direction="maximize")), table, X, Y, ["k"])
    rows = got.trials.collect()
    assert len(rows) == 12 and any(r.state.startswith("failed") for r in rows)
    assert got.best_value == max(r.value for r in rows if r.value is not None) and got.best_params["kernel"] == "rbf"
    lists = {"hidden_layers": {"type": "variable_list", "num_layers": {"low": 1, "high": 2}, "element": {"type": "int", "low": 4, "high": 8}}}
    best = tuning.tune(ModelSpec("mlp", params={"n_epochs": 1, "shards": 1}, tune=TuneSpec(lists, n_trials=1)), table, X, Y, ["k"]).best_params
    assert isinstance(best["hidden_layers"], list)


def test_workflow_writes_and_reloads(spark, table):
    out = new_path(spark, "run")
    raw = {"key": ["k"], "metadata": {"inputs": X, "outputs": Y}, "standardize_outputs": True, "output_dir": out, "cv_folds": 3,
           "models": [{"key": "linear", "name": "line"}, {"key": "gp", "params": {"n_features": 40}, "uncertainty": True},
                      {"key": "mlp", "params": {"n_epochs": 2, "shards": 2}}]}
    res = workflow.run_workflow(spark, raw, table.drop("split"))
    got = {(r.model, r.split): r for r in res.metrics.collect()}
    assert set(got) == {(m, s) for m in ("line", "gp", "mlp") for s in ("train", "val", "test")}
    assert got[("line", "train")].n == 360 and got[("line", "test")].n == 120
    assert res.predictions.where("model = 'line' AND output = 'y1' AND abs(y_true - y_pred) > 1e-6").count() == 0  # original units
    assert res.uncertainty.count() == 120 * 2 and res.folds.count() == 9
    assert spark.read.json(f"{out}/model_cards").where("model = 'line' AND metrics LIKE '%rmse%'").count() == 1
    assert spark.read.json(f"{out}/epochs/mlp").count() == 2
    again = REGISTRY.load(spark, f"{out}/models/line")
    assert np.allclose(again.weights, res.models["line"].weights)
    tuned = workflow.run_workflow(spark, {**raw, "models": [raw["models"][2]], "output_dir": None, "finetune_from": out, "cv_folds": None}, table.drop("split"))
    assert tuned.input_scaler.params == res.input_scaler.params
    board = workflow.leaderboard(res.metrics, workflow.scoring_profile(res.models["line"], res.data, "line", 1)).collect()
    assert [b.r2 for b in board] == sorted((b.r2 for b in board), reverse=True) and {b.model for b in board} == {"line", "gp", "mlp"}


def test_repeated_keys_are_refused(spark, table):
    spec = RunSpec(key=["x"], metadata={"inputs": ["a"], "outputs": ["b"]}, models=[ModelSpec("linear")])
    df = spark.range(20).select((F.col("id") % 5).alias("x"), F.col("id").alias("a"), F.col("id").alias("b"))
    with pytest.raises(ValueError, match="repeats"):
        workflow.run_workflow(spark, spec, df)
    with pytest.raises(ValueError, match="unknown"):
        RunSpec.from_dict({"paths": "x"})


def test_cross_validation_scales_inside_the_fold(spark, table):
    folds = tuning.cross_validate(ModelSpec("linear"), table.drop("split"), X, ["y1"], ["k"], 4).collect()
    assert [r.n for r in folds] == [150] * 4 and all(r.r2 > 0.999999 for r in folds)


def test_dataset_report(spark, table):
    r = {(x.section, x.name): x.value for x in dataset_report(table.drop("split"), key=["k"]).collect()}
    assert r[("shape", "rows")] == 600 and r[("completeness", "percent")] == 100.0 and ("output", "y1") in r and ("statistic", "x1.q50") in r
