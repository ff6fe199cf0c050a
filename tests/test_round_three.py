"""Kernel sums, exact tree attributions, stateful blocks, chunk plans by doubling, prediction files and the network's independence of the cluster."""

from __future__ import annotations

import contextlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emulake import session
from emulake.models import REGISTRY, tree_shapley
from emulake.models.fourier_bayes import Features, ascend, evidence, evidence_gradient
from emulake.models.mlp import Net
from emulake.operators import campaign, drift
from emulake.session import new_path
from emulake.sources import artifacts
from emulake.streaming import monitor, progress


@pytest.fixture(scope="module")
def curve(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-2, 2, (400, 3))
    y = 1.5 * x[:, 0] + np.sin(3 * x[:, 1]) + 0.05 * rng.standard_normal(400)
    rows = [(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "k bigint, x1 double, x2 double, x3 double, y double").persist()


# --- kernel sums ------------------------------------------------------------------------------------------


def sums(seed=0, n=60):
    rng = np.random.default_rng(seed)
    z = rng.standard_normal((n, 2))
    y = z[:, 0] + np.sin(2 * z[:, 1]) + 0.1 * rng.standard_normal(n)
    f = Features(2, ["linear", "rbf", "matern32"], [0.7, 1.6], 4, 3)
    phi = f(z)
    return f, phi, y, (phi.T @ phi, phi.T @ y, float(y @ y), float(n))


def test_evidence_is_that_of_the_dense_gaussian():
    f, phi, y, parts = sums()
    v = np.array([0.4, 1.3, 0.7])[f.owner]
    cov = (phi * v) @ phi.T + 0.2 * np.eye(len(y))
    dense = -0.5 * (y @ np.linalg.solve(cov, y) + np.linalg.slogdet(cov)[1] + len(y) * math.log(2 * math.pi))
    value, mean, chol = evidence(*parts, 0.2, v)
    assert abs(value - dense) < 1e-6
    assert np.allclose(phi @ mean, (phi * v) @ phi.T @ np.linalg.solve(cov, y), atol=1e-6)
    spread = np.sum(np.linalg.solve(chol, phi.T) ** 2, axis=0)
    prior = (phi * v) @ phi.T
    assert np.allclose(spread, np.diag(prior - prior @ np.linalg.solve(cov, prior)), atol=1e-6)


def test_evidence_gradient_matches_differences():
    f, _, _, parts = sums(1)
    at = np.log([0.4, 1.3, 0.7, 0.2])
    fn = lambda t: evidence_gradient(*parts, math.exp(t[-1]), np.exp(t[:-1]), f.owner)
    _, grad = fn(at)
    for j in range(4):
        step = np.eye(4)[j] * 1e-5
        assert abs((fn(at + step)[0] - fn(at - step)[0]) / 2e-5 - grad[j]) < 1e-4 * (1 + abs(grad[j]))
    top = ascend(fn, at, *np.log([1e-8, 1e8]))
    value, grad = fn(top)
    free = (top > math.log(1.01e-8)) & (top < math.log(0.99e8))
    assert value > fn(at)[0] and np.abs(grad[free]).max() < 0.05
    for j, d in itertools.product(range(4), (-0.3, 0.3)):
        assert fn(np.clip(top + np.eye(4)[j] * d, *np.log([1e-8, 1e8])))[0] <= value + 1e-6


def test_features_approach_their_kernels():
    z = np.random.default_rng(2).uniform(-1, 1, (30, 2))
    scale = np.array([0.5, 2.0])
    r = np.sqrt((((z[:, None] - z[None]) / scale) ** 2).sum(-1))
    want = {"rbf": np.exp(-r * r / 2), "matern12": np.exp(-r), "matern32": (1 + 3**0.5 * r) * np.exp(-(3**0.5) * r), "exponential": np.exp(-r / 2), "rational_quadratic": 1 / (1 + r * r / 2)}
    for kernel, k in want.items():
        phi = Features(2, [kernel], scale, 40_000, 1)(z)
        assert np.abs(phi @ phi.T - k).max() < 0.03, kernel
    with pytest.raises(ValueError):
        Features(2, ["cubic"], 1.0, 4, 1)
    with pytest.raises(ValueError):
        Features(2, ["rbf"], [1.0, -1.0], 4, 1)


def test_sums_are_optimised_and_stored(spark, curve):
    base = {"kernels": ["linear", "rbf"], "n_features": 60, "lengthscale": 1.0}
    x = ["x1", "x2", "x3"]
    plain = REGISTRY.create("gp", x, ["y"], **base).fit(curve)
    tuned = REGISTRY.create("gp", x, ["y"], **base, optimize=True).fit(curve)
    scaled = REGISTRY.create("gp", x, ["y"], **base, optimize="lengthscales", rounds=4).fit(curve)
    assert plain.log_evidence[0] < tuned.log_evidence[0] < scaled.log_evidence[0]
    ls = scaled.params["lengthscale"]
    assert ls[2] > ls[1]  # the output does not depend on the third input
    path = new_path(spark, "gp-sum")
    scaled.save(spark, path)
    again = REGISTRY.load(spark, path)
    both = again.score_std(curve, ["k"]).join(scaled.score_std(curve, ["k"]).select("k", F.col("y_pred").alias("p"), F.col("std").alias("s")), "k")
    assert both.where((F.abs(F.col("y_pred") - F.col("p")) > 1e-9) | (F.abs(F.col("std") - F.col("s")) > 1e-9)).count() == 0
    with pytest.raises(ValueError):
        REGISTRY.create("gp", x, ["y"], kernels=["rbf", "rbf"]).fit(curve)
    rows = REGISTRY.create("gp", x, ["y"], n_features=20).search(curve, kernels=("linear", "rbf+linear"), lengthscales=(0.5, 1.0), variances=(1.0,))
    assert [(r["kernel"], r["lengthscale"]) for r in rows] == [("linear", 0.5), ("rbf+linear", 0.5), ("rbf+linear", 1.0)]


# --- tree attributions ------------------------------------------------------------------------------------


def all_subsets(value, p):
    phi = []
    for j in range(p):
        rest = [f for f in range(p) if f != j]
        phi.append(sum(math.factorial(k) * math.factorial(p - k - 1) / math.factorial(p) * (value({*s, j}) - value(set(s))) for k in range(p) for s in itertools.combinations(rest, k)))
    return phi


def expected(nodes, tree, x, known, node=0):
    """Mean of a tree where only ``known`` features are seen, by the training rows at its nodes."""
    n = nodes[tree, node]
    if n.left < 0:
        return n.value
    if n.feature in known:
        return expected(nodes, tree, x, known, n.left if x[n.feature] <= n.threshold else n.right)
    a, b = (nodes[tree, c] for c in (n.left, n.right))
    return (a.cover * expected(nodes, tree, x, known, n.left) + b.cover * expected(nodes, tree, x, known, n.right)) / (a.cover + b.cover)


def test_tree_attributions_match_all_subsets(spark, curve):
    x = ["x1", "x2", "x3"]
    forest = REGISTRY.create("rf", x, ["y"], n_estimators=3, max_depth=5).fit(curve)
    nodes = {(n.tree, n.id): n for n in forest.nodes(spark).collect()}
    some = curve.where("k < 25")
    got = {(r.k, r.feature): r.phi for r in forest.shapley(some, ["k"]).collect()}
    small = {(r.k, r.feature): r.phi for r in tree_shapley.tree_attributions(forest.nodes(spark), some, ["k"], x, "y", leaves=7).collect()}
    base = tree_shapley.base_value(forest.nodes(spark), 3)
    pred = {r.k: r.y_pred for r in forest.score(some, ["k"]).collect()}
    for r in some.collect():
        row = [r.x1, r.x2, r.x3]
        want = all_subsets(lambda known: sum(expected(nodes, t, row, known) for t in range(3)) / 3, 3)
        for f, w in zip(x, want):
            assert abs(got[r.k, f] - w) < 1e-9 and abs(small[r.k, f] - w) < 1e-9
        assert abs(sum(got[r.k, f] for f in x) + base - pred[r.k]) < 1e-9


def test_tree_attributions_over_a_background(spark, curve):
    x = ["x1", "x2", "x3"]
    forest = REGISTRY.create("rf", x, ["y"], n_estimators=2, max_depth=4).fit(curve)
    nodes = {(n.tree, n.id): n for n in forest.nodes(spark).collect()}
    some, back = curve.where("k < 6"), curve.where("k >= 390")
    got = {(r.k, r.feature): r.phi for r in forest.shapley(some, ["k"], background=back).collect()}
    others = [[r.x1, r.x2, r.x3] for r in back.collect()]

    def tree(t, row, node=0):
        n = nodes[t, node]
        return n.value if n.left < 0 else tree(t, row, n.left if row[n.feature] <= n.threshold else n.right)

    for r in some.collect():
        row = [r.x1, r.x2, r.x3]
        mixed = lambda known: sum(tree(t, [row[j] if j in known else z[j] for j in range(3)]) for z in others for t in range(2)) / 2 / len(others)
        for f, w in zip(x, all_subsets(mixed, 3)):
            assert abs(got[r.k, f] - w) < 1e-9


def test_tree_without_a_split_and_missing_numbers(spark):
    stump = spark.createDataFrame([(0, 0, -1, -1, 0, 0.0, 7.0, 10.0)], tree_shapley.NODES)
    df = spark.createDataFrame([(1, 1.0), (2, None)], "k bigint, x double")
    assert [r.phi for r in tree_shapley.tree_attributions(stump, df, ["k"], ["x"], "y").collect()] == [0.0, 0.0]
    split = spark.createDataFrame([(0, 0, 1, 2, 0, 0.5, 0.0, 4.0), (0, 1, -1, -1, 0, 0.0, 1.0, 1.0), (0, 2, -1, -1, 0, 0.0, 5.0, 3.0)], tree_shapley.NODES)
    got = {r.k: r.phi for r in tree_shapley.tree_attributions(split, df, ["k"], ["x"], "y").collect()}
    assert got == {1: 1.0, 2: 1.0} and tree_shapley.base_value(split, 1) == 4.0


# --- blocks with state ------------------------------------------------------------------------------------


def follow(spark, src, out, state, schema, ranges, **more):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = monitor.follow_blocks(stream, "i", 10, ranges, ("t", "p"), {"r2": 0.9, "rmse": 1.0}, shards=4, **more).writeStream.outputMode("append").format("parquet").option(
        "path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def test_blocks_leave_the_state_once_full(spark):
    rng = np.random.default_rng(8)
    n = 995
    rows = [(i, float(rng.normal()), float(v), float(v + 0.1 * rng.normal())) for i, v in enumerate(rng.normal(size=n))]
    rows[17] = (17, None, 1.0, 1.5)
    df = spark.createDataFrame(rows, "i bigint, x double, t double, p double")
    ranges = drift.training_ranges(df.where("i < 500"), ["x"], ["t"])
    src, out, state = (new_path(spark, t) for t in ("blocks", "blocks-out", "blocks-state"))
    held = []
    for part in range(5):
        df.where(F.floor(F.col("i") / 200) == part).coalesce(1).write.mode("append").parquet(src)
        held += follow(spark, src, out, state, df.schema, ranges, total_rows=n)
    df.where("i IN (3, 4, 250)").coalesce(1).write.mode("append").parquet(src)
    held += follow(spark, src, out, state, df.schema, ranges, total_rows=n)
    assert held and max(held) <= 4  # one state row per shard, however many blocks
    got = spark.read.parquet(out)
    assert {(r.block, r.late_rows) for r in got.where("n = 0").collect()} == {(0, 2), (25, 1)}
    once = got.where("n > 0")
    assert once.count() == 100 and once.where("late_rows <> 0").count() == 0
    whole = monitor.watch_blocks(df, "i", 10, ranges, ("t", "p"), {"r2": 0.9, "rmse": 1.0})
    both = {r.block: r for r in whole.collect()}
    for r in once.collect():
        w = both[r.block]
        assert (r.n, r.n_inputs_out, r.outputs_out, r.triggers) == (w.n, w.n_inputs_out, w.outputs_out, w.triggers)
        assert abs(r.r2 - w.r2) < 1e-9 and abs(r.rmse - w.rmse) < 1e-12


def test_blocks_that_never_fill_leave_after_the_lag(spark):
    df = spark.createDataFrame([(i, 1.0, float(i % 7), float(i % 7)) for i in range(400) if i // 10 not in (3, 5) or i % 10 < 4], "i bigint, x double, t double, p double")
    ranges = drift.training_ranges(df, ["x"], ["t"])
    src, out, state = (new_path(spark, t) for t in ("gaps", "gaps-out", "gaps-state"))
    df.coalesce(1).write.parquet(src)
    follow(spark, src, out, state, df.schema, ranges, lag=8)
    got = {r.block: r.n for r in spark.read.parquet(out).collect()}
    assert got == {b: 4 if b in (3, 5) else 10 for b in range(40)}


def test_blocks_whose_rows_come_far_apart_are_whole(spark):
    """Every file has a third of each block, and more blocks are open at once than any lag that was fixed before."""
    n = 12_000
    df = spark.range(n).selectExpr("id AS i", "1D AS x", "id % 7 * 1D AS t", "id % 7 * 1D AS p")
    ranges = drift.training_ranges(df, ["x"], ["t"])
    src, out, state = (new_path(spark, t) for t in ("apart", "apart-out", "apart-state"))
    for k in range(3):
        df.where(f"i % 3 = {k}").coalesce(1).write.mode("append").parquet(src)
    follow(spark, src, out, state, df.schema, ranges, total_rows=n)
    assert spark.read.parquet(out).agg(F.count("*"), F.countDistinct("block"), F.min("n"), F.max("n"), F.sum("late_rows")).first() == (1200, 1200, 10, 10, 0)


# --- chunk plans ------------------------------------------------------------------------------------------


def planned(ids, chunk):
    """The plan by walking along the pending ids."""
    out, left = [], sorted(ids)
    start = left[0] if left else 0
    while left:
        start += (left[0] - start) // chunk * chunk
        took = [i for i in left if i < start + chunk]
        out.append((took[0], took[-1], took))
        left, start = left[len(took):], took[-1] + 1
    return out


@pytest.mark.parametrize(("chunk", "page", "density"), [(7, 7, 0.5), (5, 16, 0.05), (12, 40, 0.9), (3, 1000, 0.3), (1, 4, 0.5)])
def test_chunk_plan_matches_a_walk(spark, chunk, page, density):
    rng = np.random.default_rng(chunk)
    ids = (np.flatnonzero(rng.random(700) < density) + 11).tolist()
    cases = spark.createDataFrame([(int(i), "pending") for i in ids] + [(3, "finished")], "case_id bigint, status string")
    got = campaign.plan_chunks(cases, chunk, ["a", "b"], page=page).orderBy("chunk").collect()
    want = planned(ids, chunk)
    assert [(r.first_id, r.last_id, list(r.case_ids)) for r in got] == want
    assert [r.chunk for r in got] == list(range(len(want))) and [r.config for r in got] == ["ab"[k % 2] for k in range(len(want))]


def test_parameters_are_aggregated_after_the_shuffle_only(spark):
    """A task that reads many files holds none of them; the first line counts even if it has no number."""
    rows = [("r", "a", 0, "x = abc"), ("r", "a", 1, "x = 5"), ("r", "b", 2, "x = 7"), ("r", "b", 1, "x = 2 ! two"), (None, "b", 1, "x = 1"), ("r", None, 3, "y = 1")]
    got = campaign.parse_parameters(spark.createDataFrame(rows, "run string, case string, line_no int, line string"), ["x", "y"])
    assert {(r.run, r.case, r.param): r.value for r in got.collect()} == {("r", "a", "x"): None, ("r", "b", "x"): 2.0, (None, "b", "x"): 1.0, ("r", None, "y"): 1.0}
    plan = got._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[2] or got._jdf.queryExecution().executedPlan().toString()
    above, exchange, below = plan.partition("Exchange")
    assert exchange and "Aggregate" in above and "SortAggregate" not in plan and "Aggregate" not in below


# --- files, snapshots, networks -----------------------------------------------------------------------------


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_prediction_files_are_sets_of_part_files(spark, fmt):
    rows = [(m, s, i, float(i), i + 0.5) for m in ("a_val", "b.2") for s in ("train", "val") for i in range(50)]
    wide = spark.createDataFrame(rows, "model string, split string, index bigint, y_true_00 double, y_pred_00 double").repartition(3)
    path = new_path(spark, "prediction-sets")
    artifacts.write_prediction_files(wide, path, fmt)
    artifacts.write_prediction_files(wide, path, fmt, uncertain=True)
    artifacts.write_prediction_files(wide.where("model = 'a_val' AND split = 'val' AND index < 10"), path, fmt)  # replaces one set only
    back = artifacts.read_prediction_files(spark, path, 1, fmt)
    got = {(r.model, r.split): r["count"] for r in back.groupBy("model", "split").count().collect()}
    assert got == {("a_val", "train"): 50, ("a_val", "val"): 10, ("b", "train"): 50, ("b", "val"): 50} or got == {("a_val", "train"): 50, ("a_val", "val"): 10, ("b.2", "train"): 50, ("b.2", "val"): 50}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_predictions_are_written_side_by_side(spark, fmt, monkeypatch):
    """No sort by folder: the setting holds while the files are written, and only then; more folders than open files are whole too."""
    assert spark.conf.get(session.OPEN_FILES_CONF) == "0"
    seen, entered = [], session.open_files

    @contextlib.contextmanager
    def watched(s):
        with entered(s):
            seen.append(spark.conf.get(session.OPEN_FILES_CONF))
            yield

    monkeypatch.setattr(artifacts, "open_files", watched)
    pred = spark.range(600, numPartitions=1).selectExpr(
        "concat('k', id) AS row_key", "'y' AS output", "id + 0.25D AS y_true", "CASE WHEN id % 9 > 0 THEN id * 1D END AS y_pred", "concat('m', id % 10) AS model", "IF(id % 4 = 0, 'val', 'train') AS split")
    path = new_path(spark, "side-by-side")
    artifacts.write_predictions(pred, path, fmt)
    back = artifacts.read_predictions(spark, path, fmt).select(pred.columns)
    assert back.exceptAll(pred).isEmpty() and pred.exceptAll(back).isEmpty()
    assert seen == [str(session.OPEN_FILES)] and spark.conf.get(session.OPEN_FILES_CONF) == "0"


def test_snapshot_log_tells_what_changed(spark):
    folder, out, state = (new_path(spark, t) for t in ("snaps", "snap-log", "snap-state"))
    days = {"day1": {1: "pending", 2: "started"}, "day2": {1: "started", 2: "finished", 3: "pending"}, "day3": {1: "started", 3: "finished"}}
    for day, cases in days.items():
        spark.createDataFrame([(k, "run1", f"c{k}", s) for k, s in cases.items()], "case_id bigint, run string, eq string, status string").write.json(f"{folder}/{day}")
        progress.log_changes(progress.follow_snapshots(spark, folder), out, state).awaitTermination()
    got = {r.snapshot: (r.line, r.new, r.changed, r.newly_finished) for r in progress.snapshot_log(spark, out).collect()}
    assert got["day1"] == ("finished=0 inflight=0 started=1 pending=1", 2, 0, 0)
    assert got["day2"] == ("finished=1 inflight=0 started=1 pending=1", 1, 2, 1)
    assert got["day3"] == ("finished=1 inflight=0 started=1 pending=0", 0, 1, 1)


def test_snapshot_log_holds_cases_in_no_python_state(spark):
    """Late, repeated and null lines as before; no case passes through Python and the stream has no state operator."""
    folder, out, state = (new_path(spark, t) for t in ("snaps", "snap-log", "snap-state"))
    schema = "case_id bigint, run string, eq string, status string"
    days = [("day2", [(1, "started"), (1, "pending"), (2, "started"), (None, "started"), (4, None)]), ("day1", [(1, "finished"), (5, "pending")]),
            ("day3", [(1, "finished"), (2, "started")]), ("day4", [(5, "inflight"), (1, "finished")])]
    held = []
    for day, cases in days:
        spark.createDataFrame([(k, "run1", f"c{k}", s) for k, s in cases], schema).write.json(f"{folder}/{day}")
        q = progress.log_changes(progress.follow_snapshots(spark, folder), out, state)
        q.awaitTermination()
        held += [p["stateOperators"] for p in q.recentProgress]
    assert not any(held)
    got = {r.snapshot: (r.line, r.new, r.changed, r.newly_finished) for r in progress.snapshot_log(spark, out).collect()}
    assert got == {
        "day2": ("finished=0 inflight=0 started=1 pending=1", 2, 0, 0), "day1": ("finished=0 inflight=0 started=0 pending=1", 1, 0, 0),
        "day3": ("finished=1 inflight=0 started=1 pending=0", 0, 1, 1), "day4": ("finished=1 inflight=1 started=0 pending=0", 0, 1, 0)}


def test_network_does_not_depend_on_the_cluster(spark, curve):
    params = {"hidden_layers": [8], "n_epochs": 4, "shard_rows": 60, "batch_size": 16, "learning_rate": 0.01}
    fits = []
    for parts, bytes_ in ((1, "128m"), (7, "4k")):  # rows dealt anew, files packed into other tasks
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_)
        try:
            fits.append(REGISTRY.create("mlp", ["x1", "x2", "x3"], ["y"], **params).fit(curve.repartition(parts, F.rand(parts)), curve.where("k % 5 = 0")))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert np.abs(fits[0].weights - fits[1].weights).max() < 1e-9
    assert fits[0].history[-1]["train_rows_this_epoch"] == 400


def test_network_gradient_matches_differences():
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((20, 3)), rng.standard_normal((20, 2))
    for act in ("tanh", "sigmoid", "relu", "leaky_relu"):
        net = Net([3, 5, 4, 2], act)
        w = net.start(1)
        grad, sse = net.gradient(w, x, y, rng)
        loss = lambda v: float(np.mean((net.forward(v, x) - y) ** 2))
        assert abs(sse / y.size - loss(w)) < 1e-12
        for j in rng.choice(len(w), 12, replace=False):
            step = np.eye(len(w))[j] * 1e-6
            assert abs((loss(w + step) - loss(w - step)) / 2e-6 - grad[j]) < 1e-6


def test_halving_stops_trials_and_methods_are_known(spark, curve):
    from emulake.operators.split import split_shuffled
    from emulake.plans import tuning
    from emulake.spec import ModelSpec, TuneSpec

    data = split_shuffled(curve, ["k"], 0.2, 0.2).persist()
    space = {"alpha": {"type": "loguniform", "low": 1e-3, "high": 1e6}}
    found = tuning.tune(ModelSpec("linear", tune=TuneSpec(space, n_trials=9, method="halving", eta=3, rungs=2)), data, ["x1", "x2", "x3"], ["y"], ["k"])
    rows = found.trials.collect()
    assert sorted(r.rung for r in rows) == [0] * 9 + [1] * 3 and {r.budget for r in rows if r.rung} == {1.0}
    first = sorted((r.value, r.number) for r in rows if r.rung == 0)
    assert {r.number for r in rows if r.rung} == {n for _, n in first[:3]}
    assert found.best_value == min(r.value for r in rows if r.rung) and found.best_number in {r.number for r in rows if r.rung}
    with pytest.raises(ValueError):
        tuning.tune(ModelSpec("linear", tune=TuneSpec(space, method="guess")), data, ["x1"], ["y"], ["k"])
    with pytest.raises(ValueError):
        tuning.tune(ModelSpec("linear", tune=TuneSpec(space, method="halving")), data, ["x1"], ["y"], [])


def test_grid_runs_are_all_combinations(spark):
    from emulake.operators import design

    cases = spark.createDataFrame([("a",), ("b",)], "case string")
    levels = {"x": [1, 2, 3], "y": [0.5], "z": [7, 8]}
    got = design.grid_runs(cases, levels).orderBy("case", "run").collect()
    want = list(itertools.product(*levels.values()))
    assert [(r.case, r.x, r.y, r.z) for r in got] == [(c, *w) for c in "ab" for w in want]
    with pytest.raises(ValueError):
        design.grid_runs(cases, {"x": []})
