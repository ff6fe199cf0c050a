from __future__ import annotations

import random

import numpy as np
import pytest

from emulake.models import REGISTRY, explain
from emulake.plans import catalog

X, Y = ["x1", "x2", "x3"], ["y1", "y2"]
SCHEMA = "k string, x1 double, x2 double, x3 double, y1 double, y2 double"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    made = []
    for i in range(300):
        a, b, c = (round(rng.uniform(-1, 1), 2) for _ in X)
        made.append((f"k{i}" if i else None, a, b, c, 3 * a - b * c, a * a + 2 * (c > 0)))
    return spark.createDataFrame(made, SCHEMA).persist()


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Rows to explain: some of those above, and some with missing numbers."""
    return rows.limit(40).unionByName(spark.createDataFrame([("n1", None, 0.5, float("nan"), 0.0, 0.0), ("n2", None, None, None, 0.0, 0.0)], SCHEMA))


@pytest.fixture(scope="module")
def forest(rows):
    return REGISTRY.create("rf", X, Y, n_estimators=5, max_depth=5).fit(rows)


def phis(got):
    found = {(r.k, r.output, r.feature): r.phi for r in got.collect()}
    assert len(found) == got.count()
    return found


def exploded(model, monkeypatch):
    """The model without a numpy scorer, so that its rows are exploded and regrouped."""
    monkeypatch.setattr(model, "in_rows", lambda spark: None, raising=False)
    return model


def test_the_query_shuffles_a_row_for_its_phi_and_at_most_for_its_score(spark, sf):
    plan = catalog.QUERIES["m14_permutation_shapley"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("Exchange hash") <= 2 and "collect_list" not in plan and "explode" not in plan


@pytest.mark.parametrize("permutations", [1, 3])
def test_a_forest_in_rows_explains_as_its_exploded_rows_do(rows, odd, forest, monkeypatch, permutations):
    ask = lambda: explain.shapley(forest, odd, ["k"], background=rows, permutations=permutations, background_rows=20)
    got, kinds = phis(ask()), ask().dtypes
    exploded(forest, monkeypatch)
    want = phis(ask())
    assert ask().dtypes == kinds and got.keys() == want.keys() and len(got) == 42 * 2 * 3
    assert all(abs(got[c] - want[c]) < 1e-12 for c in want) and any(abs(v) > 0.1 for v in want.values())


def test_a_gp_in_rows_explains_as_its_exploded_rows_do(rows, odd, monkeypatch):
    gp = REGISTRY.create("gp", X, Y, n_features=16).fit(rows)
    got = phis(explain.shapley(gp, odd, ["k"], background=rows, permutations=2))
    want = phis(explain.shapley(exploded(gp, monkeypatch), odd, ["k"], background=rows, permutations=2))
    assert got.keys() == want.keys() and np.allclose([got[c] for c in want], list(want.values()), atol=1e-9, equal_nan=True)


def test_numpy_walks_a_forest_as_spark_does(spark, rows, forest):
    cuts = [(n.feature, n.threshold) for n in forest.nodes(spark, "y1").where("left >= 0").collect()]
    at = [tuple(t if j == f else 0.0 for j in range(3)) for f, t in cuts]  # a row at a threshold goes left
    x = [*at, *[(r.x1, r.x2, r.x3) for r in rows.collect()], (float("nan"), 0.1, 0.2), (float("inf"), float("-inf"), float("nan")), (0.0, -0.0, 0.0)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(x)], "i int, x1 double, x2 double, x3 double")
    want = {(r.i, r.output): r.y_pred for r in forest.score(df, ["i"]).collect()}
    got = forest.in_rows(spark)(np.array(x))
    assert len(cuts) > 20 and all(got[i, k] == want[i, o] for i in range(len(x)) for k, o in enumerate(Y))


def test_a_tree_without_a_split(spark):
    flat = spark.createDataFrame([(str(i), float(i), 7.0) for i in range(20)], "k string, x double, y double")
    m = REGISTRY.create("rf", ["x"], ["y"], n_estimators=2, max_depth=3).fit(flat)
    assert set(phis(explain.shapley(m, flat, ["k"], permutations=2)).values()) == {0.0}


def test_rows_that_share_a_key_get_the_mean_of_their_phi(spark, rows, forest):
    one = spark.createDataFrame([("k", 0.9, -0.4, 0.3, 0.0, 0.0), (None, 0.9, -0.4, 0.3, 0.0, 0.0)], SCHEMA)
    other = spark.createDataFrame([("k", -0.8, 0.7, -0.6, 0.0, 0.0), (None, -0.8, 0.7, -0.6, 0.0, 0.0)], SCHEMA)
    ask = lambda df: phis(explain.shapley(forest, df, ["k"], background=rows, permutations=3))
    a, b, both, twice = ask(one), ask(other), ask(one.unionByName(other)), ask(one.unionByName(one))
    assert both.keys() == a.keys() and len(a) == 2 * 2 * 3
    assert all(abs(both[c] - (a[c] + b[c]) / 2) < 1e-12 and abs(twice[c] - a[c]) < 1e-12 for c in a)
    assert any(abs(a[c] - b[c]) > 0.1 for c in a)


def test_no_background_and_no_rows(rows, forest):
    none = rows.where("false")
    assert explain.shapley(forest, rows, ["k"], background=none).count() == 0
    assert explain.shapley(forest, none, ["k"], background=rows).count() == 0
