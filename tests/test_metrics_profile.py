from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emulake.operators import drift, metrics, profile, roles


def preds(spark, rows):
    return spark.createDataFrame([("m", "test", o, t, p) for o, t, p in rows], "model string, split string, output string, y_true double, y_pred double")


def test_r2_is_not_squared_correlation(spark):
    r = metrics.output_metrics(preds(spark, [("a", 1.0, 1.5), ("a", 2.0, 2.0), ("a", 3.0, 3.6)]), ["output"]).first()
    sse = 0.25 + 0.36
    assert abs(r.r2 - (1 - sse / 2.0)) < 1e-12
    assert abs(r.mean_error - (0.5 + 0.6) / 3) < 1e-12


def test_constant_truth(spark):
    perfect = metrics.output_metrics(preds(spark, [("a", 2.0, 2.0), ("a", 2.0, 2.0)]), ["output"]).first()
    wrong = metrics.output_metrics(preds(spark, [("a", 2.0, 2.0), ("a", 2.0, 3.0)]), ["output"]).first()
    assert (perfect.r2, wrong.r2) == (1.0, 0.0)
    assert metrics.finite_r2(preds(spark, [("a", 2.0, 2.0), ("a", 2.0, 2.0)]), ["output"]).first().r2 == 0.0


def test_multi_output_rollup(spark):
    p = preds(spark, [("a", 0.0, 1.0), ("a", 2.0, 2.0), ("b", 0.0, 3.0), ("b", 10.0, 10.0)])
    r = metrics.split_metrics(p).first()
    assert abs(r.rmse - math.sqrt((0.5 + 4.5) / 2)) < 1e-12  # root of the mean of the per-output errors
    assert abs(r.r2 - (1 - 10 / 52)) < 1e-12  # weighted by the spread of each output
    assert abs(r.r2_uniform_average - ((1 - 1 / 2) + (1 - 9 / 50)) / 2) < 1e-12
    one = metrics.split_metrics(p.where("output = 'a'")).first()
    assert one.r2_uniform_average is None


def test_percentage_error_with_zero_truth(spark):
    r = metrics.output_metrics(preds(spark, [("a", 0.0, 1.0), ("a", 1.0, 1.0)]), ["output"]).first()
    assert r.mape > 1e14 and math.isfinite(r.mape)


@pytest.mark.parametrize("limit", [10, 10_000])
def test_quantiles_are_exact_at_any_limit(spark, limit):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=700), np.full(300, 0.25), [1e12, -1e12]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").unionByName(spark.createDataFrame([(None,), (float("nan"),)], "x double"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = profile.exact_quantiles(df, ["x"], probs, limit=limit)["x"]
    assert np.allclose(got, np.quantile(x, probs), rtol=1e-12, atol=1e-9)


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert profile.exact_quantiles(df, ["x"], [0.5])["x"] == [None]


def test_missing_means_null_or_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (float("nan"), None), (float("inf"), "d")], "x double, s string")
    got = {r["column"]: (r.n_missing, r.n_inf) for r in roles.cell_counts(df, "t").collect()}
    assert got == {"x": (2, 1), "s": (1, 0)}
    checks = {(r.check, r["column"]) for r in profile.validate(df).collect()}
    assert ("missing", "x") in checks and ("infinite", "x") in checks and ("duplicates", None) not in checks


def test_empty_table_is_an_error(spark):
    got = profile.validate(spark.createDataFrame([], "x double, s string")).collect()
    assert [r.check for r in got] == ["empty"]


def test_duplicates_count_copies_beyond_the_first(spark):
    df = spark.createDataFrame([(1.0, "a")] * 4 + [(None, "a"), (float("nan"), "a"), (2.0, None)], "x double, s string")
    assert profile.duplicate_rows(df).first()[0] == 4  # three copies, and NULL equals NaN
    tricky = spark.createDataFrame([("a", "bc"), ("ab", "c")], "x string, y string")
    assert profile.duplicate_rows(tricky).first()[0] == 0


def test_roles_of_short_prefixes_and_groups(spark):
    names = ["year", "x1", "x2", "profile_0", "profile_10", "profile_2", "eq_R0", "other", "gamma"]
    df = spark.createDataFrame([tuple(1.0 for _ in names)], ", ".join(f"{n} double" for n in names))
    spec = roles.dataset_spec(df)
    assert spec.outputs == ["gamma", "profile_0", "profile_10", "profile_2", "year"]
    assert spec.groups["profile"] == ["profile_0", "profile_2", "profile_10"]  # numeric, not text, order
    assert "x1" in spec.inputs and "eq_R0" in spec.inputs and "other" in spec.inputs


def test_metadata_roles_replace_and_hints_add(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "input_a double, input_b double, input_c double, output_x double")
    spec = roles.dataset_spec(df, {"inputs": ["input_b", "input_a"], "outputs": ["output_x"]})
    assert spec.inputs == ["input_b", "input_a"] and spec.outputs == ["output_x"]
    hinted = roles.dataset_spec(df, hints={"outputs": ["input_c"]})
    assert hinted.outputs == ["input_c", "output_x"] and hinted.inputs == ["input_a", "input_b"]


def test_correlation_is_pairwise_complete(spark):
    rows = [(1.0, 2.0, None), (2.0, 4.1, 1.0), (3.0, float("nan"), 2.0), (4.0, 8.2, 2.5), (5.0, 9.9, 4.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    want = {(r.input, r.output): (r.n, r.r) for r in profile.correlations(df, ["a"], ["b", "c"]).collect()}
    wide = {(r.input, r.output): (r.n, r.r) for r in profile._correlations_wide(df, ["a"], ["b", "c"]).collect()}
    assert want[("a", "b")][0] == 4
    for k in want:
        assert want[k][0] == wide[k][0] and abs(want[k][1] - wide[k][1]) < 1e-9


def test_histogram_edges_and_flat_column(spark):
    df = spark.range(0, 13).select(F.col("id").cast("double").alias("x"), F.lit(7.0).alias("flat"))
    got = {(r["column"], r.bin): r.n for r in profile.histograms(df, ["x", "flat"], 12).collect()}
    assert got[("x", 11)] == 2 and got[("x", 0)] == 1  # the last bin is closed
    assert got[("flat", 6)] == 13
    assert list(np.histogram(np.arange(13.0), 12)[0]) == [got[("x", i)] for i in range(12)]


def test_range_check_is_strict_and_ignores_nan(spark):
    train = spark.createDataFrame([(0.0,), (1.0,)], "x double")
    r = drift.training_ranges(train, ["x"], [])
    block = spark.createDataFrame([(0, 1.0), (0, float("nan")), (1, 1.0000001), (2, None)], "block bigint, x double")
    got = {b.block: b.n_inputs_out for b in drift.in_range_report(drift.block_extremes(block, r), r).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_reference_of_the_first_model_or_of_each(spark):
    report = spark.createDataFrame([(0, True, True)], "block bigint, inputs_in_range boolean, outputs_in_range boolean")
    m = spark.createDataFrame([(0, "b", "o", 0.6, 1.0)], "block bigint, model string, output string, r2 double, rmse double")
    ref = spark.createDataFrame([("a", 0, 0.9, 1.0), ("b", 1, 0.62, 1.0)], "model string, ord int, r2 double, rmse double")
    shared = drift.drift_policy(report, m, ref, "o").first()
    own = drift.drift_policy(report, m, ref, "o", per_model_reference=True).first()
    assert shared.triggers == ["accuracy_drop"] and own.triggers == []
