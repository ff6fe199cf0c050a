"""Wrong answers found in review: NULL pairs, large case numbers, infinite values, probes, file names, fallbacks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from emulake.operators import campaign, drift, metrics, profile, split
from emulake.sources import artifacts, readers


def test_null_pairs_count_nowhere(spark):
    df = spark.createDataFrame([("m", 1.0, 2.0), ("m", None, 2.0), ("m", 3.0, 4.0), ("m", 9.0, None)], "model string, y_true double, y_pred double")
    a = metrics.error_sums(df, ["model"]).first()
    b = metrics.wide_error_sums(df, ["model"], {"y": ("y_true", "y_pred")}).first()
    for r in (a, b):
        assert (r.n, r.sse, r.sst) == (2, 2.0, 2.0)


def test_cases_beyond_two_to_the_31(spark):
    rows = [("run2", "sparc_1"), ("run1", "sparc_5000000000"), ("run1", "sparc_7"), ("run4294967296", "sparc_1"), ("run3", "sparc_2")]
    got = campaign.number_cases(spark.createDataFrame(rows, "run string, case string")).orderBy("case_id").collect()
    assert [(r.run, r.case) for r in got] == [rows[2], rows[1], rows[0], rows[4], rows[3]]


@pytest.mark.parametrize("switch", [0, 10_000])
def test_infinite_values_leave_correlations(spark, monkeypatch, switch):
    monkeypatch.setattr(profile, "PAIRS_IN_ONE_AGG", switch)
    df = spark.range(20).select(F.when(F.col("id") == 3, F.lit(float("inf"))).otherwise(F.col("id").cast("double")).alias("a"), (F.col("id") * 2.0).alias("b"))
    r = profile.correlations(df, ["a"], ["b"]).first()
    assert r.n == 19 and abs(r.r - 1) < 1e-9


def test_megabyte_chunks_of_later_rows(spark):
    df = spark.range(5000, 8000).select(F.col("id").alias("row_idx"), F.lit("x" * 1000).alias("t"))
    assert split.row_chunks(df, "row_idx", max_mb=1).select("chunk_id").distinct().count() <= 5


def test_uncertainty_files_by_their_stem(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.0, 1.5)], "index bigint, y_true_00 double, y_pred_00 double")
    for name in ("rf_test", "rf_test_uq"):
        df.coalesce(1).write.parquet(f"{tmp_path}/exp_uq1/{name}.parquet")
    files = [r.f for r in spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/exp_uq1").select(F.col("_metadata.file_path").alias("f")).collect()]
    kept = spark.createDataFrame([(f,) for f in files], "f string").where(~F.col("f").rlike(artifacts.UNCERTAIN)).collect()
    assert len(files) == 2 and len(kept) == 1 and "rf_test.parquet" in kept[0].f


def test_folders_are_seen_through_spark(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/cases")
    assert readers.pick_format(f"file:{tmp_path}/cases") == "parquet"
    with pytest.raises(ValueError):
        readers.pick_format(f"file:{tmp_path}/none")


def test_models_without_the_named_output_are_judged(spark):
    report = spark.createDataFrame([(1, True, True)], "block int, inputs_in_range boolean, outputs_in_range boolean")
    m = spark.createDataFrame([(1, "a", "output_0", 0.1, 1.0)], "block int, model string, output string, r2 double, rmse double")
    ref = spark.createDataFrame([("a", 0, 0.9, 1.0)], "model string, ord int, r2 double, rmse double")
    assert drift.drift_policy(report, m, ref, "gamma").first().triggers == ["accuracy_drop"]


def test_arrays_longer_than_asked_are_an_error(spark):
    from emulake.operators import nested

    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0]), (3, None)], "k int, a array<double>")
    assert [tuple(r) for r in nested.spread(df, "a", 2).orderBy("k").collect()] == [(1, 1.0, 2.0), (2, 3.0, None), (3, None, None)]
    assert artifacts.spread_payload(df, "k", {"a": 3}).columns == ["k", "a_00", "a_01", "a_02"]
    for wrong in (nested.spread(df, "a", 1), artifacts.spread_payload(df, "k", {"a": 1}).select("a_00")):
        with pytest.raises(Exception, match="more than 1 positions"):
            wrong.collect()


@pytest.mark.parametrize("tasks", [1, 8, 9, 700])
def test_blocks_merge_in_rounds(spark, tasks):
    from emulake.models.sums import summed

    df = spark.range(0, 3000, 1, tasks).select((F.col("id") * 1.0).alias("x"))
    assert summed(df, {"x": ["x"]}, lambda x: x.sum(axis=0)).tolist() == [3000 * 2999 / 2]


def _unequal(spark):
    x = F.col("id") / 40.0
    return spark.range(200).select(F.col("id").cast("string").alias("k"), F.col("id").alias("i"), x.alias("x"), (F.sin(x) * 1000).alias("big"), (x * x * 0.01).alias("small"))


def test_folds_and_trials_score_in_original_units(spark):
    from emulake.operators.scale import fit_standard
    from emulake.plans import tuning
    from emulake.spec import ModelSpec

    df = _unequal(spark)
    a, b = (tuning.cross_validate(ModelSpec("linear"), df, ["x"], ["big", "small"], ["k"], 2, standardize_outputs=s).orderBy("fold").collect() for s in (False, True))
    assert [r.rmse for r in a] == pytest.approx([r.rmse for r in b])
    train = df.withColumn("split", F.lit("train"))
    from emulake.models import REGISTRY

    scaler = fit_standard(train, ["big", "small"])
    plain, scaled = (REGISTRY.create("linear", ["x"], ["big", "small"]).fit(t) for t in (train, scaler.transform(train)))
    assert tuning.split_scores(scaled, scaler.transform(train), output_scaler=scaler)["train"]["rmse"] == pytest.approx(tuning.split_scores(plain, train)["train"]["rmse"])


@pytest.mark.parametrize("lost", [False, True])
def test_stored_run_judges_new_blocks(spark, tmp_path, monkeypatch, lost):
    from emulake.plans import evaluation, workflow

    df, out = _unequal(spark), f"{tmp_path}/run"
    workflow.run_workflow(spark, {"key": ["k"], "metadata": {"inputs": ["x"], "outputs": ["big", "small"]}, "models": [{"key": "linear"}, {"key": "linear", "name": "other"}],
                                  "standardize_outputs": True, "shuffle": False, "row_idx": "i", "cv_folds": 2, "output_dir": out}, df)
    assert set(evaluation.load_run(spark, out).models) == {"linear", "other"}
    if lost:
        whole = evaluation.load_run
        monkeypatch.setattr(evaluation, "load_run", lambda *a: (r := whole(*a), setattr(r, "ranges", None))[0])
        with pytest.raises(ValueError, match="key columns"):
            evaluation.evaluate_run(spark, out, df, "i", 60)
    got = evaluation.evaluate_run(spark, out, df, "i", 60, key=["k"]).orderBy("block", "model", "output").collect()
    assert [(r.block, r.n) for r in got] == [(b, n) for b, n in ((0, 60), (1, 60), (2, 60), (3, 20)) for _ in range(4)]
    assert [r.n_inputs_out for r in got[::4]] == [0, 0, 1, 1] and "input_ood" in got[-1].triggers
