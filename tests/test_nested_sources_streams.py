from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from emulake.operators import drift, nested, trials
from emulake.session import new_path
from emulake.sources import artifacts, readers
from emulake.streaming import monitor, progress

SPEC = [[{"re": 3.0, "im": 4.0}] * 5 for _ in range(4)]


def record(spark, **changes):
    q = [1.2 + 2.8 * i / 19 for i in range(20)]
    doc = {"run_id": "r0", "eq_id": "e0", "miller": {"R0": 1.8, "a": 0.55, "kappa": 2.0, "delta": 0.35},
           "parset": {"names": ["ntor", "pscale", "batemanscale"], "values": [3.0, 1.0, 1.0]},
           "q": {"psin": [i / 19 for i in range(20)], "profile": q}, "p": {"profile": [1.0 - 0.9 * i / 19 for i in range(20)]},
           "m_modes": [-2, -1, 0, 1], "spec": SPEC, **changes}
    path = new_path(spark, "record")
    spark.createDataFrame([(json.dumps(doc),)], "value string").write.text(path)
    return spark.read.schema(nested.RECORD).json(path)


NAMES = ["ntor", "pscale", "batemanscale"]


def test_record_hand_values(spark):
    t = nested.case_table(record(spark), NAMES).first()
    assert (t.q0, t.qmin, t.p0) == (1.2, 1.2, 1.0) and abs(t.q95 - (1.2 + 2.8 * 18 / 19)) < 1e-12
    assert (t.eq_R0, t.input_ntor) == (1.8, 3.0)
    assert list(t.output_p) == [5.0] * 20
    given = nested.case_table(record(spark, q95=4.0), NAMES).first()
    assert given.q95 == 4.0


def test_mode_rows(spark):
    rows = nested.mode_table(record(spark), NAMES).orderBy("m").collect()
    assert [r.m for r in rows] == [-2, -1, 0, 1] and all(r.n == 3.0 and len(r.output_p) == 5 for r in rows)


def test_resample_keeps_corners_and_identity(spark):
    from emulake.functions import arrays

    m = [[float(10 * i + j) for j in range(5)] for i in range(4)]
    df = spark.createDataFrame([(m,)], "m array<array<double>>")
    same = df.select(arrays.resample(F.col("m"), 4, 5).alias("m")).first().m
    assert np.allclose(same, m)
    up = np.array(df.select(arrays.resample(F.col("m"), 7, 9).alias("m")).first().m)
    assert up.shape == (7, 9) and up[0, 0] == 0 and up[-1, -1] == 34 and abs(up[1, 1] - 5.5) < 1e-12


def test_prediction_keys_survive_sampling(spark):
    data = spark.range(100).select(F.col("id").alias("row_key"), (F.col("id") * 2.0).alias("x"))
    pred = data.where("row_key % 7 = 3").select("row_key", (F.col("x") + 1).alias("y_pred"))
    got = nested.recover_rows(pred, data).where("y_pred <> x + 1").count()
    assert got == 0
    filled = nested.attach_predictions(data, pred, "m")
    assert filled.where("row_key = 0").first().m_y_pred == 0.0 and filled.count() == 100


def test_stacked_arrays(spark, tmp_path):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(1000, 3)), rng.normal(size=1000)
    np.save(tmp_path / "data_nprev5_set1_data.npy", x)
    np.save(tmp_path / "data_nprev5_set1_target.npy", y)
    df = readers.load_npy(spark, folder=str(tmp_path), rows_per_partition=300)
    assert df.columns == ["row_idx", "input_0", "input_1", "input_2", "output_0"] and df.count() == 1000
    part = readers.load_npy(spark, folder=str(tmp_path), row_range=(250, 610)).orderBy("row_idx").collect()
    assert len(part) == 360 and part[0].input_1 == x[250, 1] and part[-1].output_0 == y[609]
    pushed = df.where("row_idx >= 990 AND row_idx < 995").collect()
    assert sorted(r.row_idx for r in pushed) == [990, 991, 992, 993, 994]
    assert readers.load_table(spark, str(tmp_path), sample=17).count() == 17
    with pytest.raises(Exception, match="names"):
        readers.load_npy(spark, data=str(tmp_path / "data_nprev5_set1_data.npy"), input_names=["a"]).count()
    with pytest.raises(Exception, match="set_name"):
        readers.load_npy(spark, folder=str(tmp_path), set_name="other").count()


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        readers.load_table(spark, "/tmp/x.xyz")
    assert readers.pick_format("a.pq") == "parquet" and readers.pick_format("x", "CSV") == "csv"


def test_more_than_a_hundred_outputs_keep_their_number(spark):
    cols = [F.lit(1).cast("bigint").alias("index")] + [F.lit(float(i)).alias(f"y_true_{i:02d}") for i in range(120)] + [F.lit(float(i)).alias(f"y_pred_{i:02d}") for i in range(120)]
    path = new_path(spark, "wide")
    spark.range(1).select(*cols).coalesce(1).write.parquet(path)
    name = next(f for f in os.listdir(path) if f.endswith(".parquet"))
    os.makedirs(path + "-named")
    os.link(os.path.join(path, name), path + "-named/forest_val.parquet")
    got = artifacts.read_prediction_files(spark, path + "-named", 120)
    assert got.where("output <> y_true").count() == 0 and got.select("model", "split").distinct().first()[:] == ("forest", "val")


def test_top_trials_follow_the_direction(spark):
    t = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3, 1, 2, 9])], "number bigint, value double")
    assert [r.number for r in trials.top_trials(t, 2, "maximize").collect()] == [3, 0]
    assert [r.number for r in trials.top_trials(t, 2, "maximize", always_ascending=True).collect()] == [1, 2]


def test_patience_counts_equal_values_as_bad(spark):
    e = spark.createDataFrame([(0, i, v) for i, v in enumerate([3.0, 2.0, 2.0, 2.5, 1.0])], "trial int, epoch int, val_loss double")
    got = [r.bad_epochs for r in trials.patience(e).orderBy("epoch").collect()]
    assert got == [0, 0, 1, 2, 0]


def test_epoch_log_round_trip(spark):
    folder = new_path(spark, "epochs")
    progress.append_epochs(spark, [{"epoch": 1, "train_loss": 2.0, "val_loss": 3.0}, {"epoch": 2, "train_loss": 1.0, "val_loss": 4.0}], folder, 7)
    got = progress.latest_epoch(readers.read_epochs(spark, folder)).first()
    assert (got.hpo_trial, got.epoch, got.val_loss, got.best_val_loss) == (7, 2, 4.0, 3.0)


def _events(spark):
    return spark.range(3000).select(
        F.col("id").alias("row_idx"), F.timestamp_seconds(F.col("id") * 60).alias("ts"),
        F.when(F.col("id") >= 2000, F.col("id") % 10 + 50).otherwise(F.col("id") % 10).cast("double").alias("x"),
        (F.col("id") % 10).cast("double").alias("y"), F.when(F.col("id").between(1000, 1499), 0).otherwise(F.col("id") % 10).cast("double").alias("p"))


def _run_stream(spark, watched, mode, out):
    if mode == "complete":
        w = watched.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out))
    else:
        w = watched.writeStream.outputMode("append").format("parquet").option("path", out)
    w.option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def test_block_stream_equals_batch(spark):
    ev = _events(spark)
    ranges = drift.training_ranges(ev.where("row_idx < 1000"), ["x"], ["y"])
    ref = {"r2": 1.0, "rmse": 0.1}
    src = new_path(spark, "events")
    ev.repartition(5, "row_idx").write.parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = _run_stream(spark, monitor.watch_blocks(stream, "row_idx", 500, ranges, ("y", "p"), ref), "complete", new_path(spark, "out"))
    want = monitor.watch_blocks(ev, "row_idx", 500, ranges, ("y", "p"), ref)
    cols = ["block", "n", "n_inputs_out", "inputs_out", "triggers", "drift_detected"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    table = {r.block: r.triggers for r in want.collect()}
    assert table[0] == [] and table[2] == ["accuracy_drop"] and table[4] == ["input_ood"]


def test_window_stream_appends_closed_windows_only(spark):
    ev = _events(spark)
    ranges = drift.training_ranges(ev.where("row_idx < 1000"), ["x"], [])
    src = new_path(spark, "events")
    ev.repartitionByRange(3, "ts").write.parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    got = _run_stream(spark, monitor.watch_windows(stream, "ts", "10 hours", ranges, watermark="1 hour"), "append", new_path(spark, "out"))
    want = {str(r.window_start): (r.n, r.drift_detected) for r in monitor.watch_windows(ev, "ts", "10 hours", ranges).collect()}
    seen = {str(r.window_start): (r.n, r.drift_detected) for r in got.collect()}
    assert len(seen) == len(want) - 1 and all(want[k] == v for k, v in seen.items())
