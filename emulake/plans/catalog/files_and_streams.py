"""Sources, sinks and streams: tables are written to the shared folder and read back or followed."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from emulake.functions import times
from emulake.operators import drift, nested, split
from emulake.plans.catalog.base import CASES, S, cases, register, sig, sig_all, split_sql, table, two_models, two_models_sql
from emulake.plans.catalog.campaigns import SNAP, snapshot
from emulake.plans.catalog.monitoring import STREAM, stream_cases
from emulake.session import new_path
from emulake.sources import artifacts, readers
from emulake.streaming import monitor, progress

ORDERS = "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders"


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")


@register("s1_pick_reader", "SELECT 'parquet' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'csv', count(*) FROM orders UNION ALL SELECT 'jsonl', count(*) FROM orders")
def _(spark, sf):
    path = new_path(spark, "fmt")
    o = _orders(spark, sf)
    o.write.option("header", True).csv(path + "/a.csv")
    o.write.json(path + "/a.jsonl")
    parts = {"parquet": f"{sf}/orders.parquet", "csv": path + "/a.csv", "jsonl": path + "/a.jsonl"}
    out = None
    for kind, p in parts.items():
        one = readers.load_table(spark, p).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@register("s2_csv", ORDERS)
def _(spark, sf):
    path = new_path(spark, "csv")
    _orders(spark, sf).write.option("header", True).csv(path)
    return readers.load_table(spark, path, "csv").withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


@register("s3_parquet_pushdown", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02")
def _(spark, sf):
    return readers.load_table(spark, f"{sf}/lineitem.parquet").where("l_quantity > 45 AND l_discount < 0.02").select("l_orderkey", "l_quantity")


@register("s4_json_documents", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def _(spark, sf):
    path = new_path(spark, "docs")
    r = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.count(F.lit(1)).alias("n"))
    r.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).repartition(5).write.text(path, lineSep="\n\n")
    return readers.load_table(spark, path, "json", schema="r_regionkey bigint, r_name string, n bigint")


@register("s5_json_lines", f"WITH {SNAP} SELECT case_id, run, eq, status, started_ts, finished_ts FROM snap")
def _(spark, sf):
    path = new_path(spark, "snapshot")
    snapshot(spark, sf).write.json(path)
    return readers.read_snapshot(spark, path).drop("path")


def _mounted(path: str) -> str:
    """The shared folder as a mounted path, which array files and links need."""
    return re.sub("^file:/*", "/", path)


def _stacked(spark, sf) -> str:
    """Write events as a stacked array pair: every task fills its own rows of the two files."""
    ev = table(spark, sf, "events").select(F.col("event_id").alias("row_idx"), F.col("value").alias("a"), (F.col("value") * 2).alias("b"), F.col("user_id").cast("double").alias("y"))
    n = ev.count()
    folder = _mounted(new_path(spark, "stacked"))
    os.makedirs(folder)
    paths = {k: os.path.join(folder, f"data_nprev5_set1_{k}.npy") for k in ("data", "target")}
    for k, width in (("data", 2), ("target", 1)):
        np.lib.format.open_memmap(paths[k], mode="w+", dtype=np.float64, shape=(n, width)).flush()

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y = (np.lib.format.open_memmap(paths[k], mode="r+") for k in ("data", "target"))
        done = 0
        for pdf in batches:
            x[pdf["row_idx"]] = pdf[["a", "b"]].to_numpy()
            y[pdf["row_idx"], 0] = pdf["y"].to_numpy()
            done += len(pdf)
        x.flush()
        y.flush()
        yield pd.DataFrame({"rows": [done]})

    if ev.mapInPandas(fill, "rows bigint").agg(F.sum("rows")).first()[0] != n:
        raise RuntimeError("stacked arrays are incomplete")
    return folder


@register("s6_stacked_arrays", "SELECT event_id AS row_idx, value AS input_0, value * 2 AS input_1, user_id::DOUBLE AS output_0 FROM events")
def _(spark, sf):
    return readers.load_npy(spark, folder=_stacked(spark, sf), rows_per_partition=2500)


@register("s7_stacked_arrays_named", "SELECT event_id AS row_idx, value AS p, value * 2 AS q, user_id::DOUBLE AS target FROM events WHERE event_id >= 1000 AND event_id < 4000")
def _(spark, sf):
    f = _stacked(spark, sf)
    return readers.load_npy(spark, data=f"{f}/data_nprev5_set1_data.npy", target=f"{f}/data_nprev5_set1_target.npy", row_range=(1000, 4000),
                            input_names=["p", "q"], output_names=["target"], rows_per_partition=700)


@register("s10_frame_with_roles", f"WITH {CASES} SELECT row_key, l_tax, revenue FROM cases")
def _(spark, sf):
    from emulake.operators.roles import dataset_spec

    df = cases(spark, sf)
    spec = dataset_spec(df, {"inputs": ["l_tax"], "outputs": ["revenue"]}, key=["row_key"])
    return df.select(*spec.key, *spec.inputs, *spec.outputs)


STORED = f"{CASES}, {split_sql('cases', 'row_key')}, {two_models_sql('s', 'row_key, split')}"


@register("s12_s13_predictions", f"WITH {STORED} SELECT model, output, count(*) AS n, {S('sum(y_true)')} AS truth, {S('sum(y_pred)')} AS predicted FROM pred WHERE split IN ('val', 'test') GROUP BY 1, 2")
def _(spark, sf):
    pred = two_models(split.split_shuffled(cases(spark, sf), ["row_key"], 0.2, 0.1), ["row_key", "split"])
    path = new_path(spark, "predictions")
    artifacts.write_predictions(pred, path)
    back = artifacts.read_predictions(spark, path, splits=["val", "test"])
    return back.groupBy("model", "output").agg(F.count(F.lit(1)).alias("n"), sig(F.sum("y_true")).alias("truth"), sig(F.sum("y_pred")).alias("predicted"))


@register("s12_csv_predictions", f"WITH {STORED} SELECT model, split, count(*) AS n, {S('sum(y_pred)')} AS predicted FROM pred GROUP BY 1, 2")
def _(spark, sf):
    pred = two_models(split.split_shuffled(cases(spark, sf), ["row_key"], 0.2, 0.1), ["row_key", "split"])
    path = new_path(spark, "predictions")
    artifacts.write_predictions(pred, path, "csv")
    back = artifacts.read_predictions(spark, path, "csv")
    return back.groupBy("model", "split").agg(F.count(F.lit(1)).alias("n"), sig(F.sum("y_pred")).alias("predicted"))


@register("s13_prediction_files", "SELECT 'forest' AS model, s AS split, o_orderkey AS row_key, 0::INTEGER AS output, o_totalprice AS y_true, o_custkey::DOUBLE AS y_pred FROM orders, (SELECT unnest(['train', 'val']) AS s) WHERE (o_orderkey % 2 = 0) = (s = 'val')")
def _(spark, sf):
    """One named set of part files per model and split, written by all tasks in one job; the uncertainties are skipped on reading."""
    path = new_path(spark, "prediction-files")
    o = table(spark, sf, "orders").select(
        F.lit("forest").alias("model"), F.when(F.col("o_orderkey") % 2 == 0, "val").otherwise("train").alias("split"),
        F.col("o_orderkey").alias("index"), F.col("o_totalprice").alias("y_true_00"), F.col("o_custkey").cast("double").alias("y_pred_00"))
    artifacts.write_prediction_files(o, path)
    artifacts.write_prediction_files(o.where("index % 10 = 0"), path, uncertain=True)
    return artifacts.read_prediction_files(spark, path, 1)


@register("s14_metric_documents", f"WITH {STORED} SELECT model, split, count(*) // 2 AS n FROM pred GROUP BY 1, 2")
def _(spark, sf):
    from emulake.operators.metrics import split_metrics

    pred = two_models(split.split_shuffled(cases(spark, sf), ["row_key"], 0.2, 0.1), ["split"])
    path = new_path(spark, "metrics")
    artifacts.write_small_json(artifacts.metrics_json(split_metrics(pred), ["n", "r2", "rmse"]), path)
    docs = spark.read.schema("model string, json string").json(path)
    parsed = docs.select("model", F.explode(F.from_json("json", "map<string,struct<n:bigint,r2:double,rmse:double>>")).alias("split", "m"))
    return parsed.select("model", "split", "m.n")


@register("s15_flat_metrics", """SELECT 'm' || o_orderkey || '.train.r2' AS name, o_totalprice AS value FROM orders UNION ALL SELECT 'm' || o_orderkey || '.val.rmse', o_custkey::DOUBLE FROM orders""")
def _(spark, sf):
    k = F.col("o_orderkey").cast("string")
    doc = F.concat(F.lit('{"m'), k, F.lit('": {"train": {"r2": '), F.col("o_totalprice").cast("string"), F.lit(', "note": "text"}, "val": {"rmse": '), F.col("o_custkey").cast("string"), F.lit("}}}"))
    return artifacts.flatten_metrics(table(spark, sf, "orders").select(doc.alias("json")))


POSITIONS = 64  # of an embedding


@register("s12_spread_payload", f"SELECT vec_id, {', '.join(f'embedding[{i + 1}]::DOUBLE AS y_{i:02d}' for i in range(POSITIONS))} FROM embeddings")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("y"))
    return artifacts.spread_payload(e, "vec_id", {"y": POSITIONS})


@register("x10_spread_profile", f"SELECT vec_id, {', '.join(f'embedding[{i + 1}] AS embedding_{i}' for i in range(POSITIONS))} FROM embeddings")
def _(spark, sf):
    return nested.spread(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", POSITIONS)


@register("k4_first_cases", "SELECT 'run' || (o_custkey % 40 + 1) AS run, 'sparc_' || o_orderkey AS eq FROM orders ORDER BY o_custkey % 40, o_orderkey LIMIT 25")
def _(spark, sf):
    return snapshot(spark, sf).orderBy("case_id").limit(25).select("run", "eq")


# --- streams ---------------------------------------------------------------------------------------------


@register("r1_follow_epochs", """WITH e AS (SELECT o_custkey % 30 AS hpo_trial, o_orderkey AS epoch, o_totalprice AS val_loss FROM orders)
 SELECT hpo_trial, max(epoch) AS epoch, arg_max(val_loss / 2, epoch) AS train_loss, arg_max(val_loss, epoch) AS val_loss, min(val_loss) AS best_val_loss FROM e GROUP BY 1""")
def _(spark, sf):
    folder, out, state = (new_path(spark, t) for t in ("epochs", "latest", "epoch-state"))
    o = table(spark, sf, "orders")
    o.select(F.col("o_orderkey").alias("epoch"), (F.col("o_totalprice") / 2).alias("train_loss"), F.col("o_totalprice").alias("val_loss"),
             (F.col("o_custkey") % 30).alias("hpo_trial")).repartition(4, "epoch").write.json(folder)
    latest = progress.latest_epoch(progress.follow_epochs(spark, folder))

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(out)  # complete mode: each batch is the whole answer

    q = latest.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def _watch(spark, sf):
    ev = stream_cases(spark, sf)
    return drift.training_ranges(ev.where("row_idx < 4000"), ["x0", "x1"], ["y", "z"]), ev


REFERENCE = {"r2": 0.98, "rmse": 2.5}
WATCH = """b AS (SELECT block, count(*) AS n, sum((y_hat - y) * (y_hat - y)) AS sse, var_pop(y) * count(*) AS sst FROM ev GROUP BY 1),
 t AS (SELECT block, n, 1 - sse / sst AS r2, sqrt(sse / n) AS rmse FROM b),
 f AS (SELECT block, count(*) FILTER (role = 'input' AND bad) AS ni, count(*) FILTER (role = 'output' AND bad) AS no FROM chk GROUP BY 1)"""
TRIG = "concat_ws(',', CASE WHEN ni > 0 THEN 'input_ood' END, CASE WHEN no > 0 THEN 'output_ood' END, CASE WHEN r2 < 0.88 OR rmse > 3.75 THEN 'accuracy_drop' END)"


@register("r2_watch_blocks_stream", f"WITH {STREAM}, {WATCH} SELECT block, n, {S('r2')} AS r2, {S('rmse')} AS rmse, ni::INTEGER AS n_inputs_out, {TRIG} AS triggers FROM t JOIN f USING (block)")
def _(spark, sf):
    ranges, ev = _watch(spark, sf)
    src, out, state = (new_path(spark, t) for t in ("watch", "watched", "watch-state"))
    ev.repartition(6, "row_idx").write.parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 3).parquet(src)

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(out)

    q = monitor.watch_blocks(stream, "row_idx", 1000, ranges, ("y", "y_hat"), REFERENCE).writeStream.outputMode("complete").foreachBatch(keep).option(
        "checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    w = spark.read.parquet(out)
    return sig_all(w, "r2", "rmse").select("block", "n", "r2", "rmse", "n_inputs_out", F.array_join("triggers", ",").alias("triggers"))


@register("r2_follow_blocks_stream", f"""WITH {STREAM}, {WATCH} SELECT block, n, {S('r2')} AS r2, {S('rmse')} AS rmse, ni::INTEGER AS n_inputs_out, {TRIG} AS triggers, 0::BIGINT AS late_rows FROM t JOIN f USING (block)
 UNION ALL SELECT row_idx // 1000, 0, NULL, NULL, 0, '', count(*) FROM ev WHERE row_idx % 700 = 0 GROUP BY 1""")
def _(spark, sf):
    """Each block once, when it is full; every 700th row comes again afterwards and is counted as late."""
    ranges, ev = _watch(spark, sf)
    src, out, state = (new_path(spark, t) for t in ("follow", "followed", "follow-state"))
    ev.repartition(6, "row_idx").write.parquet(f"{src}/rows")
    n = ev.count()
    schema = ev.schema

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).option("recursiveFileLookup", True).parquet(src)
        kept = monitor.follow_blocks(stream, "row_idx", 1000, ranges, ("y", "y_hat"), REFERENCE, total_rows=n, shards=8)
        kept.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    run()
    ev.where("row_idx % 700 = 0").coalesce(3).write.parquet(f"{src}/late")
    run()  # goes on from its checkpoint
    w = sig_all(spark.read.parquet(out), "r2", "rmse")
    brief = w.groupBy("block", "n").agg(F.max("r2").alias("r2"), F.max("rmse").alias("rmse"), F.max("n_inputs_out").alias("n_inputs_out"), F.max(F.array_join("triggers", ",")).alias("triggers"), F.sum("late_rows").alias("late_rows"))
    return brief.select("block", "n", "r2", "rmse", "n_inputs_out", "triggers", "late_rows")


@register("r2_watch_windows_stream", """WITH m AS (SELECT max(ts) AS last FROM events), w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, value FROM events),
 r AS (SELECT max(value) AS hi, min(value) AS lo FROM events WHERE event_id < 4000)
 SELECT window_start::TIMESTAMP AS window_start, count(*) AS n, max(value) > max(r.hi) OR min(value) < min(r.lo) AS drift_detected FROM w, r, m GROUP BY window_start, last HAVING window_start + INTERVAL 1 DAY <= last - INTERVAL 2 HOUR""")
def _(spark, sf):
    ev = table(spark, sf, "events").select(times.instant_of(F.col("ts")).alias("ts"), "event_id", "value")
    ranges = drift.training_ranges(ev.where("event_id < 4000"), ["value"], [])
    src, out, state = (new_path(spark, t) for t in ("windows", "windowed", "window-state"))
    ev.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    q = monitor.watch_windows(stream, "ts", "1 day", ranges, watermark="2 hours").writeStream.outputMode("append").format("parquet").option(
        "path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    w = spark.read.parquet(out)
    return w.select(times.wall_of(F.col("window_start")).alias("window_start"), "n", "drift_detected")


@register("r3_snapshot_log", f"""WITH {SNAP}, t AS (SELECT unnest([0, 1, 2]) AS k), h AS (SELECT k, case_id, CASE WHEN case_id % 3 <= k THEN status ELSE 'pending' END AS status FROM snap, t),
 c AS (SELECT *, lag(status) OVER (PARTITION BY case_id ORDER BY k) AS was FROM h)
 SELECT 'snapshot=' || k AS snapshot, printf('finished=%d inflight=%d started=%d pending=%d', count(*) FILTER (status = 'finished'), count(*) FILTER (status = 'inflight'), count(*) FILTER (status = 'started'), count(*) FILTER (status = 'pending')) AS line,
 count(*) FILTER (was IS NULL) AS new, count(*) FILTER (was <> status) AS changed, count(*) FILTER (was <> status AND status = 'finished') AS newly_finished FROM c GROUP BY k""")
def _(spark, sf):
    """Three snapshots of all cases, of which a third more shows its true status each time."""
    folder, out, state = (new_path(spark, t) for t in ("snapshots", "snapshot-log", "snapshot-state"))
    s = snapshot(spark, sf)
    for i in range(3):
        s.withColumn("status", F.when(F.col("case_id") % 3 <= i, F.col("status")).otherwise("pending")).write.json(f"{folder}/snapshot={i}")
    q = progress.log_changes(progress.follow_snapshots(spark, folder), out, state)
    q.awaitTermination()
    return progress.snapshot_log(spark, out).select("snapshot", "line", "new", "changed", "newly_finished")


@register("r3_snapshot_counts", f"WITH {SNAP} SELECT printf('finished=%d inflight=%d started=%d pending=%d', count(*) FILTER (status = 'finished'), count(*) FILTER (status = 'inflight'), count(*) FILTER (status = 'started'), count(*) FILTER (status = 'pending')) AS line FROM snap GROUP BY case_id % 3")
def _(spark, sf):
    folder, out, state = (new_path(spark, t) for t in ("snapshots", "snapshot-log", "snapshot-state"))
    s = snapshot(spark, sf)
    for i in range(3):
        s.where(F.col("case_id") % 3 == i).write.json(f"{folder}/snapshot={i}")
    q = progress.log_snapshots(progress.follow_snapshots(spark, folder), out, state)
    q.awaitTermination()
    return spark.read.json(out).select("line")
