"""Ranges, blocks, drift, trials and epochs."""

from __future__ import annotations

from pyspark.sql import functions as F

from emulake.operators import drift, trials
from emulake.plans.catalog.base import CASES, INPUTS, OUTPUTS, S, cases, register, sig, sig_all, split_sql, table

from emulake.operators import scale, split

SIZE = 1000


def stream_cases(spark, sf):
    """Events as row-indexed cases whose later blocks wander: x0 leaves its range, y loses its fit, z jumps."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("row_idx"), F.col("value"), "user_id")
    i = F.col("row_idx")
    v = F.col("value")
    x0 = F.when(i >= 8000, v * 3).otherwise(v)
    y = F.when((i >= 6000) & (i < 7000), v * v).otherwise(2 * v + (F.col("user_id") % 7))
    z = F.when(i >= 9000, v - 1000).otherwise(v)
    return e.select("row_idx", x0.alias("x0"), (F.col("user_id") * 1.0).alias("x1"), y.alias("y"), z.alias("z"),
                    (2 * v + 3).alias("y_hat"), (v * 1.0).alias("z_hat"))


STREAM = """ev AS (SELECT event_id AS row_idx, CASE WHEN event_id >= 8000 THEN value * 3 ELSE value END AS x0, user_id * 1.0::DOUBLE AS x1,
  CASE WHEN event_id >= 6000 AND event_id < 7000 THEN value * value ELSE 2 * value + user_id % 7 END AS y,
  CASE WHEN event_id >= 9000 THEN value - 1000 ELSE value END AS z, 2 * value + 3 AS y_hat, value * 1.0::DOUBLE AS z_hat, event_id // 1000 AS block FROM events),
 tr AS (SELECT * FROM ev WHERE row_idx < 4000),
 rng AS (SELECT 'x0' AS "column", 'input' AS role, 0 AS ord, min(x0) AS tlo, max(x0) AS thi FROM tr UNION ALL SELECT 'x1', 'input', 1, min(x1), max(x1) FROM tr
   UNION ALL SELECT 'y', 'output', 0, min(y), max(y) FROM tr UNION ALL SELECT 'z', 'output', 1, min(z), max(z) FROM tr),
 ext AS (SELECT block, 'x0' AS "column", min(x0) AS lo, max(x0) AS hi FROM ev GROUP BY 1 UNION ALL SELECT block, 'x1', min(x1), max(x1) FROM ev GROUP BY 1
   UNION ALL SELECT block, 'y', min(y), max(y) FROM ev GROUP BY 1 UNION ALL SELECT block, 'z', min(z), max(z) FROM ev GROUP BY 1),
 chk AS (SELECT *, lo < tlo OR hi > thi AS bad FROM ext JOIN rng USING ("column")),
 p AS (SELECT block, 'A' AS model, 'output_0' AS output, y AS y_true, y_hat AS y_pred FROM ev UNION ALL SELECT block, 'A', 'output_1', z, z_hat FROM ev)"""


def stream_pred(df, keep=("block",)):
    cells = F.array(F.struct(F.lit("output_0").alias("output"), F.col("y").alias("y_true"), F.col("y_hat").alias("y_pred")),
                    F.struct(F.lit("output_1").alias("output"), F.col("z").alias("y_true"), F.col("z_hat").alias("y_pred")))
    return df.select(*keep, F.lit("A").alias("model"), F.inline(cells))


def _parts(spark, sf):
    ev = stream_cases(spark, sf)
    ranges = drift.training_ranges(ev.where("row_idx < 4000"), ["x0", "x1"], ["y", "z"])
    blocks = drift.with_blocks(ev, "row_idx", SIZE)
    return ev, ranges, blocks


@register("a19_training_ranges", f"WITH {CASES}, {split_sql('cases', 'row_key')}, f AS (SELECT "
          + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in INPUTS) + " FROM s WHERE split = 'train') "
          + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", 'input' AS role, {i}::BIGINT AS ord, {S(f'min(({c} - m_{c}) / s_{c})')} AS lo, {S(f'max(({c} - m_{c}) / s_{c})')} AS hi FROM s, f WHERE split = 'train'" for i, c in enumerate(INPUTS))
          + " UNION ALL " + " UNION ALL ".join(f"SELECT '{c}', 'output', {i}, {S(f'min({c})')}, {S(f'max({c})')} FROM s WHERE split = 'train'" for i, c in enumerate(OUTPUTS)))
def _(spark, sf):
    train = split.split_shuffled(cases(spark, sf), ["row_key"], 0.2, 0.1).where("split = 'train'")
    z = scale.fit_standard(train, INPUTS).transform(train)
    return sig_all(drift.training_ranges(z, INPUTS, OUTPUTS), "lo", "hi")


@register("a20_ranges_from_predictions", f"WITH {CASES}, {split_sql('cases', 'row_key')} "
          + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {S(f'min({c})')} AS lo, {S(f'max({c})')} AS hi FROM s WHERE split = 'train'" for c in INPUTS + OUTPUTS))
def _(spark, sf):
    df = cases(spark, sf)
    pred = split.split_shuffled(df, ["row_key"], 0.2, 0.1).where("split = 'train'").select("row_key", F.col("revenue").alias("y_pred"))
    return sig_all(drift.ranges_from_predictions(pred, df, "row_key", INPUTS, OUTPUTS).select("column", "lo", "hi"), "lo", "hi")


@register("w10_blocks", "SELECT event_id // 1500 AS block, count(*) AS n, min(event_id) AS first_row, max(event_id) AS last_row FROM events WHERE event_id // 1500 >= 1 AND event_id // 1500 < 6 GROUP BY 1")
def _(spark, sf):
    b = drift.with_blocks(table(spark, sf, "events"), "event_id", 1500, first=1, max_blocks=5)
    return b.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_row"), F.max("event_id").alias("last_row"))


@register("j10_out_of_range", f"""WITH {STREAM} SELECT block, "column", role, {S('lo')} AS lo, {S('hi')} AS hi, {S('tlo')} AS train_lo, {S('thi')} AS train_hi FROM chk WHERE bad""")
def _(spark, sf):
    _, ranges, blocks = _parts(spark, sf)
    bad = drift.out_of_range(drift.block_extremes(blocks, ranges), ranges)
    return sig_all(bad, "lo", "hi", "train_lo", "train_hi").select("block", "column", "role", "lo", "hi", "train_lo", "train_hi")


REPORT = """rep AS (SELECT block, count(*) FILTER (role = 'input' AND bad) AS n_inputs_out, count(*) FILTER (role = 'output' AND bad) AS n_outputs_out,
 coalesce(string_agg("column", ',' ORDER BY ord) FILTER (role = 'input' AND bad), '') AS inputs_out,
 coalesce(string_agg("column", ',' ORDER BY ord) FILTER (role = 'output' AND bad), '') AS outputs_out FROM chk GROUP BY 1)"""


@register("a21_in_range_report", f"WITH {STREAM}, {REPORT} SELECT *, n_inputs_out = 0 AS inputs_in_range, n_outputs_out = 0 AS outputs_in_range FROM rep")
def _(spark, sf):
    _, ranges, blocks = _parts(spark, sf)
    r = drift.in_range_report(drift.block_extremes(blocks, ranges), ranges)
    return r.withColumns({c: F.array_join(c, ",") for c in ("inputs_out", "outputs_out")})


BM = """bm AS (SELECT block, model, output, n, 1 - sse / sst AS r2, sqrt(sse / n) AS rmse, sae / n AS mae, me, se FROM (
 SELECT block, model, output, count(*) AS n, sum((y_pred - y_true) * (y_pred - y_true)) AS sse, sum(abs(y_pred - y_true)) AS sae,
 var_pop(y_true) * count(*) AS sst, avg(y_pred - y_true) AS me, stddev_pop(y_pred - y_true) AS se FROM p GROUP BY 1, 2, 3)),
 ref AS (SELECT 1 - sum((y_pred - y_true) * (y_pred - y_true)) / (var_pop(y_true) * count(*)) AS r2, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse
  FROM p WHERE block < 4 AND output = 'output_0')"""


def _reference(ev):
    from emulake.operators.metrics import output_metrics

    train = stream_pred(ev.where("row_idx < 4000"), []).where("output = 'output_0'")
    return output_metrics(train, ["model"]).withColumn("ord", F.lit(0))


DRIFT = """jd AS (SELECT rep.block, n_inputs_out, n_outputs_out, coalesce(bm.r2 < ref.r2 - 0.1 OR bm.rmse > ref.rmse * 1.5, false) AS dropped
  FROM rep LEFT JOIN bm ON bm.block = rep.block AND output = 'output_0' CROSS JOIN ref),
 dd AS (SELECT block, concat_ws(',', CASE WHEN n_inputs_out > 0 THEN 'input_ood' END, CASE WHEN n_outputs_out > 0 THEN 'output_ood' END, CASE WHEN dropped THEN 'accuracy_drop' END) AS triggers FROM jd)"""


def _judged(spark, sf):
    ev, ranges, blocks = _parts(spark, sf)
    report = drift.in_range_report(drift.block_extremes(blocks, ranges), ranges)
    return drift.drift_policy(report, drift.block_metrics(stream_pred(blocks)), _reference(ev), "output_0")


@register("a22_drift_policy", f"WITH {STREAM}, {REPORT}, {BM}, {DRIFT} SELECT block, triggers, triggers <> '' AS drift_detected FROM dd")
def _(spark, sf):
    return _judged(spark, sf).select("block", F.array_join("triggers", ",").alias("triggers"), "drift_detected")


@register("a22_drift_summary", f"WITH {STREAM}, {REPORT}, {BM}, {DRIFT} SELECT count(*) AS n_blocks, count(*) FILTER (triggers <> '') AS n_drifted, bool_or(triggers <> '') AS drift_warning FROM dd")
def _(spark, sf):
    return drift.drift_summary(_judged(spark, sf))


@register("a23_r2_degradation", f"WITH {STREAM}, {BM} SELECT block, model, output, {S('ref.r2 - bm.r2')} AS r2_loss, {S('mae')} AS mae FROM bm, ref")
def _(spark, sf):
    ev, _, blocks = _parts(spark, sf)
    ref = _reference(ev).first()["r2"]
    return sig_all(drift.r2_degradation(drift.block_metrics(stream_pred(blocks)), ref), "r2_loss", "mae")


@register("a35_ood_evolution", f"""WITH {STREAM}, ci AS (SELECT * FROM chk WHERE role = 'input'), tops AS (SELECT "column" FROM ci WHERE bad GROUP BY 1)
 SELECT block, "column", CASE WHEN bad THEN {S('(lo - tlo) / (CASE WHEN thi = tlo THEN 1 ELSE thi - tlo END)')} END AS lo_scaled,
 CASE WHEN bad THEN {S('(hi - tlo) / (CASE WHEN thi = tlo THEN 1 ELSE thi - tlo END)')} END AS hi_scaled FROM ci WHERE "column" IN (SELECT "column" FROM tops)""")
def _(spark, sf):
    _, ranges, blocks = _parts(spark, sf)
    return sig_all(drift.ood_evolution(drift.block_extremes(blocks, ranges), ranges), "lo_scaled", "hi_scaled")


@register("k5_top_ood_inputs", f"""WITH {STREAM} SELECT "column", count(*) AS n_blocks FROM chk WHERE bad AND role = 'input' GROUP BY 1, ord ORDER BY 2 DESC, ord LIMIT 6""")
def _(spark, sf):
    _, ranges, blocks = _parts(spark, sf)
    return drift.top_ood_inputs(drift.block_extremes(blocks, ranges), ranges)


@register("e3_block_evaluation", f"""WITH {STREAM}, {REPORT}, {BM}, {DRIFT} SELECT block, model, output, n, {S('r2')} AS r2, {S('rmse')} AS rmse, {S('mae')} AS mae, {S('me')} AS mean_error,
 {S('se')} AS std_error, n_inputs_out, n_outputs_out, triggers FROM bm JOIN rep USING (block) JOIN dd USING (block)""")
def _(spark, sf):
    from emulake.plans.evaluation import evaluate_blocks

    ev, ranges, _ = _parts(spark, sf)
    e = evaluate_blocks(ev, "row_idx", SIZE, ranges, lambda rows: stream_pred(rows), _reference(ev), "output_0")
    e = e.withColumn("triggers", F.array_join("triggers", ","))
    return sig_all(e, "r2", "rmse", "mae", "mean_error", "std_error").select(
        "block", "model", "output", "n", "r2", "rmse", "mae", "mean_error", "std_error", "n_inputs_out", "n_outputs_out", "triggers")


# --- trials and epochs: orders per customer as studies -------------------------------------------------

STUDY = "st AS (SELECT o_custkey % 50 AS study, o_orderkey AS number, o_totalprice AS value FROM orders)"


def studies(spark, sf):
    return table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("study"), F.col("o_orderkey").alias("number"), F.col("o_totalprice").alias("value"))


@register("w1_best_so_far", f"""WITH {STUDY}, w AS (SELECT *, max(value) OVER (PARTITION BY study ORDER BY number) AS best_value,
  max(value) OVER (PARTITION BY study ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM st)
 SELECT study, number, value, best_value, prev IS NULL OR value > prev AS is_best_yet FROM w""")
def _(spark, sf):
    return trials.best_so_far(studies(spark, sf), direction="maximize").select("study", "number", "value", "best_value", "is_best_yet")


PATIENCE = """e AS (SELECT study AS trial, number AS epoch, value AS val_loss, row_number() OVER (PARTITION BY study ORDER BY number) AS rn,
   min(value) OVER (PARTITION BY study ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM st),
 h AS (SELECT *, max(CASE WHEN prev IS NULL OR val_loss < prev THEN rn END) OVER (PARTITION BY trial ORDER BY epoch) AS last_hit FROM e)"""


@register("w2_patience", f"WITH {STUDY}, {PATIENCE} SELECT trial, epoch, rn - last_hit AS bad_epochs FROM h")
def _(spark, sf):
    e = studies(spark, sf).toDF("trial", "epoch", "val_loss")
    return trials.patience(e).select("trial", "epoch", "bad_epochs")


@register("w2_stop_epoch", f"WITH {STUDY}, {PATIENCE} SELECT trial, min(epoch) FILTER (rn - last_hit >= 20) AS stop_epoch FROM h GROUP BY 1")
def _(spark, sf):
    e = studies(spark, sf).toDF("trial", "epoch", "val_loss")
    return trials.stop_epochs(trials.patience(e), 20)


@register("w3_best_epoch", f"WITH {STUDY} SELECT study AS trial, arg_min(number, value) AS best_epoch, min(value) AS best_loss, count(*) AS n_epochs FROM st GROUP BY 1")
def _(spark, sf):
    return trials.best_epoch(studies(spark, sf).toDF("trial", "epoch", "val_loss"))


@register("w4_convergence", "SELECT o_orderpriority AS method, max(o_totalprice) AS best_value, min(o_orderkey) FILTER (o_totalprice = m) AS best_number, count(*) AS n_trials FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_orderpriority) AS m FROM orders) GROUP BY 1")
def _(spark, sf):
    t = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("method"), F.col("o_orderkey").alias("number"), F.col("o_totalprice").alias("value"))
    return trials.convergence(t, direction="maximize")


@register("m11_promotion", f"""WITH {STUDY}, t AS (SELECT *, number % 4 AS rung, CASE WHEN number % 13 = 0 THEN NULL ELSE round(value / 500, 0) END AS v FROM st),
 r AS (SELECT study, rung, number, v AS value, CASE WHEN v IS NOT NULL THEN row_number() OVER (PARTITION BY study, rung ORDER BY v DESC NULLS LAST, number) END AS place, count(v) OVER (PARTITION BY study, rung) AS n FROM t)
 SELECT study, rung, number, value, place, coalesce(place <= greatest(n // 3, 1), false) AS goes_on FROM r""")
def _(spark, sf):
    """Which trials of each study and rung go on; one in 13 has failed, and values tie."""
    value = F.when(F.col("number") % 13 != 0, F.round(F.col("value") / 500, 0))
    t = studies(spark, sf).select("study", (F.col("number") % 4).alias("rung"), "number", value.alias("value"))
    return trials.promoted(t, 3, direction="maximize")


@register("k1_top_trials", f"WITH {STUDY} SELECT * FROM st ORDER BY value DESC, number LIMIT 5")
def _(spark, sf):
    return trials.top_trials(studies(spark, sf), 5, "maximize")


@register("k1_top_trials_ascending", f"WITH {STUDY} SELECT * FROM st ORDER BY value, number LIMIT 5")
def _(spark, sf):
    return trials.top_trials(studies(spark, sf), 5, "maximize", always_ascending=True)


@register("w9_last_lines", "SELECT file, line_no, txt FROM (SELECT source AS file, doc_id AS line_no, lang AS txt, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents) WHERE r <= 5")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("line_no"), F.col("lang").alias("txt"))
    return trials.last_lines(d, 5)
