"""Splits, folds, sampling, batches and scaling on the case table."""

from __future__ import annotations

from pyspark.sql import functions as F

from emulake.functions import times
from emulake.operators import ordered, rank, scale, split
from emulake.plans.catalog.base import (
    CASES, INPUTS, OUTPUTS, S, cases, hash_sql, ranked_sql, register, sig, sig_all, split_sql, table,
)
from emulake.session import materialize

KEY = ["row_key"]


@register("t1_split_shuffled", f"WITH {CASES}, {split_sql('cases', 'row_key')} SELECT row_key, split FROM s")
def _(spark, sf):
    return split.split_shuffled(cases(spark, sf), KEY, 0.2, 0.1).select("row_key", "split")


@register("t2_split_tail", """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events),
 n AS (SELECT count(*) AS n, ceil(0.2::DOUBLE * count(*))::BIGINT AS nt FROM events),
 m AS (SELECT n, nt, ceil(0.125::DOUBLE * (n - nt))::BIGINT AS nv FROM n)
 SELECT event_id, CASE WHEN i < n - nt - nv THEN 'train' WHEN i < n - nt THEN 'val' ELSE 'test' END AS split FROM r, m""")
def _(spark, sf):
    ev = table(spark, sf, "events").withColumn("us", times.epoch_of(F.col("ts"), "MICROSECOND"))
    ranked = ordered.ordered_rank(ev, "us", ties=["event_id"]).withColumn("row_idx", F.col("rank") - 1)
    return split.split_tail(ranked, "row_idx", 0.2, 0.1).select("event_id", "split")


@register("t3_kfold", f"""WITH r AS ({ranked_sql('orders', 'o_orderkey')}), n AS (SELECT count(*) AS n FROM orders)
 SELECT o_orderkey, CASE WHEN rk <= (n % 7) * (n // 7 + 1) THEN (rk - 1) // (n // 7 + 1)
   ELSE n % 7 + (rk - 1 - (n % 7) * (n // 7 + 1)) // (n // 7) END AS fold FROM r, n""")
def _(spark, sf):
    out = split.kfold(table(spark, sf, "orders"), ["o_orderkey"], 7)
    return out.select("o_orderkey", F.col("fold").cast("bigint").alias("fold"))


@register("t4_repeated_kfold", f"""WITH reps AS (SELECT unnest([0, 1, 2]) AS rep), x AS (SELECT o_orderkey, rep FROM orders, reps),
 r AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY {hash_sql('42 + rep', 'o_orderkey')}, o_orderkey) AS rk FROM x),
 n AS (SELECT count(*) AS n FROM orders)
 SELECT rep::BIGINT AS repeat, CASE WHEN rk <= (n % 4) * (n // 4 + 1) THEN (rk - 1) // (n // 4 + 1)
   ELSE n % 4 + (rk - 1 - (n % 4) * (n // 4 + 1)) // (n // 4) END AS fold, count(*) AS n_rows, sum(o_orderkey)::BIGINT AS key_sum
 FROM r, n GROUP BY 1, 2""")
def _(spark, sf):
    out = split.repeated_kfold(table(spark, sf, "orders"), ["o_orderkey"], 4, 3)
    return out.groupBy(F.col("repeat").cast("bigint").alias("repeat"), F.col("fold").cast("bigint").alias("fold")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("o_orderkey").alias("key_sum"))


@register("t5_split_stratified", f"""WITH r AS ({ranked_sql('orders', 'o_orderkey', partition='o_orderpriority')}),
 n AS (SELECT o_orderpriority, count(*) AS n, ceil(0.2::DOUBLE * count(*))::BIGINT AS nt FROM orders GROUP BY 1),
 m AS (SELECT *, ceil(0.25::DOUBLE * (n - nt))::BIGINT AS nv FROM n)
 SELECT o_orderkey, o_orderpriority, CASE WHEN rk <= nt THEN 'test' WHEN rk <= nt + nv THEN 'val' ELSE 'train' END AS split
 FROM r JOIN m USING (o_orderpriority)""")
def _(spark, sf):
    out = split.split_stratified(table(spark, sf, "orders"), ["o_orderkey"], "o_orderpriority", 0.2, 0.2)
    return out.select("o_orderkey", "o_orderpriority", "split")


def _scaled(spark, sf):
    s = split.split_shuffled(cases(spark, sf), KEY, 0.2, 0.1)
    sc = scale.fit_standard(s.where("split = 'train'"), INPUTS + OUTPUTS)
    return s, sc


FIT = ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in INPUTS + OUTPUTS)
FITTED = f"fit AS (SELECT {FIT} FROM s WHERE split = 'train')"


@register("t6_standardize", f"WITH {CASES}, {split_sql('cases', 'row_key')}, {FITTED} SELECT row_key, split, "
          + ", ".join(f"{S(f'({c} - m_{c}) / s_{c}')} AS {c}" for c in INPUTS + OUTPUTS) + " FROM s, fit")
def _(spark, sf):
    s, sc = _scaled(spark, sf)
    return sig_all(sc.transform(s), *INPUTS, *OUTPUTS).select("row_key", "split", *INPUTS, *OUTPUTS)


@register("t7_stored_scaler", f"WITH {CASES}, {split_sql('cases', 'row_key')}, {FITTED} SELECT split, count(*) AS n, "
          + ", ".join(f"{S(f'avg(({c} - m_{c}) / s_{c})')} AS mean_{c}, {S(f'stddev_pop(({c} - m_{c}) / s_{c})')} AS std_{c}" for c in INPUTS)
          + " FROM s, fit GROUP BY split")
def _(spark, sf):
    s, sc = _scaled(spark, sf)
    stored = materialize(sc.to_frame(spark), "scaler")
    scaled = scale.Scaler.from_frame(stored).transform(s)
    return scaled.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), *[sig(F.avg(c)).alias(f"mean_{c}") for c in INPUTS],
        *[sig(F.stddev_pop(c)).alias(f"std_{c}") for c in INPUTS])


@register("t8_inverse_transform", f"WITH {CASES} SELECT row_key, {S('0.95::DOUBLE * revenue')} AS y_pred FROM cases")
def _(spark, sf):
    df = cases(spark, sf)
    sc = scale.fit_standard(df, ["revenue"])
    m, s = sc.params["revenue"]
    scaled = df.withColumn("y_pred", (F.col("revenue") * 0.95 - m) / s)  # a prediction in scaled units
    return sc.inverse(scaled, {"y_pred": "revenue"}).select("row_key", sig("y_pred").alias("y_pred"))


@register("t9_minmax", f"""WITH {CASES}, f AS (SELECT *, 5.0::DOUBLE AS flat FROM cases)
 SELECT row_key, {S('(l_quantity - (SELECT min(l_quantity) FROM f)) / ((SELECT max(l_quantity) FROM f) - (SELECT min(l_quantity) FROM f))')} AS l_quantity,
 {S('(revenue - (SELECT min(revenue) FROM f)) / ((SELECT max(revenue) FROM f) - (SELECT min(revenue) FROM f))')} AS revenue, flat FROM f""")
def _(spark, sf):
    df = cases(spark, sf).withColumn("flat", F.lit(5.0))
    sc = scale.fit_minmax(df, ["l_quantity", "revenue", "flat"])
    return sig_all(sc.transform(df), "l_quantity", "revenue").select("row_key", "l_quantity", "revenue", "flat")


@register("t10_epoch_sample", f"""WITH e AS (SELECT unnest([0, 1, 2]) AS epoch), x AS (SELECT o_orderkey, epoch FROM orders, e),
 r AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY {hash_sql('42 * 1000003 + epoch', 'o_orderkey')}, o_orderkey) AS rk FROM x)
 SELECT epoch::BIGINT AS epoch, o_orderkey FROM r WHERE rk <= greatest(1, floor((SELECT count(*) FROM orders) * 0.3::DOUBLE))""")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey")
    parts = [split.epoch_sample(df, ["o_orderkey"], 0.3, e).withColumn("epoch", F.lit(e).cast("bigint")) for e in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("epoch", "o_orderkey")


@register("p5_sample_exact", f"WITH r AS ({ranked_sql('orders', 'o_orderkey', 7)}) SELECT o_orderkey, o_totalprice FROM r WHERE rk <= 1234")
def _(spark, sf):
    return rank.sample_exact(table(spark, sf, "orders"), 1234, ["o_orderkey"], 7).select("o_orderkey", "o_totalprice")


@register("p6_row_range", "SELECT event_id, value FROM events WHERE event_id >= 2000 AND event_id < 7000")
def _(spark, sf):
    return split.row_range(table(spark, sf, "events"), "event_id", 2000, 7000).select("event_id", "value")


@register("p12_row_chunks", """SELECT event_id // 777 AS chunk_id, count(*) AS n_rows, min(event_id) AS first_row, max(event_id) AS last_row
 FROM events GROUP BY 1""")
def _(spark, sf):
    return split.row_chunks(table(spark, sf, "events"), "event_id", 777).groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("event_id").alias("first_row"), F.max("event_id").alias("last_row"))


@register("s17_batches", f"""WITH r AS ({ranked_sql('orders', 'o_orderkey')})
 SELECT (rk - 1) // 512 AS batch_id, count(*) AS n_rows, sum(o_orderkey)::BIGINT AS key_sum, max((rk - 1) % 512) AS last_pos FROM r GROUP BY 1""")
def _(spark, sf):
    return split.batches(table(spark, sf, "orders"), ["o_orderkey"], 512, seed=42).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("o_orderkey").alias("key_sum"), F.max("pos").alias("last_pos"))


@register("s17_batch_arrays", f"""WITH r AS ({ranked_sql('orders', 'o_orderkey')}), b AS (
 SELECT (rk - 1) // 256 AS batch_id, (rk - 1) % 256 AS pos, o_totalprice::FLOAT AS p FROM r)
 SELECT batch_id, count(*)::INTEGER AS n_rows, max(p) FILTER (pos = 0) AS first_value, max(p) FILTER (pos = 255) AS last_value FROM b GROUP BY 1""")
def _(spark, sf):
    b = split.batches(table(spark, sf, "orders"), ["o_orderkey"], 256, seed=42)
    packed = split.batch_arrays(b, ["o_totalprice"])
    return packed.select("batch_id", "n_rows", F.col("features")[0][0].alias("first_value"),
                         F.get(F.get("features", 255), 0).alias("last_value"))
