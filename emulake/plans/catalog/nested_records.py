"""Nested case records built from the embeddings table, and assembling joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from emulake.functions import arrays
from emulake.operators import nested
from emulake.plans.catalog.base import CASES, S, cases, register, sig, sig_all, table

NAMES = ["ntor", "pscale", "batemanscale"]


def records(spark, sf):
    """One record per embedding: 20-point profiles, a 4 x 5 complex spectrum, parameters from the key."""
    d = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    k = F.col("vec_id").cast("double")
    spec = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(
        F.sequence(F.lit(0), F.lit(4)), lambda j: F.struct(
            F.get("e", i * 5 + j + 40).alias("re"), F.get("e", i * 5 + j).alias("im"))))
    return d.select(
        F.col("vec_id").cast("string").alias("run_id"), F.col("label").cast("string").alias("eq_id"),
        F.struct((k / 100).alias("R0"), F.lit(0.55).alias("a"), F.lit(2.0).alias("kappa"), F.lit(0.35).alias("delta")).alias("miller"),
        F.struct(F.array(*[F.lit(n) for n in NAMES]).alias("names"), F.array(k % 10, k * 0.5, F.lit(1.0)).alias("values")).alias("parset"),
        F.struct(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: i / 19.0).alias("psin"), F.slice("e", 1, 20).alias("profile")).alias("q"),
        F.struct(F.slice("e", 21, 20).alias("profile")).alias("p"),
        F.when(F.col("vec_id") % 5 == 0, F.lit(4.25)).alias("q95"),
        F.array(*[F.lit(m) for m in (-2, -1, 0, 1)]).alias("m_modes"), spec.alias("spec"))


E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
MAG = "m AS (SELECT vec_id, i, j, sqrt(e[i * 5 + j + 41] ** 2 + e[i * 5 + j + 1] ** 2) AS v FROM e, (SELECT unnest(range(4)) AS i), (SELECT unnest(range(5)) AS j))"


@register("x8_derived_scalars", f"""WITH {E} SELECT vec_id::VARCHAR AS run_id, {S('e[1]')} AS q0, {S('list_min(e[1:20])')} AS qmin,
 {S('CASE WHEN vec_id % 5 = 0 THEN 4.25 ELSE e[19] END')} AS q95, {S('e[21]')} AS p0, {S('vec_id / 100')} AS "eq_R0" FROM e""")
def _(spark, sf):
    r = records(spark, sf)
    return sig_all(r.select("run_id", *nested.features(r, NAMES)), "q0", "qmin", "q95", "p0", "eq_R0").select("run_id", "q0", "qmin", "q95", "p0", "eq_R0")


@register("x9_named_parameters", f"""SELECT vec_id::VARCHAR AS run_id, (vec_id % 10)::DOUBLE AS input_ntor, vec_id * 0.5::DOUBLE AS input_pscale, 1.0::DOUBLE AS input_batemanscale FROM embeddings""")
def _(spark, sf):
    r = records(spark, sf)
    return r.select("run_id", *nested.features(r, NAMES)).select("run_id", "input_ntor", "input_pscale", "input_batemanscale")


@register("x7_complex_magnitude", f"WITH {E}, {MAG} SELECT vec_id::VARCHAR AS run_id, i::INTEGER AS i, j::INTEGER AS j, {S('v')} AS v FROM m")
def _(spark, sf):
    r = records(spark, sf).select("run_id", F.posexplode(arrays.magnitude(F.col("spec"))).alias("i", "row"))
    return r.select("run_id", "i", F.posexplode("row").alias("j", "v")).withColumn("v", sig("v"))


@register("x10_case_table", f"WITH {E}, {MAG} SELECT vec_id::VARCHAR AS run_id, 20::INTEGER AS n_outputs, {S('sum(v)')} AS total, {S('max(v) FILTER (i = 3 AND j = 4)')} AS last FROM m GROUP BY vec_id")
def _(spark, sf):
    t = nested.case_table(records(spark, sf), NAMES)
    total = F.aggregate("output_p", F.lit(0.0), lambda a, x: a + x)
    return t.select("run_id", F.size("output_p").alias("n_outputs"), sig(total).alias("total"), sig(F.get("output_p", 19)).alias("last"))


@register("p10_thinned_spectrum", f"WITH {E}, {MAG} SELECT vec_id::VARCHAR AS run_id, count(*)::INTEGER AS n_outputs, {S('sum(v)')} AS total FROM m WHERE i % 2 = 0 AND j % 3 = 0 GROUP BY vec_id")
def _(spark, sf):
    t = nested.case_table(records(spark, sf), NAMES, mode_step=2, point_step=3)
    total = F.aggregate("output_p", F.lit(0.0), lambda a, x: a + x)
    return t.select("run_id", F.size("output_p").alias("n_outputs"), sig(total).alias("total"))


@register("p11_resampled_spectrum", f"""WITH {E}, {MAG}, g AS (SELECT oi, oj, oi * 3 / 6.0::DOUBLE AS a, oj * 4 / 2.0::DOUBLE AS b FROM (SELECT unnest(range(7)) AS oi), (SELECT unnest(range(3)) AS oj)),
 h AS (SELECT *, floor(a)::BIGINT AS i0, least(floor(a)::BIGINT + 1, 3) AS i1, a - floor(a) AS wa, floor(b)::BIGINT AS j0, least(floor(b)::BIGINT + 1, 4) AS j1, b - floor(b) AS wb FROM g)
 SELECT m.vec_id::VARCHAR AS run_id, oi::INTEGER AS i, oj::INTEGER AS j, {S('sum(v * (CASE WHEN i = i0 THEN 1 - wa ELSE 0 END + CASE WHEN i = i1 THEN wa ELSE 0 END) * (CASE WHEN j = j0 THEN 1 - wb ELSE 0 END + CASE WHEN j = j1 THEN wb ELSE 0 END))')} AS v
 FROM m, h GROUP BY ALL""")
def _(spark, sf):
    r = records(spark, sf).select("run_id", F.posexplode(arrays.resample(arrays.magnitude(F.col("spec")), 7, 3)).alias("i", "row"))
    return r.select("run_id", "i", F.posexplode("row").alias("j", "v")).withColumn("v", sig("v"))


@register("x11_mode_rows", f"""WITH {E}, {MAG} SELECT vec_id::VARCHAR AS run_id, (vec_id % 10)::DOUBLE AS n, i - 2 AS m, {S('max(v) FILTER (j = 0)')} AS first, {S('max(v) FILTER (j = 4)')} AS last
 FROM m GROUP BY vec_id, i""")
def _(spark, sf):
    t = nested.mode_table(records(spark, sf), NAMES)
    return t.select("run_id", "n", "m", sig(F.get("output_p", 0)).alias("first"), sig(F.get("output_p", 4)).alias("last"))


@register("a31_mode_amplitudes", f"WITH {E}, {MAG} SELECT vec_id::VARCHAR AS run_id, i::INTEGER AS mode_idx, {S('max(v)')} AS amplitude FROM m WHERE i < 3 GROUP BY vec_id, i")
def _(spark, sf):
    return sig_all(nested.mode_amplitudes(records(spark, sf), 3), "amplitude")


@register("x12_flatten_run", f"""WITH {E} SELECT vec_id::VARCHAR AS run_id, 'input_scale' AS name, {S('vec_id * 0.5::DOUBLE')} AS value FROM e UNION ALL
 SELECT vec_id::VARCHAR, 'input_shape_' || i, {S('e[i + 1]')} FROM e, (SELECT unnest(range(3)) AS i) UNION ALL
 SELECT vec_id::VARCHAR, 'output_dp_' || i, {S('e[i + 11]')} FROM e, (SELECT unnest(range(5)) AS i)""")
def _(spark, sf):
    d = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    runs = d.select(F.col("vec_id").cast("string").alias("run_id"),
                    F.create_map(F.lit("scale"), F.array(F.col("vec_id") * 0.5), F.lit("shape"), F.slice("e", 1, 3)).alias("inp"),
                    F.create_map(F.lit("dp"), F.slice("e", 11, 5)).alias("out"))
    return sig_all(nested.flatten_run(runs, {"inp": "input", "out": "output"}), "value")


@register("j2_attach_equilibrium", f"""WITH d AS (SELECT s_nationkey AS id, arg_min(s_acctbal, s_name) AS a, arg_min(s_suppkey, s_name) AS k FROM supplier GROUP BY 1)
 SELECT c_custkey, c_nationkey AS eqid, {S('a')} AS eq_a, {S('k * 1.0')} AS q0, {S('k * 1.0 + 9')} AS q95, {S('k * 1.0')} AS qmin, {S('a / 2')} AS p0 FROM customer LEFT JOIN d ON d.id = c_nationkey""")
def _(spark, sf):
    k = F.col("s_suppkey").cast("double")
    eq = table(spark, sf, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_nationkey").alias("id"), F.col("s_acctbal").alias("a"),
        F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: k + i).alias("qpsi"), F.array(F.col("s_acctbal") / 2).alias("pres"))
    runs = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("eqid"))
    return sig_all(nested.attach_equilibrium(runs, eq), "eq_a", "q0", "q95", "qmin", "p0")


@register("s11_grid_to_long", f"WITH {E} SELECT vec_id, (label * 10 + i)::DOUBLE AS psi, j * 0.5::DOUBLE AS t, {S('e[i * 4 + j + 1]')} AS value FROM e, (SELECT unnest(range(8)) AS i), (SELECT unnest(range(4)) AS j)")
def _(spark, sf):
    d = table(spark, sf, "embeddings")
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 4 + 1, 4))
    g = d.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.col("label") * 10 + i).cast("double")).alias("psi_axis"),
                 F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: j * 0.5).alias("t_axis"), grid.alias("v"))
    return sig_all(nested.grid_to_long(g, {"psi": "psi_axis", "t": "t_axis"}, "v", keep=["vec_id"]), "value")


@register("u1_stack_cases", """SELECT o_orderkey AS id, o_totalprice AS price, NULL::BIGINT AS part FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL
 SELECT p_partkey, NULL, p_size FROM part""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("price"))
    good, _ = nested.split_rejects(o, ["price"])
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("bigint").alias("part"))
    return nested.stack_cases([good, p])


@register("u1_rejects", "SELECT o_orderkey AS id, 'price' AS missing_field FROM orders WHERE o_orderkey % 3 = 0")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("price"))
    return nested.split_rejects(o, ["price"])[1].select("id", "missing_field")


@register("j1_recover_rows", f"WITH {CASES} SELECT row_key, {S('l_extendedprice * 0.95::DOUBLE')} AS y_pred, l_quantity, {S('revenue')} AS revenue FROM cases")
def _(spark, sf):
    df = cases(spark, sf)
    pred = df.select("row_key", (F.col("l_extendedprice") * 0.95).alias("y_pred"))
    return sig_all(nested.recover_rows(pred, df), "y_pred", "revenue").select("row_key", "y_pred", "l_quantity", "revenue")


@register("j3_side_by_side", "SELECT event_id AS row_idx, value AS input_0, user_id AS output_0 FROM events")
def _(spark, sf):
    ev = table(spark, sf, "events")
    return nested.side_by_side(ev.select(F.col("event_id").alias("row_idx"), F.col("value").alias("input_0")),
                               ev.select(F.col("event_id").alias("row_idx"), F.col("user_id").alias("output_0")))


@register("j4_attach_predictions", "SELECT o_orderkey AS row_key, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice ELSE 0.0 END AS forest_y_pred FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_key"), F.col("o_totalprice").alias("y_pred"))
    return nested.attach_predictions(o.select("row_key"), o.where("row_key % 4 = 0"), "forest")
