"""Column catalogue, profiling and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from emulake.operators import profile, roles
from emulake.plans.catalog.base import CASES, INPUTS, OUTPUTS, S, cases, register, sig, sig_all, table

TABLES = ["lineitem", "orders", "customer", "events"]
SCHEMAS = {
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split(),
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split(),
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment".split(),
    "events": "event_id ts user_id event_type value props".split(),
}


def wide(spark, sf):
    """The case table under names that exercise every role rule."""
    c = cases(spark, sf)
    return c.select(
        "row_key", F.col("l_quantity").alias("x_1"), F.col("l_discount").alias("x_2"), F.col("l_tax").alias("temperature"),
        *[(F.col("revenue") * (i + 1)).alias(f"profile_{i}") for i in (0, 2, 10)],
        F.col("charge").alias("growth"), F.col("l_extendedprice").alias("p1"), (F.col("l_extendedprice") * 2).alias("p2"),
        F.col("l_quantity").alias("year"), F.when(F.col("l_linenumber") % 7 == 0, F.lit(None)).when(
            F.col("l_linenumber") % 7 == 1, F.lit(float("nan"))).when(F.col("l_linenumber") % 7 == 2, F.lit(float("inf"))).otherwise(
            F.col("l_tax")).alias("gap"))


OUT = "|".join(roles.OUTPUT_PREFIXES)
INP = "|".join(roles.INPUT_PREFIXES)
WIDE_COLS = ["row_key", "x_1", "x_2", "temperature", "profile_0", "profile_2", "profile_10", "growth", "p1", "p2", "year", "gap"]
NAMES_SQL = "names AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in WIDE_COLS) + "]) AS col)"
GROUPS_SQL = r"""b AS (SELECT col, CASE WHEN regexp_matches(col, '^(.+?)[\-_](\d+)$') THEN regexp_extract(col, '^(.+?)[\-_](\d+)$', 1)
   WHEN regexp_matches(col, '^(.+?)\[(\d+)\]$') THEN regexp_extract(col, '^(.+?)\[(\d+)\]$', 1)
   WHEN regexp_matches(col, '^(.+?)(\d+)$') THEN regexp_extract(col, '^(.+?)(\d+)$', 1) END AS base,
   regexp_extract(col, '(\d+)\]?$', 1) AS p FROM names),
 g AS (SELECT b.col, CASE WHEN n > 1 THEN b.base END AS base, CASE WHEN n > 1 THEN p::BIGINT END AS pos FROM b
   LEFT JOIN (SELECT base, count(*) AS n FROM b WHERE base IS NOT NULL GROUP BY 1) k USING (base))"""
ROLE_SQL = f"""r AS (SELECT col, base, pos, CASE WHEN coalesce(regexp_matches(lower(base), '^({OUT})') AND NOT regexp_matches(lower(base), '^({INP})'), false) THEN 'output'
   WHEN coalesce(regexp_matches(lower(base), '^({INP})'), false) THEN 'input' WHEN regexp_matches(lower(col), '^({OUT})') THEN 'output'
   WHEN regexp_matches(lower(col), '^({INP})') THEN 'input' WHEN col IN (SELECT base FROM g WHERE base IS NOT NULL) THEN 'output' ELSE 'input' END AS role FROM g)"""
GAP = """gap AS (SELECT count(*) AS n, count(*) FILTER (l_linenumber % 7 IN (0, 1)) AS lost, count(*) FILTER (l_linenumber % 7 = 2) AS inf FROM lineitem)"""


@register("p1_column_catalogue", f"""WITH {NAMES_SQL}, {GROUPS_SQL}, {ROLE_SQL}, {GAP}
 SELECT 'cases' AS "table", col AS "column", base, pos, role, n AS n_rows, CASE WHEN col = 'gap' THEN lost ELSE 0 END AS n_missing,
 CASE WHEN col = 'gap' THEN inf ELSE 0 END AS n_inf FROM r, gap""")
def _(spark, sf):
    c = roles.catalogue(spark, {"cases": wide(spark, sf)})
    return c.select("table", "column", "base", "pos", "role", "n_rows", "n_missing", "n_inf")


@register("p1_many_tables", " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_missing,
    CASE WHEN regexp_matches('{c}', '^({OUT})') THEN 'output' WHEN regexp_matches('{c}', '^({INP})') THEN 'input' ELSE 'input' END AS role FROM {t}"""
    for t, cols in SCHEMAS.items() for c in cols))
def _(spark, sf):
    c = roles.catalogue(spark, {t: table(spark, sf, t) for t in TABLES})
    return c.select("table", "column", "n_rows", "n_missing", "role")


@register("p2_pack_groups", f"WITH {CASES} SELECT row_key, {S('revenue * 1')} AS first_point, {S('revenue * 3')} AS second_point, {S('revenue * 11')} AS last_point, 3::INTEGER AS width FROM cases")
def _(spark, sf):
    df = wide(spark, sf)
    spec = roles.dataset_spec(df, key=["row_key"])
    a = F.col("profile")
    return roles.pack_groups(df, {"profile": spec.groups["profile"]}).select(
        "row_key", sig(a[0]).alias("first_point"), sig(a[1]).alias("second_point"), sig(a[2]).alias("last_point"), F.size(a).alias("width"))


@register("p3_roles_by_repetition", rf"""WITH {NAMES_SQL}, b AS (SELECT col, CASE WHEN regexp_matches(col, '^(.+?)_(\d+)_?$') THEN regexp_extract(col, '^(.+?)_(\d+)_?$', 1)
   WHEN regexp_matches(col, '^(.+?)(\d+)$') THEN regexp_extract(col, '^(.+?)(\d+)$', 1) END AS base FROM names)
 SELECT col AS "column", CASE WHEN base IS NOT NULL AND count(*) OVER (PARTITION BY base) > 1 THEN 'output' ELSE 'input' END AS role,
  (SELECT count(*) FROM lineitem) AS n_rows FROM b""")
def _(spark, sf):
    df = wide(spark, sf)
    r = roles.infer_roles_by_repetition(roles.names_frame(spark, {"cases": df}))
    counts = roles.cell_counts(df, "cases").select("table", "column", "n_rows")
    return r.join(counts, ["table", "column"]).select("column", "role", "n_rows")


@register("p4_metadata_roles", f"WITH {CASES} SELECT row_key, l_tax AS temperature, l_quantity AS x_1, charge AS growth FROM cases")
def _(spark, sf):
    df = wide(spark, sf)
    spec = roles.dataset_spec(df, {"inputs": ["temperature", "x_1", "unknown"], "outputs": ["growth"]}, key=["row_key"])
    return df.select(*spec.key, *spec.inputs, *spec.outputs)


@register("p7_drop_missing", f"WITH {CASES} SELECT row_key, l_linenumber % 7 = 2 AS kept_inf FROM cases WHERE l_linenumber % 7 NOT IN (0, 1)")
def _(spark, sf):
    df = wide(spark, sf).na.drop(subset=["x_1", "gap"])
    return df.select("row_key", (F.col("gap") == float("inf")).alias("kept_inf"))


@register("a7_describe", f"WITH {CASES}, l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS v FROM cases" for c in INPUTS + OUTPUTS)
          + f""") SELECT "column", count(v) AS "count", {S('avg(v)')} AS mean, {S('stddev_samp(v)')} AS std, {S('min(v)')} AS min, {S('quantile_cont(v, 0.25)')} AS q25,
 {S('quantile_cont(v, 0.5)')} AS q50, {S('quantile_cont(v, 0.75)')} AS q75, {S('max(v)')} AS max, {S('var_samp(v)')} AS variance FROM l GROUP BY 1""")
def _(spark, sf):
    d = profile.describe(cases(spark, sf), INPUTS + OUTPUTS)
    return sig_all(d, "mean", "std", "min", "q25", "q50", "q75", "max", "variance")


@register("a7_exact_quantiles_bracketed", f"""WITH {CASES} SELECT {S('quantile_cont(revenue, 0.05)')} AS q05, {S('quantile_cont(revenue, 0.5)')} AS q50,
 {S('quantile_cont(revenue, 0.99)')} AS q99, {S('quantile_cont(l_quantity, 0.5)')} AS quantity_median FROM cases""")
def _(spark, sf):
    q = profile.exact_quantiles(cases(spark, sf), ["revenue", "l_quantity"], [0.05, 0.5, 0.99], limit=500)
    r = q["revenue"]
    return sig_all(spark.createDataFrame([(*r, q["l_quantity"][1])], "q05 double, q50 double, q99 double, quantity_median double"),
                   "q05", "q50", "q99", "quantity_median")


@register("a8_missing_and_completeness", f"""WITH {GAP} SELECT 'cases' AS "table", round((n * 12 - lost) / (n * 12) * 100, 2) AS completeness_percent, lost AS n_missing FROM gap""")
def _(spark, sf):
    c = roles.completeness(roles.cell_counts(wide(spark, sf), "cases"))
    return c.select("table", "completeness_percent", "n_missing")


@register("a9_table_summary", """SELECT 'shape' AS kind, 'rows' AS name, count(*) AS value FROM lineitem UNION ALL SELECT 'shape', 'columns', 11 UNION ALL
 SELECT 'dtype', unnest(['bigint', 'int', 'double', 'string', 'timestamp_ntz']), unnest([3, 1, 4, 2, 1]) UNION ALL
 SELECT 'numeric_column', unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']), unnest(range(8)) UNION ALL
 SELECT 'categorical_column', unnest(['l_returnflag', 'l_linestatus']), unnest([8, 9])""")
def _(spark, sf):
    return profile.table_summary(table(spark, sf, "lineitem"))


@register("a9_group_sizes", """SELECT 'cases' AS "table", 'profile' AS output_group, 3::BIGINT AS n_columns, true AS is_largest, count(*) AS n_rows FROM lineitem""")
def _(spark, sf):
    c = roles.catalogue(spark, {"cases": wide(spark, sf)})
    rows = c.groupBy("table").agg(F.max("n_rows").alias("n_rows"))
    return roles.group_sizes(c).join(rows, "table")


@register("a10_summary_statistics", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS "count", {S(f'avg({c})')} AS mean, {S(f'stddev_samp({c})')} AS std, {S(f'min({c})')} AS min, {S(f'quantile_cont({c}, 0.5)')} AS q50, {S(f'max({c})')} AS max FROM orders"""
    for c in ("o_orderkey", "o_custkey", "o_totalprice")))
def _(spark, sf):
    return sig_all(profile.describe(table(spark, sf, "orders")), "mean", "std", "min", "q50", "max").select("column", "count", "mean", "std", "min", "q50", "max")


def _dirty(spark, sf):
    o = table(spark, sf, "orders")
    i = F.col("o_orderkey")
    price = F.when(i % 7 == 0, F.lit(None)).when(i % 11 == 0, F.lit(float("nan"))).when(i % 13 == 0, F.lit(float("-inf"))).otherwise(F.col("o_totalprice"))
    code = F.when(i % 3 == 0, i.cast("string")).when(i % 3 == 1, F.concat(i.cast("string"), F.lit(".5"))).otherwise(F.concat(F.lit("id"), i.cast("string")))
    d = o.select("o_orderkey", price.alias("price"), code.alias("code"), "o_orderstatus")
    return d.unionByName(d.where(i % 10 == 0))


DIRTY = """d0 AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'NaN'::DOUBLE WHEN o_orderkey % 13 = 0 THEN '-Infinity'::DOUBLE
   ELSE o_totalprice END AS price, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey || '' WHEN 1 THEN o_orderkey || '.5' ELSE 'id' || o_orderkey END AS code, o_orderstatus FROM orders),
 d AS (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE o_orderkey % 10 = 0)"""


@register("a11_validate", f"""WITH {DIRTY} SELECT 'missing' AS "check", 'price' AS "column", count(*) FILTER (price IS NULL OR isnan(price)) AS "count" FROM d
 UNION ALL SELECT 'infinite', 'price', count(*) FILTER (isinf(price)) FROM d
 UNION ALL SELECT 'duplicates', NULL, sum(c - 1)::BIGINT FROM (SELECT count(*) AS c FROM d GROUP BY o_orderkey, price, code, o_orderstatus)
 UNION ALL SELECT 'mixed', 'code', count(DISTINCT CASE WHEN try_cast(code AS BIGINT) IS NOT NULL AND code NOT LIKE '%.%' THEN 1 WHEN try_cast(code AS DOUBLE) IS NOT NULL THEN 2 ELSE 3 END) FROM d""")
def _(spark, sf):
    return profile.validate(_dirty(spark, sf))


LONG = "l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS v FROM cases" for c in INPUTS + OUTPUTS) + ")"


@register("a12_signal_to_noise", f"WITH {CASES}, {LONG} SELECT \"column\", {S('CASE WHEN stddev_pop(v) > 0 THEN avg(abs(v)) / stddev_pop(v) ELSE 0 END')} AS snr FROM l GROUP BY 1")
def _(spark, sf):
    return sig_all(profile.signal_to_noise(cases(spark, sf), INPUTS + OUTPUTS), "snr")


@register("a13_correlations", f"WITH {CASES} " + " UNION ALL ".join(
    f"SELECT '{a}' AS input, '{b}' AS output, count(*) AS n, {S(f'corr({a}, {b})')} AS r FROM cases" for a in INPUTS for b in OUTPUTS))
def _(spark, sf):
    return sig_all(profile.correlations(cases(spark, sf), INPUTS, OUTPUTS), "r")


@register("a13_correlations_wide", f"""WITH e AS (SELECT vec_id, CASE WHEN (vec_id + i) % 17 = 0 THEN NULL ELSE embedding[i + 1]::DOUBLE END AS v, i FROM embeddings, (SELECT unnest(range(48)) AS i)),
 p AS (SELECT a.i AS x, b.i AS y, count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL) AS n, corr(a.v, b.v) AS r FROM e a JOIN e b USING (vec_id) WHERE a.i < 24 AND b.i >= 24 GROUP BY 1, 2)
 SELECT 'v' || x AS input, 'v' || y AS output, n, {S('r')} AS r FROM p""")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    cols = [F.when((F.col("vec_id") + i) % 17 != 0, F.col("embedding")[i].cast("double")).alias(f"v{i}") for i in range(48)]
    c = profile.correlations(e.select(*cols), [f"v{i}" for i in range(24)], [f"v{i}" for i in range(24, 48)])
    return sig_all(c, "r")


@register("a14_strongest_pair", f"""WITH {CASES} SELECT 'l_extendedprice' AS input, 'revenue' AS output, {S('corr(l_extendedprice, revenue)')} AS r,
 {S('regr_slope(revenue, l_extendedprice)')} AS slope, {S('regr_intercept(revenue, l_extendedprice)')} AS intercept,
 {S('corr(l_extendedprice, revenue)')} AS z_slope, 0.0::DOUBLE AS z_intercept FROM cases""")
def _(spark, sf):
    return sig_all(profile.strongest_pair(cases(spark, sf), INPUTS, OUTPUTS), "r", "slope", "intercept", "z_slope", "z_intercept")


@register("a15_profile_mean_std", f"""SELECT (i - 1)::INTEGER AS pos, {S('avg(embedding[i]::DOUBLE)')} AS mean, {S('stddev_pop(embedding[i]::DOUBLE)')} AS std, count(*) AS n
 FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY i""")
def _(spark, sf):
    return sig_all(profile.profile_mean_std(table(spark, sf, "embeddings"), "embedding"), "mean", "std")


@register("a16_distributions", f"WITH {CASES}, {LONG} SELECT \"column\", count(v) AS \"count\", {S('avg(v)')} AS mean, {S('quantile_cont(v, 0.5)')} AS median, {S('min(v)')} AS min, {S('max(v)')} AS max FROM l GROUP BY 1")
def _(spark, sf):
    return sig_all(profile.distributions(cases(spark, sf), INPUTS + OUTPUTS), "mean", "median", "min", "max")


@register("a17_density_2d", """WITH p AS (SELECT o_orderstatus AS model, o_totalprice AS y_true, o_totalprice * 0.9::DOUBLE + 5000 AS y_pred FROM orders),
 a AS (SELECT min(least(y_true, y_pred)) AS a, max(greatest(y_true, y_pred)) AS b FROM p), l AS (SELECT a - (b - a) * 0.05::DOUBLE AS lo, b + (b - a) * 0.05::DOUBLE AS hi FROM a)
 SELECT model, least(floor((y_true - lo) / (hi - lo) * 40), 39)::BIGINT AS bin_true, least(floor((y_pred - lo) / (hi - lo) * 40), 39)::BIGINT AS bin_pred, count(*) AS n
 FROM p, l GROUP BY 1, 2, 3""")
def _(spark, sf):
    t = F.col("o_totalprice")
    p = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("model"), t.alias("y_true"), (t * 0.9 + 5000).alias("y_pred"))
    return profile.density_2d(p, 40, by=["model"])


@register("a17_density_2d_per_model", """WITH p AS (SELECT o_orderstatus AS model, o_totalprice AS y_true, o_totalprice * 0.9::DOUBLE + 5000 AS y_pred FROM orders),
 a AS (SELECT model, min(least(y_true, y_pred)) AS a, max(greatest(y_true, y_pred)) AS b FROM p GROUP BY 1), l AS (SELECT model, a - (b - a) * 0.05::DOUBLE AS lo, b + (b - a) * 0.05::DOUBLE AS hi FROM a)
 SELECT model, least(floor((y_true - lo) / (hi - lo) * 25), 24)::BIGINT AS bin_true, least(floor((y_pred - lo) / (hi - lo) * 25), 24)::BIGINT AS bin_pred, count(*) AS n
 FROM p JOIN l USING (model) GROUP BY 1, 2, 3""")
def _(spark, sf):
    t = F.col("o_totalprice")
    p = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("model"), t.alias("y_true"), (t * 0.9 + 5000).alias("y_pred"))
    return profile.density_2d(p, 25, by=["model"], shared=["model"])


@register("a18_histograms", f"""WITH {CASES}, l AS (SELECT 'l_quantity' AS "column", l_quantity AS v FROM cases UNION ALL SELECT 'revenue', revenue FROM cases),
 m AS (SELECT "column", min(v) AS lo, max(v) AS hi FROM l GROUP BY 1)
 SELECT "column", least(floor((v - lo) / (hi - lo) * 12), 11)::BIGINT AS bin, count(*) AS n FROM l JOIN m USING ("column") GROUP BY 1, 2""")
def _(spark, sf):
    return profile.histograms(cases(spark, sf), ["l_quantity", "revenue"], 12).select("column", "bin", "n")


@register("a28_sample_stats", f"WITH {CASES}, {LONG} SELECT \"column\", {S('min(v)')} AS min, {S('avg(v)')} AS mean, {S('max(v)')} AS max FROM l GROUP BY 1")
def _(spark, sf):
    return sig_all(profile.sample_stats(cases(spark, sf), INPUTS + OUTPUTS), "min", "mean", "max")
