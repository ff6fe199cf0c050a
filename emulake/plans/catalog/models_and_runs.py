"""Models, tuning, explanation and declarative runs on the case table."""

from __future__ import annotations

from pyspark.sql import functions as F

from emulake.functions.hashing import seeded_hash
from emulake.models import REGISTRY, explain, tree_shapley
from emulake.models.base import FunctionModel
from emulake.models.fourier_bayes import JITTER, NOISES, Features
from emulake.operators import metrics, profile, split, trials
from emulake.operators.scale import fit_standard
from emulake.plans import evaluation, reports, tuning, workflow
from emulake.plans.catalog.base import (
    CASES, INPUTS, OUTPUTS, S, cases, hash_sql, output_metrics_sql, register, sig, sig_all, split_sql, table,
)
from emulake.session import SMALL_ROWS, materialize, new_path, spread_small
from emulake.spec import ModelSpec, RunSpec, TuneSpec

KEY = ["row_key"]
SPLIT = split_sql("cases", "row_key", 0.2, 0.2)


def split_once(df, tag, then=lambda s: s):
    """``then`` of the table, split 60/20/20. Keys are made and hashed once, in the table that is stored; on a large one the split is a
    comparison of the stored hash, a small one is stored again with one partition per core."""
    hashed = materialize(df.withColumn("__h42", seeded_hash(42, *KEY)), f"{tag}-hashed")
    plan = split.fit_split(hashed, KEY, 0.2, 0.2, stored="__h42")
    out = then(plan.apply(hashed)).select("row_key", "split", *[c for c in df.columns if c != "row_key"])
    return materialize(spread_small(out, plan.cuts.n), tag) if plan.cuts.n <= SMALL_ROWS else out


def ready(spark, sf, inputs=INPUTS):
    """The case table, split 60/20/20 and standardised on train, its keys stored once."""
    df = cases(spark, sf).select("row_key", *inputs, *OUTPUTS)
    return split_once(df, "ready", lambda s: fit_standard(part(s, "train"), inputs).transform(s))


def part(df, name):
    return df.where(F.col("split") == name)


def _scores(model, df, bar):
    """What SQL can state of a learner's scores: rows and truth of each split and output, and whether R2 passes the bar."""
    m = metrics.output_metrics(tuning.scored_long(model, df, ["split"]), ["split", "output"])
    return m.select("split", "output", "n", (F.col("r2") > bar).alias("above_bar"), (F.col("rmse") >= F.col("mae")).alias("ordered"))


def _scores_sql(more=""):
    return " UNION ALL ".join(f"SELECT split, '{o}' AS output, count(*) AS n, true AS above_bar, true AS ordered{more} FROM s GROUP BY 1" for o in OUTPUTS)


def _close(a, b):
    return F.abs(F.col(a) - F.col(b)) <= 1e-6 * (1 + F.abs(F.col(b)))


# --- least squares: exact against SQL --------------------------------------------------------------------

ONE = f"""{CASES}, {SPLIT}, w AS (SELECT regr_slope(revenue, l_extendedprice) AS a, regr_intercept(revenue, l_extendedprice) AS b, regr_slope(charge, l_extendedprice) AS c,
 regr_intercept(charge, l_extendedprice) AS d, avg(l_extendedprice) AS mx FROM s WHERE split = 'train')"""


def _one(spark, sf):
    df = cases(spark, sf)
    plan = split.fit_split(df, KEY, 0.2, 0.2)
    s = materialize(spread_small(plan.apply(df), plan.cuts.n), "one")
    return s, REGISTRY.create("linear", ["l_extendedprice"], OUTPUTS).fit(part(s, "train"))


@register("m10_batch_scoring", f"WITH {ONE} SELECT row_key, split, 'revenue' AS output, {S('a * l_extendedprice + b')} AS y_pred FROM s, w UNION ALL SELECT row_key, split, 'charge', {S('c * l_extendedprice + d')} FROM s, w")
def _(spark, sf):
    s, model = _one(spark, sf)
    return sig_all(model.score(s, ["row_key", "split"]), "y_pred")


@register("s16_saved_model", f"WITH {ONE} SELECT 'revenue' AS output, {S('avg(a * l_extendedprice + b)')} AS mean_pred FROM s, w UNION ALL SELECT 'charge', {S('avg(c * l_extendedprice + d)')} FROM s, w")
def _(spark, sf):
    s, model = _one(spark, sf)
    path = new_path(spark, "model")
    model.save(spark, path)
    return REGISTRY.load(spark, path).score(s, []).groupBy("output").agg(sig(F.avg("y_pred")).alias("mean_pred"))


@register("m8_custom_scorer", f"WITH {CASES} SELECT row_key, 'revenue' AS output, {S('l_extendedprice * 0.95::DOUBLE + l_quantity')} AS y_pred FROM cases")
def _(spark, sf):
    REGISTRY.register(FunctionModel, key="rule", aliases=["my_rule"])
    m = REGISTRY.create("my_rule", ["l_extendedprice", "l_quantity"], ["revenue"], predict=lambda x: x[:, :1] * 0.95 + x[:, 1:])
    return sig_all(m.score(cases(spark, sf), KEY), "y_pred")


@register("m14_linear_shapley", f"WITH {ONE} SELECT row_key, 'revenue' AS output, 'l_extendedprice' AS feature, {S('a * (l_extendedprice - mx)')} AS phi FROM s, w UNION ALL SELECT row_key, 'charge', 'l_extendedprice', {S('c * (l_extendedprice - mx)')} FROM s, w")
def _(spark, sf):
    s, model = _one(spark, sf)
    return sig_all(model.shapley(s, KEY), "phi")


PHI = f"""{CASES}, mu AS (SELECT avg(l_quantity) AS q, avg(l_extendedprice) AS p, avg(l_tax) AS t FROM cases),
 phi AS (SELECT row_key, 'revenue' AS output, 'l_quantity' AS feature, 2 * (l_quantity - q) AS phi FROM cases, mu UNION ALL
  SELECT row_key, 'revenue', 'l_extendedprice', 0.5::DOUBLE * (l_extendedprice - p) FROM cases, mu UNION ALL SELECT row_key, 'revenue', 'l_tax', -100 * (l_tax - t) FROM cases, mu)"""


def _phi(spark, sf):
    import numpy as np

    m = REGISTRY.create("linear", ["l_quantity", "l_extendedprice", "l_tax"], ["revenue"])
    m.restore({"weights": np.array([[2.0], [0.5], [-100.0]]), "bias": [0.0], "centre": [0.0, 0.0, 0.0]})
    df = cases(spark, sf)
    mu = df.agg(*[F.avg(c).alias(c) for c in m.inputs]).first().asDict()
    return m.shapley(df, KEY, mu)


@register("m15_global_importance", f"WITH {PHI} SELECT output, feature, {S('avg(abs(phi))')} AS importance FROM phi GROUP BY 1, 2")
def _(spark, sf):
    return sig_all(explain.global_importance(_phi(spark, sf)), "importance")


@register("m15_group_importance", f"""WITH {PHI}, g AS (SELECT row_key, CASE WHEN feature = 'l_tax' THEN 'rates' ELSE 'sizes' END AS grp, sum(abs(phi)) AS s FROM phi GROUP BY 1, 2)
 SELECT 'revenue' AS output, grp, {S('avg(s)')} AS importance FROM g GROUP BY 2""")
def _(spark, sf):
    groups = spark.createDataFrame([("l_tax", "rates"), ("l_quantity", "sizes"), ("l_extendedprice", "sizes")], "feature string, grp string")
    return sig_all(explain.group_importance(_phi(spark, sf), groups, KEY), "importance")


@register("k3_top_features", f"WITH {PHI} SELECT feature, {S('avg(abs(phi))')} AS importance FROM phi GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2")
def _(spark, sf):
    g = explain.global_importance(_phi(spark, sf), ())
    return sig_all(trials.top_features(g, 2), "importance")


FOLD = f"""{CASES}, r AS (SELECT *, row_number() OVER (ORDER BY {hash_sql(42, 'row_key')}, row_key) AS rk FROM cases), n AS (SELECT count(*) AS n FROM cases),
 f AS (SELECT *, CASE WHEN rk <= (n % 3) * (n // 3 + 1) THEN (rk - 1) // (n // 3 + 1) ELSE n % 3 + (rk - 1 - (n % 3) * (n // 3 + 1)) // (n // 3) END AS fold FROM r, n),
 k AS (SELECT unnest([0, 1, 2]) AS kf), w AS (SELECT kf, regr_slope(revenue, l_extendedprice) AS a, regr_intercept(revenue, l_extendedprice) AS b FROM f, k WHERE fold <> kf GROUP BY 1),
 pred AS (SELECT fold, revenue AS y_true, a * l_extendedprice + b AS y_pred FROM f JOIN w ON kf = fold), {output_metrics_sql('pred', 'fold')}"""


@register("m12_cross_validation", f"WITH {FOLD} SELECT fold::INTEGER AS fold, n, {S('r2')} AS r2, {S('rmse')} AS rmse FROM om")
def _(spark, sf):
    df = materialize(cases(spark, sf).select("row_key", "l_extendedprice", "revenue"), "cv")
    f = tuning.cross_validate(ModelSpec("linear"), df, ["l_extendedprice"], ["revenue"], KEY, 3)
    return sig_all(f, "r2", "rmse").select("fold", "n", "r2", "rmse")


@register("e1_workflow", f"""WITH {ONE}, pred AS (SELECT split, 'revenue' AS output, revenue AS y_true, a * l_extendedprice + b AS y_pred FROM s, w UNION ALL
  SELECT split, 'charge', charge, c * l_extendedprice + d FROM s, w), {output_metrics_sql('pred', 'split, output')}
 SELECT 'line' AS model, split, max(n) AS n, {S('1 - sum(sse) / sum(sst)')} AS r2, {S('avg(r2)')} AS r2_uniform_average, {S('sqrt(avg(mse))')} AS rmse, {S('avg(mae)')} AS mae FROM om GROUP BY 2""")
def _(spark, sf):
    df = cases(spark, sf).select("row_key", "l_extendedprice", *OUTPUTS)
    spec = RunSpec(key=KEY, metadata={"inputs": ["l_extendedprice"], "outputs": OUTPUTS}, models=[ModelSpec("linear", "line")],
                   standardize_outputs=True, output_dir=new_path(spark, "run"))
    m = workflow.run_workflow(spark, spec, df).metrics
    return sig_all(m, "r2", "r2_uniform_average", "rmse", "mae").select("model", "split", "n", "r2", "r2_uniform_average", "rmse", "mae")


@register("e3_stored_run", f"""WITH {ONE}, pred AS (SELECT split, l_linenumber // 2 AS block, 'revenue' AS output, revenue AS y_true, a * l_extendedprice + b AS y_pred FROM s, w UNION ALL
  SELECT split, l_linenumber // 2, 'charge', charge, c * l_extendedprice + d FROM s, w), {output_metrics_sql('pred', 'block, output')}, {output_metrics_sql('pred', 'split, output', 'tm')},
 ref AS (SELECT 1 - sum(sse) / sum(sst) AS r2, sqrt(avg(mse)) AS rmse FROM tm WHERE split = 'train'),
 tr AS (SELECT min(l_extendedprice) AS xl, max(l_extendedprice) AS xh, min(revenue) AS rl, max(revenue) AS rh, min(charge) AS cl, max(charge) AS ch FROM s WHERE split = 'train'),
 ext AS (SELECT l_linenumber // 2 AS block, (min(l_extendedprice) < any_value(xl) OR max(l_extendedprice) > any_value(xh))::BIGINT AS n_inputs_out,
  (min(revenue) < any_value(rl) OR max(revenue) > any_value(rh))::BIGINT + (min(charge) < any_value(cl) OR max(charge) > any_value(ch))::BIGINT AS n_outputs_out FROM s, tr GROUP BY 1),
 dr AS (SELECT block, om.r2 < ref.r2 - 0.1 OR om.rmse > 1.5 * ref.rmse AS dropped FROM om, ref WHERE output = 'revenue')
 SELECT block::BIGINT AS block, 'line' AS model, output, n, {S('r2')} AS r2, {S('rmse')} AS rmse, n_inputs_out, n_outputs_out, concat_ws(',', CASE WHEN n_inputs_out > 0 THEN 'input_ood' END,
  CASE WHEN n_outputs_out > 0 THEN 'output_ood' END, CASE WHEN dropped THEN 'accuracy_drop' END) AS triggers FROM om JOIN ext USING (block) JOIN dr USING (block)""")
def _(spark, sf):
    """A run is fitted and stored, restored from its folder, and judges the blocks of the whole table."""
    df, out = cases(spark, sf).select("row_key", "l_linenumber", "l_extendedprice", *OUTPUTS), new_path(spark, "run")
    spec = RunSpec(key=KEY, metadata={"inputs": ["l_extendedprice"], "outputs": OUTPUTS}, models=[ModelSpec("linear", "line")], standardize_outputs=True, output_dir=out)
    workflow.run_workflow(spark, spec, df.drop("l_linenumber"))
    e = evaluation.evaluate_run(spark, out, df, "l_linenumber", 2, "revenue").withColumn("triggers", F.array_join("triggers", ","))
    return sig_all(e, "r2", "rmse").select("block", "model", "output", "n", "r2", "rmse", "n_inputs_out", "n_outputs_out", "triggers")


@register("e2_analysis_suite", f"WITH {CASES}, l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS v FROM cases" for c in INPUTS + OUTPUTS) + f""")
 SELECT 'median' AS part, c AS name, {S('quantile_cont(v, 0.5)')} AS value FROM l GROUP BY 2 UNION ALL SELECT 'snr', c, {S('avg(abs(v)) / stddev_pop(v)')} FROM l GROUP BY 2 UNION ALL """
          + " UNION ALL ".join(f"SELECT 'r', '{a}~{b}', {S(f'corr({a}, {b})')} FROM cases" for a in INPUTS for b in OUTPUTS)
          + "".join(f" UNION ALL SELECT 'strongest', 'l_extendedprice~revenue.{n}', {S(f'{f}(revenue, l_extendedprice)')} FROM cases" for n, f in (("r", "corr"), ("slope", "regr_slope"), ("intercept", "regr_intercept")))
          + "".join(f" UNION ALL SELECT 'profile', '{i}.{n}', {S(f'{f}({c})')} FROM cases" for i, c in enumerate(INPUTS) for n, f in (("mean", "avg"), ("std", "stddev_pop"))))
def _(spark, sf):
    """All tables of the suite: medians, signal to noise, correlations, the strongest pair and an array profile."""
    t = reports.analysis_suite(cases(spark, sf).withColumn("profile", F.array(*[F.col(c).cast("double") for c in INPUTS])), INPUTS, OUTPUTS, "profile")
    best, per = t["strongest_pair"], t["profile_mean_std"]
    more = best.select(F.lit("strongest").alias("part"), F.inline(F.array(*[F.struct(F.concat("input", F.lit("~"), "output", F.lit(f".{n}")).alias("name"), sig(n).alias("value")) for n in ("r", "slope", "intercept")])))
    more = more.unionByName(per.select(F.lit("profile").alias("part"), F.inline(F.array(*[F.struct(F.concat(F.col("pos").cast("string"), F.lit(f".{n}")).alias("name"), sig(n).alias("value")) for n in ("mean", "std")]))))
    rows = t["distributions"].select(F.lit("median").alias("part"), F.col("column").alias("name"), sig("median").alias("value"))
    rows = rows.unionByName(t["signal_to_noise"].select(F.lit("snr").alias("part"), F.col("column").alias("name"), sig("snr").alias("value")))
    return rows.unionByName(more).unionByName(t["correlations"].select(F.lit("r").alias("part"), F.concat_ws("~", "input", "output").alias("name"), sig("r").alias("value")))


@register("e4_dataset_report", f"""WITH {CASES} SELECT 'shape' AS section, 'rows' AS name, count(*)::DOUBLE AS value FROM cases UNION ALL SELECT 'input', unnest(['l_discount', 'l_extendedprice', 'l_quantity', 'l_tax']), unnest([0, 1, 2, 3])
 UNION ALL SELECT 'output', unnest(['revenue', 'charge']), unnest([0, 1]) UNION ALL SELECT 'shape', 'columns', 7 UNION ALL SELECT 'completeness', 'percent', 100.0 UNION ALL """ + " UNION ALL ".join(
    f"SELECT 'statistic', '{c}.{name}', {S(f(c))} FROM cases" for c in INPUTS + OUTPUTS for name, f in (
        ("mean", lambda c: f"avg({c})"), ("std", lambda c: f"stddev_samp({c})"), ("min", lambda c: f"min({c})"), ("q25", lambda c: f"quantile_cont({c}, 0.25)"),
        ("q50", lambda c: f"quantile_cont({c}, 0.5)"), ("q75", lambda c: f"quantile_cont({c}, 0.75)"), ("max", lambda c: f"max({c})"), ("variance", lambda c: f"var_samp({c})"))))
def _(spark, sf):
    df = cases(spark, sf).select("row_key", *INPUTS, *OUTPUTS)
    r = reports.dataset_report(df, {"outputs": OUTPUTS}, key=KEY)
    return r.select("section", "name", F.when(F.col("section") == "statistic", sig("value")).otherwise(F.col("value")).alias("value"))


# --- learners: SQL states their rows and the laws they obey; property tests do the rest -----------------------------------------------

FOREST = {"n_estimators": 12, "max_depth": 8}


VAL_SQL = f"WITH {CASES}, {SPLIT} SELECT row_key, 'revenue' AS output, true AS agrees FROM s WHERE split = 'val'"


@register("m1_random_forest", f"WITH {CASES}, {SPLIT} {_scores_sql()}")
def _(spark, sf):
    df = ready(spark, sf)
    return _scores(REGISTRY.create("random_forest", INPUTS, OUTPUTS, **FOREST).fit(part(df, "train")), df, 0.8)


@register("m6_forest_uncertainty", VAL_SQL)
def _(spark, sf):
    """The mean over the trees is the forest's own prediction, for every row."""
    val = part(df := ready(spark, sf), "val")
    m = REGISTRY.create("rf", INPUTS, ["revenue"], **FOREST).fit(part(df, "train"))
    own = m.score(val, KEY).withColumnRenamed("y_pred", "own")
    both = m.score_std(val, KEY).join(own, [*KEY, "output"])
    return both.select("row_key", "output", (_close("y_pred", "own") & (F.col("std") >= 0)).alias("agrees"))


@register("m6_seeded_ensemble", VAL_SQL)
def _(spark, sf):
    """Mean and deviation made in the scorer are those of the members' own scores, for every row."""
    val = part(df := ready(spark, sf), "val")
    m = REGISTRY.create("ensemble", INPUTS, ["revenue"], base="gp", n_members=3, base_params={"n_features": 32}).fit(part(df, "train"))
    own = metrics.ensemble(m.member_scores(val, KEY), [*KEY, "output"]).select(*KEY, "output", "mean", F.col("std").alias("own_std"))
    both = m.score_std(val, KEY).join(own, [*KEY, "output"])
    return both.select("row_key", "output", (_close("y_pred", "mean") & _close("std", "own_std")).alias("agrees"))


@register("m13_feature_importance", f"WITH {CASES}, {SPLIT}, c AS (" + " UNION ALL ".join(
    f"SELECT '{o}' AS output, '{i}' AS feature, abs(corr({i}, {o})) AS r FROM s WHERE split = 'train'" for o in OUTPUTS for i in INPUTS)
    + ") SELECT output, count(*) AS features, 1.0::DOUBLE AS total, arg_max(feature, r) AS top FROM c GROUP BY 1")
def _(spark, sf):
    """Importances sum to one, and the feature on top is the one that the output follows most."""
    df = ready(spark, sf)
    found = REGISTRY.create("rf", INPUTS, OUTPUTS, **FOREST).fit(part(df, "train")).importances(spark)
    return found.groupBy("output").agg(F.count("feature").alias("features"), sig(F.sum("importance")).alias("total"), F.max_by("feature", "importance").alias("top"))


MLP = {"hidden_layers": [32, 32], "n_epochs": 6, "learning_rate": 0.005, "patience": 3}


@register("m2_mlp", f"WITH {CASES}, {SPLIT} {_scores_sql()}")
def _(spark, sf):
    df = ready(spark, sf)
    return _scores(REGISTRY.create("mlp", INPUTS, OUTPUTS, **MLP).fit(part(df, "train"), part(df, "val")), df, 0.5)


STAGES = ", unnest(['before', 'after']) AS stage"


@register("m9_fine_tune", f"WITH {CASES}, {SPLIT}, t AS ({_scores_sql()}) SELECT *{STAGES} FROM t")
def _(spark, sf):
    """Fit on the training split, then go on with the validation split at a tenth of the rate."""
    df = ready(spark, sf)
    first = REGISTRY.create("mlp", INPUTS, OUTPUTS, **MLP).fit(part(df, "train"), part(df, "test"))
    more = REGISTRY.create("mlp", INPUTS, OUTPUTS, **{**MLP, "n_epochs": 3}).fit(part(df, "val"), part(df, "test"), start=first, lr_scale=0.1)
    return _scores(first, df, 0.5).withColumn("stage", F.lit("before")).unionByName(_scores(more, df, 0.5).withColumn("stage", F.lit("after")))


@register("m3_fourier_bayes", f"WITH {CASES}, {SPLIT} {_scores_sql()}")
def _(spark, sf):
    df = ready(spark, sf)
    return _scores(REGISTRY.create("gp", INPUTS, OUTPUTS, n_features=64, kernel="matern52", lengthscale=2.0).fit(part(df, "train")), df, 0.9)


LINEAR = {"kernel": "linear", "noise": 0.01, "variance": 2.0}
#: The linear kernel on one input has a closed form; the precision carries the solver's own 1e-10 of jitter.
LINEAR_SQL = f"""{CASES}, {SPLIT}, w AS (SELECT avg(l_extendedprice) AS mx, stddev_pop(l_extendedprice) AS sx, avg(revenue) AS my, stddev_pop(revenue) AS sy,
 corr(l_extendedprice, revenue) AS r, count(*)::DOUBLE AS n FROM s WHERE split = 'train'),
 g AS (SELECT *, (0.1::DOUBLE * n / 0.01::DOUBLE + 0.5::DOUBLE) * (1 + 1e-10::DOUBLE) AS a FROM w)"""
LINEAR_MEAN = "0.1::DOUBLE * n * r / 0.01::DOUBLE / a * (l_extendedprice - mx) / sx * sy + my"


def _linear_kernel(spark, sf):
    df = cases(spark, sf)
    plan = split.fit_split(df, KEY, 0.2, 0.2)
    s = materialize(spread_small(plan.apply(df), plan.cuts.n), "linear-kernel")
    return s, REGISTRY.create("gp", ["l_extendedprice"], ["revenue"], **LINEAR).fit(part(s, "train"))


@register("m3_linear_kernel", f"WITH {LINEAR_SQL} SELECT row_key, split, 'revenue' AS output, {S(LINEAR_MEAN)} AS y_pred FROM s, g")
def _(spark, sf):
    s, model = _linear_kernel(spark, sf)
    return sig_all(model.score(s, ["row_key", "split"]), "y_pred")


@register("m7_linear_kernel_std", f"""WITH {LINEAR_SQL} SELECT row_key, 'revenue' AS output, {S(LINEAR_MEAN)} AS y_pred,
 {S("sqrt(0.1::DOUBLE / a) * abs(l_extendedprice - mx) / sx * sy")} AS std FROM s, g WHERE split = 'val'""")
def _(spark, sf):
    s, model = _linear_kernel(spark, sf)
    return sig_all(model.score_std(part(s, "val"), KEY), "y_pred", "std")


# --- kernel sums: the features' frequencies are constants of both sides, the rest is the Cholesky solution written out in SQL -------------


def _num(x):
    return f"{float(x)!r}::DOUBLE"


def _feature_sql(features, z):
    """SQL of every feature over the standardised inputs ``z``."""
    out = []
    for block in features.blocks:
        if block is None:
            out += z
            continue
        w, b = block
        out += [f"{_num((2.0 / len(b)) ** 0.5)} * cos({' + '.join(f'{c} * {_num(w[j, k])}' for j, c in enumerate(z))} + {_num(b[k])})" for k in range(len(b))]
    return out


def _sums_sql(d):
    """Gram, cross and output sums of features f0.. and the target t."""
    return ", ".join(["count(*)::DOUBLE AS n", "sum(t * t) AS yy", *(f"sum(f{i} * f{j}) AS g{i}_{j}" for i in range(d) for j in range(i + 1)), *(f"sum(f{i} * t) AS c{i}" for i in range(d))])


def _solved_sql(priors):
    """Columns from the sums and the noise to the factor l, the weight means m and the log evidence, each from those before it;
    see ``_nested``."""
    d = len(priors)
    less = lambda terms: "".join(f" - {t}" for t in terms)
    cols = [f"({' + '.join(f'g{i}_{i} / noise + 1 / ({priors[i]})' for i in range(d))}) / {d} * {_num(JITTER)} AS jitter"]
    for i in range(d):
        for j in range(i):
            cols.append(f"(g{i}_{j} / noise{less(f'l{i}_{k} * l{j}_{k}' for k in range(j))}) / l{j}_{j} AS l{i}_{j}")
        cols.append(f"sqrt(g{i}_{i} / noise + 1 / ({priors[i]}) + jitter{less(f'l{i}_{k} * l{i}_{k}' for k in range(i))}) AS l{i}_{i}")
    cols += [f"(c{i} / noise{less(f'l{i}_{k} * u{k}' for k in range(i))}) / l{i}_{i} AS u{i}" for i in range(d)]
    cols += [f"(u{i}{less(f'l{k}_{i} * m{k}' for k in range(i + 1, d))}) / l{i}_{i} AS m{i}" for i in reversed(range(d))]
    explained = " + ".join(f"m{i} * m{j} * g{max(i, j)}_{min(i, j)}" for i in range(d) for j in range(d))
    fit = f"(yy - 2 * ({' + '.join(f'm{i} * c{i}' for i in range(d))}) + {explained}) / noise + {' + '.join(f'm{i} * m{i} / ({p})' for i, p in enumerate(priors))}"
    logs = " + ".join([*(f"2 * ln(l{i}_{i})" for i in range(d)), *(f"ln({p})" for p in priors)])
    return [*cols, f"-0.5::DOUBLE * ({fit} + {logs} + n * ln(2 * pi() * noise)) AS ev"]


def _nested(source, cols):
    """``source`` with one more column in each subquery, so that every expression is evaluated once."""
    for c in cols:
        source = f"(SELECT *, {c} FROM {source})"
    return source


def _centred_sql(inputs, output):
    """Columns z0.. and t of every row of s, centred and scaled by the training split."""
    stats = ", ".join(f"avg({c}) FILTER (WHERE split = 'train') AS m_{c}, stddev_pop({c}) FILTER (WHERE split = 'train') AS s_{c}" for c in [*inputs, output])
    cols = ", ".join([*(f"({c} - m_{c}) / s_{c} AS z{i}" for i, c in enumerate(inputs)), f"({output} - m_{output}) / s_{output} AS t"])
    return f"w AS (SELECT {stats} FROM s), z AS MATERIALIZED (SELECT row_key, split, {cols}, m_{output} AS my, s_{output} AS sy FROM s, w)"


SEARCH = {"kernels": ("linear", "rbf", "matern32", "rational_quadratic", "rbf+linear"), "lengthscales": (0.5, 1.0, 2.0), "variances": (0.5, 2.0)}


def _search_sql():
    parts = []
    for kernel in SEARCH["kernels"]:
        for ls in SEARCH["lengthscales"][: 1 if kernel == "linear" else None]:
            names = kernel.split("+")
            f = Features(1, names, ls, 2, 42)
            # a single linear kernel has a tenth of the variance, in a sum a tenth
            priors = [("0.1::DOUBLE" if len(names) > 1 else "0.1::DOUBLE * variance") if f.kernels[o] == "linear" else "variance" for o in f.owner]
            feats = ", ".join(f"{e} AS f{i}" for i, e in enumerate(_feature_sql(f, ["z0"])))
            parts.append(f"""SELECT '{kernel}' AS kernel, {_num(ls)} AS lengthscale, variance, max(ev) AS log_evidence FROM {_nested(f"""(SELECT * FROM (SELECT {_sums_sql(len(priors))} FROM (SELECT {feats}, t FROM z WHERE split = 'train')) g,
 (SELECT unnest({list(SEARCH['variances'])})::DOUBLE AS variance) v, (SELECT unnest({list(NOISES)})::DOUBLE AS noise) o)""", _solved_sql(priors))} GROUP BY variance""")
    return f"WITH {CASES}, {SPLIT}, {_centred_sql(['l_extendedprice'], 'revenue')}, e AS ({' UNION ALL '.join(parts)}) SELECT kernel, lengthscale, variance, {S('log_evidence')} AS log_evidence FROM e"


@register("m4_kernel_search", _search_sql())
def _(spark, sf):
    """Log evidence of single kernels and a sum, over lengthscales and variances, the noise chosen for each."""
    df = cases(spark, sf)
    plan = split.fit_split(df, KEY, 0.2, 0.2)
    model = REGISTRY.create("gp", ["l_extendedprice"], ["revenue"], n_features=2, linear=False)
    rows = model.search(part(materialize(spread_small(plan.apply(df), plan.cuts.n), "kernel-search"), "train"), **SEARCH)
    got = spark.createDataFrame([tuple(r.values()) for r in rows], "kernel string, lengthscale double, variance double, log_evidence double")
    return sig_all(got, "log_evidence")


@register("m4_kernel_search_wide")
def _(spark, sf):
    df = ready(spark, sf)
    rows = REGISTRY.create("gp", INPUTS, ["revenue"], n_features=48).search(part(df, "train"), lengthscales=(0.5, 1.0, 2.0), variances=(0.5, 1.0))
    return spark.createDataFrame([tuple(r.values()) for r in rows], "kernel string, lengthscale double, variance double, log_evidence double")


SUM = {"kernels": ["linear", "rbf", "matern52"], "lengthscale": [1.5, 3.0], "variance": 2.0, "linear_variance": 0.5, "noise": 0.01, "n_features": 2}
SUM_INPUTS = ["l_extendedprice", "l_discount"]
# Five digits: the precision matrix passes the last digits of the sums on, enlarged, and each of many rows may then fall on the other side of a tie.
_five = lambda c: F.format_string("%.4e", F.col(c)).cast("double").alias(c)
_FIVE = "printf('%.4e', {})::DOUBLE".format


def _sum_sql():
    f = Features(2, SUM["kernels"], SUM["lengthscale"], SUM["n_features"], 42)
    priors = [_num(SUM["linear_variance"] if f.kernels[o] == "linear" else SUM["variance"]) for o in f.owner]
    d = len(priors)
    feats = ", ".join(f"{e} AS f{i}" for i, e in enumerate(_feature_sql(f, ["z0", "z1"])))
    q = [f"(f{i}{''.join(f' - l{i}_{k} * q{k}' for k in range(i))}) / l{i}_{i} AS q{i}" for i in range(d)]
    return f"""WITH {CASES}, {SPLIT}, {_centred_sql(SUM_INPUTS, 'revenue')}, f AS MATERIALIZED (SELECT *, {feats} FROM z), g AS (SELECT {_sums_sql(d)}, {_num(SUM['noise'])} AS noise FROM f WHERE split = 'train'),
 k AS MATERIALIZED (SELECT * FROM {_nested('g', _solved_sql(priors))}), p AS (SELECT *, {' + '.join(f'm{i} * f{i}' for i in range(d))} AS y FROM {_nested('(SELECT * FROM f, k)', q)})
 SELECT row_key, split, 'revenue' AS output, {_FIVE('y * sy + my')} AS y_pred, {_FIVE('sqrt(' + ' + '.join(f'q{i} * q{i}' for i in range(d)) + ') * sy')} AS std, {S('ev')} AS log_evidence FROM p"""


@register("m3_kernel_sum", _sum_sql())
def _(spark, sf):
    """A sum of three kernels with a lengthscale for each input: mean and deviation of every row, and the log evidence."""
    df = cases(spark, sf)
    plan = split.fit_split(df, KEY, 0.2, 0.2)
    s = materialize(spread_small(plan.apply(df), plan.cuts.n), "kernel-sum")
    model = REGISTRY.create("gp", SUM_INPUTS, ["revenue"], **SUM).fit(part(s, "train"))
    got = model.score_std(s, ["row_key", "split"]).withColumn("log_evidence", F.lit(model.log_evidence[0]))
    return sig_all(got, "log_evidence").select("row_key", "split", "output", _five("y_pred"), _five("std"), "log_evidence")


@register("m5_posterior_samples", f"WITH {CASES}, {SPLIT} SELECT row_key, 'revenue' AS output, 4::BIGINT AS samples, true AS near FROM s WHERE split = 'test'")
def _(spark, sf):
    """Four draws for every row, none further than eight posterior deviations from the posterior mean."""
    test = part(df := ready(spark, sf), "test")
    m = REGISTRY.create("gp", INPUTS, ["revenue"], n_features=64).fit(part(df, "train"))
    draws = m.sample_posterior(test, KEY, 4).groupBy(*KEY, "output").agg(F.countDistinct("sample").alias("samples"), F.min("y_pred").alias("low"), F.max("y_pred").alias("high"))
    wide = 8 * F.col("std") + 1e-6
    near = (F.col("low") >= F.col("y_pred") - wide) & (F.col("high") <= F.col("y_pred") + wide)
    return draws.join(m.score_std(test, KEY), [*KEY, "output"]).select("row_key", "output", "samples", near.alias("near"))


@register("m7_uncertainty_on_validation", f"WITH {CASES}, {SPLIT} SELECT row_key, unnest({OUTPUTS}) AS output, true AS agrees FROM s WHERE split = 'val'")
def _(spark, sf):
    """A positive deviation for every row, and the mean that the plain score gives."""
    val = part(df := ready(spark, sf), "val")
    m = REGISTRY.create("gp", INPUTS, OUTPUTS, n_features=64).fit(part(df, "train"))
    own = m.score(val, KEY).withColumnRenamed("y_pred", "own")
    both = m.score_std(val, KEY).join(own, [*KEY, "output"])
    return both.select("row_key", "output", (_close("y_pred", "own") & (F.col("std") > 0)).alias("agrees"))


@register("m14_permutation_shapley", f"WITH {CASES}, {SPLIT} SELECT row_key, 'revenue' AS output, 4::BIGINT AS features, true AS inside FROM s WHERE split = 'test'")
def _(spark, sf):
    """Every row's attributions sum to its prediction less a mean of background predictions, which lies in their range."""
    df = ready(spark, sf)
    m = REGISTRY.create("rf", INPUTS, ["revenue"], **FOREST).fit(part(df, "train"))
    phi = explain.shapley(m, part(df, "test"), KEY, background=part(df, "train"), permutations=4)
    total = phi.groupBy(*KEY, "output").agg(F.countDistinct("feature").alias("features"), F.sum("phi").alias("phi"))
    low, high = m.score(part(df, "train"), KEY).agg(F.min("y_pred"), F.max("y_pred")).first()
    base = F.col("y_pred") - F.col("phi")
    return total.join(m.score(part(df, "test"), KEY), [*KEY, "output"]).select("row_key", "output", "features", base.between(low - 1e-6, high + 1e-6).alias("inside"))


#: A forest of two trees over cases, the first with a feature twice on a path: (tree, id, left, right, feature, threshold) of its inner nodes.
SPLITS = [(0, 0, 1, 2, "l_quantity", 25.0), (0, 2, 3, 4, "l_discount", 0.05), (0, 4, 5, 6, "l_quantity", 40.0), (1, 0, 1, 2, "l_tax", 0.03), (1, 2, 3, 4, "l_quantity", 10.0)]


def _box_conditions():
    """Condition of every node of SPLITS as SQL, by (tree, id)."""
    found = {(0, 0): "true", (1, 0): "true"}
    for tree, node, left, right, feature, cut in SPLITS:
        found[tree, left] = f"{found[tree, node]} AND {feature} <= {cut}"
        found[tree, right] = f"{found[tree, node]} AND {feature} > {cut}"
    return found


def _tree_sql():
    """All coalitions of the three inputs, the trees' conditional means of each, and the weights of Shapley's sum."""
    names, boxes = ["l_quantity", "l_discount", "l_tax"], _box_conditions()
    stats = ", ".join(f"count(*) FILTER (WHERE {c})::DOUBLE AS n{t}_{i}, avg(revenue) FILTER (WHERE {c}) AS v{t}_{i}" for (t, i), c in boxes.items())
    inner = {(t, i): (left, right, f, cut) for t, i, left, right, f, cut in SPLITS}

    def value(t, i, known):
        if (t, i) not in inner:
            return f"v{t}_{i}"
        left, right, f, cut = inner[t, i]
        a, b = value(t, left, known), value(t, right, known)
        return f"CASE WHEN {f} <= {cut} THEN {a} ELSE {b} END" if f in known else f"(n{t}_{left} * ({a}) + n{t}_{right} * ({b})) / n{t}_{i}"

    sets = [[f for k, f in enumerate(names) if m >> k & 1] for m in range(8)]
    cols = ", ".join(f"(({value(0, 0, s)}) + ({value(1, 0, s)})) / 2 AS s{m}" for m, s in enumerate(sets))
    parts = []
    for k, f in enumerate(names):
        terms = " + ".join(f"(s{m | 1 << k} - s{m}) * {[2, 1, 2][bin(m).count('1')]} / 6" for m in range(8) if not m >> k & 1)
        parts.append(f"SELECT row_key, 'revenue' AS output, '{f}' AS feature, {S(terms)} AS phi FROM s8")
    return f"WITH {CASES}, {SPLIT}, st AS (SELECT {stats} FROM s WHERE split = 'train'), s8 AS (SELECT row_key, {cols} FROM s, st) {' UNION ALL '.join(parts)}"


@register("m14_tree_shapley", _tree_sql())
def _(spark, sf):
    """Exact attributions of every case by two trees with given splits, whose counts and means come from the training split."""
    df = cases(spark, sf)
    plan = split.fit_split(df, KEY, 0.2, 0.2)
    s = materialize(plan.apply(df), "tree-cases")
    names, boxes, inner = ["l_quantity", "l_discount", "l_tax"], _box_conditions(), {(t, i): r for t, i, *r in SPLITS}
    got = part(s, "train").agg(*[F.count(F.when(F.expr(c), 1)).alias(f"n{t}_{i}") for (t, i), c in boxes.items()], *[F.avg(F.when(F.expr(c), F.col("revenue"))).alias(f"v{t}_{i}") for (t, i), c in boxes.items()]).first()
    rows = []
    for t, i in boxes:
        left, right, f, cut = inner.get((t, i), (-1, -1, "l_tax", 0.0))
        rows.append((t, i, left, right, names.index(f), cut, got[f"v{t}_{i}"], float(got[f"n{t}_{i}"])))
    nodes = spark.createDataFrame(rows, tree_shapley.NODES)
    return sig_all(tree_shapley.tree_attributions(nodes, s, KEY, names, "revenue"), "phi")


@register("m14_forest_shapley", f"WITH {CASES}, {SPLIT} SELECT row_key, 'revenue' AS output, 4::BIGINT AS features, true AS adds_up FROM s WHERE split = 'test'")
def _(spark, sf):
    """Exact attributions by a fitted forest: every row's sum to its prediction less the forest's mean."""
    test = part(df := ready(spark, sf), "test")
    m = REGISTRY.create("rf", INPUTS, ["revenue"], n_estimators=12, max_depth=6).fit(part(df, "train"))
    total = m.shapley(test, KEY).groupBy(*KEY, "output").agg(F.count_distinct("feature").alias("features"), F.sum("phi").alias("phi"))
    base = tree_shapley.base_value(m.nodes(spark), len(INPUTS))
    both = total.join(m.score(test, KEY), [*KEY, "output"])
    return both.select("row_key", "output", "features", (F.abs(F.col("y_pred") - base - F.col("phi")) <= 1e-8 * (1 + F.abs("y_pred"))).alias("adds_up"))


@register("m11_tuning")
def _(spark, sf):
    df = ready(spark, sf)
    t = TuneSpec({"lengthscale": {"type": "loguniform", "low": 0.5, "high": 8.0}, "kernel": {"type": "categorical", "choices": ["rbf", "matern32"]}}, n_trials=4)
    got = tuning.tune(ModelSpec("gp", params={"n_features": 48}, tune=t), df, INPUTS, OUTPUTS, KEY)
    return trials.best_so_far(got.trials.withColumn("study", F.lit("gp"))).select("study", "number", "value", "best_value", "is_best_yet")


HALVING = {"alpha": {"type": "loguniform", "low": 1e-3, "high": 1e7}}


@register("m11_halving", """SELECT rung::BIGINT AS rung, [12, 4, 1][rung + 1]::BIGINT AS trials, rung = 2 AS all_rows, true AS best_go_on FROM (SELECT unnest([0, 1, 2]) AS rung)""")
def _(spark, sf):
    """Ridge strengths by successive halving: trials of each rung, and whether none that stopped was better than one that went on."""
    data = split_once(cases(spark, sf).select("row_key", *INPUTS, "revenue"), "halving")
    found = tuning.tune(ModelSpec("linear", tune=TuneSpec(HALVING, n_trials=12, method="halving")), data, INPUTS, ["revenue"], KEY)
    t = found.trials
    later = t.select("number", (F.col("rung") - 1).alias("rung"), F.lit(True).alias("on"))
    both = t.join(later, ["number", "rung"], "left").groupBy("rung").agg(
        F.count(F.lit(1)).alias("trials"), (F.max("budget") == 1).alias("all_rows"), F.max(F.when(F.col("on"), F.col("value"))).alias("worst_on"), F.min(F.when(F.col("on").isNull(), F.col("value"))).alias("best_off"))
    return both.select("rung", "trials", "all_rows", F.coalesce(F.col("worst_on") <= F.col("best_off"), F.lit(True)).alias("best_go_on"))


@register("m16_scoring_profile")
def _(spark, sf):
    s, model = _one(spark, sf)
    return workflow.scoring_profile(model, s, "line", 3)


@register("m16_profile_counts", f"""WITH {CASES} SELECT 'line' AS model, 'rows' AS metric, count(*)::DOUBLE AS value, true AS timed FROM cases UNION ALL SELECT 'line', 'weights', 4.0::DOUBLE, true""")
def _(spark, sf):
    """The facts of a profile that don't depend on the clock, and whether its three timings are positive and agree."""
    s, model = _one(spark, sf)
    got = workflow.scoring_profile(model, s, "line", 3)
    v = {m: F.max(F.when(F.col("metric") == m, F.col("value"))) for m in ("rows", "seconds", "ms_per_row", "rows_per_second")}
    agree = (v["seconds"] > 0) & (F.abs(v["ms_per_row"] * v["rows_per_second"] - 1000) < 1e-6) & (F.abs(v["rows_per_second"] * v["seconds"] - v["rows"]) < 1e-3)
    timed = got.groupBy("model").agg(agree.alias("timed"))
    return got.where(F.col("metric").isin("rows", "weights")).join(timed, "model").select("model", "metric", "value", "timed")


@register("m17_leaderboard", f"""WITH {ONE}, pred AS (SELECT split, 'revenue' AS output, revenue AS y_true, a * l_extendedprice + b AS y_pred FROM s, w UNION ALL
  SELECT split, 'charge', charge, c * l_extendedprice + d FROM s, w), {output_metrics_sql('pred', 'split, output')}
 SELECT 'line' AS model, split, {S('1 - sum(sse) / sum(sst)')} AS r2, {S('sqrt(avg(mse))')} AS rmse, (SELECT count(*)::DOUBLE FROM cases) AS rows, 4.0::DOUBLE AS weights
 FROM om WHERE split = 'test' GROUP BY 2""")
def _(spark, sf):
    s, model = _one(spark, sf)
    m = metrics.split_metrics(tuning.scored_long(model, s, ["split"]).withColumn("model", F.lit("line")))
    board = workflow.leaderboard(m, workflow.scoring_profile(model, s, "line", 2))
    return sig_all(board, "r2", "rmse").select("model", "split", "r2", "rmse", "rows", "weights")
