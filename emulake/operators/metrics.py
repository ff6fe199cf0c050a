"""Accuracy metrics over prediction tables ``(..., output, y_true, y_pred)`` in long form.

All models, splits and outputs share one aggregate; only per-output sums cross the network.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emulake.functions.numeric import is_finite, safe_div

EPS = 2.220446049250313e-16  # fixed value: smallest denominator of the percentage error


def predictions_long(df: DataFrame, keep: Sequence[str], outputs: dict[str, tuple[Column | str, Column | str]]) -> DataFrame:
    """Wide truth/prediction pairs to ``(keep..., output, y_true, y_pred)``."""

    def as_col(c):
        return F.col(c) if isinstance(c, str) else c

    cells = [
        F.struct(F.lit(o).alias("output"), as_col(t).cast("double").alias("y_true"), as_col(p).cast("double").alias("y_pred"))
        for o, (t, p) in outputs.items()
    ]
    return df.select(*keep, F.inline(F.array(*cells)))


def r2_from(sse: Column, sst: Column, flat: Column | None = None) -> Column:
    """1 - SSE/SST; with no spread in the truth: 1 for a perfect fit, else 0 (or ``flat`` if given)."""
    constant = flat if flat is not None else F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(sst == 0, constant).otherwise(F.lit(1.0) - safe_div(sse, sst))


def error_sums(pred: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mergeable sums per group: n, sse, sae, spe (relative), sst, mean and deviation of the error.

    Pairs with a NULL on either side count nowhere, neither in n nor in the spread of the truth.
    """
    e = F.col("y_pred") - F.col("y_true")
    rel = F.abs(e) / F.greatest(F.abs(F.col("y_true")), F.lit(EPS))
    rows = pred.withColumns({"__e": e, "__e2": e * e, "__a": F.abs(e), "__p": rel, "__t": F.when(e.isNotNull(), F.col("y_true"))})
    return rows.groupBy(*by).agg(
        F.count("__e").alias("n"),
        F.sum("__e2").alias("sse"),
        F.sum("__a").alias("sae"),
        F.sum("__p").alias("spe"),
        (F.var_pop("__t") * F.count("__t")).alias("sst"),
        F.avg("__e").alias("mean_error"),
        F.stddev_pop("__e").alias("std_error"),
    )


def wide_error_sums(df: DataFrame, by: Sequence[str], outputs: dict[str, tuple[Column | str, Column | str]]) -> DataFrame:
    """``error_sums`` for truth/prediction pairs that sit side by side in one row.

    All pairs are summed in one aggregate and only its few result rows are unpivoted, so the table is not
    multiplied by the number of outputs. For very many outputs use the long form instead.
    """
    names = list(outputs)

    def as_col(c):
        return (F.col(c) if isinstance(c, str) else c).cast("double")

    rows = df.select(*by, *[F.when(as_col(p).isNotNull(), as_col(t)).alias(f"__t{i}") for i, (t, p) in enumerate(outputs.values())],
                     *[(as_col(p) - as_col(t)).alias(f"__e{i}") for i, (t, p) in enumerate(outputs.values())])
    aggs = []
    for i, o in enumerate(names):
        t, e = F.col(f"__t{i}"), F.col(f"__e{i}")
        aggs.append(F.struct(
            F.lit(o).alias("output"), F.count(e).alias("n"), F.sum(e * e).alias("sse"), F.sum(F.abs(e)).alias("sae"),
            F.sum(F.abs(e) / F.greatest(F.abs(t), F.lit(EPS))).alias("spe"), (F.var_pop(t) * F.count(t)).alias("sst"),
            F.avg(e).alias("mean_error"), F.stddev_pop(e).alias("std_error")).alias(f"__s{i}"))
    return rows.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*[F.col(f"__s{i}") for i in range(len(names))])))


def output_metrics(pred: DataFrame, by: Sequence[str]) -> DataFrame:
    """R2, MSE, RMSE, MAE, MAPE and error moments per group of ``by`` (which should include ``output``)."""
    return from_sums(error_sums(pred, by), by)


def from_sums(s: DataFrame, by: Sequence[str]) -> DataFrame:
    """Metrics from error sums."""
    n = F.col("n")
    return s.select(
        *by, "n",
        r2_from(F.col("sse"), F.col("sst")).alias("r2"),
        (F.col("sse") / n).alias("mse"),
        F.sqrt(F.col("sse") / n).alias("rmse"),
        (F.col("sae") / n).alias("mae"),
        (F.col("spe") / n).alias("mape"),
        "mean_error", "std_error", "sse", "sst",
    )


def roll_up(per_output: DataFrame, by: Sequence[str]) -> DataFrame:
    """Combine outputs: variance-weighted and uniform R2, RMSE as the root of the mean per-output MSE."""
    spread = F.sum("sst")
    explained = F.sum(F.when(F.col("sst") > 0, F.col("sse")).otherwise(0.0))
    flat = F.when(F.sum("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return per_output.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.count(F.lit(1)).alias("n_outputs"),
        F.when(spread == 0, flat).otherwise(1.0 - safe_div(explained, spread)).alias("r2"),
        F.when(F.count(F.lit(1)) > 1, F.avg("r2")).alias("r2_uniform_average"),
        F.avg("mse").alias("mse"),
        F.sqrt(F.avg("mse")).alias("rmse"),
        F.avg("mae").alias("mae"),
        F.avg("mape").alias("mape"),
    )


def split_metrics(pred: DataFrame, by: Sequence[str] = ("model", "split")) -> DataFrame:
    """Metrics per model and split over all outputs."""
    return roll_up(output_metrics(pred, [*by, "output"]), by)


def quick_metrics(pred: DataFrame, seconds: float | None = None) -> DataFrame:
    """MSE, R2 and, given the scoring time, seconds per row."""
    m = roll_up(output_metrics(pred, ["output"]), [])
    per_row = F.lit(seconds) / F.col("n") if seconds is not None else F.lit(None).cast("double")
    return m.select("mse", "r2", per_row.alias("seconds_per_row"))


def metric_summary(results: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each metric over repeated runs, long form."""
    long = results.select(*by, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    return long.groupBy(*by, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"),
    )


def finite_pairs(df: DataFrame, a: str, b: str, positive: bool = False) -> DataFrame:
    """Rows where both values are finite (and above zero)."""
    keep = is_finite(a) & is_finite(b)
    if positive:
        keep = keep & (F.col(a) > 0) & (F.col(b) > 0)
    return df.where(keep)


def finite_r2(pred: DataFrame, by: Sequence[str]) -> DataFrame:
    """R2 over finite pairs only; a constant truth scores 0."""
    s = error_sums(finite_pairs(pred, "y_true", "y_pred"), by)
    return s.select(*by, "n", r2_from(F.col("sse"), F.col("sst"), F.lit(0.0)).alias("r2"))


def group_metrics(pred: DataFrame, groups: dict[str, str], by: Sequence[str] = ("model",)) -> DataFrame:
    """Per-profile-group RMSE, MAE and uniform R2; ``groups`` maps an output to its group."""
    mapping = F.create_map(*[x for o, g in groups.items() for x in (F.lit(o), F.lit(g))])
    per = output_metrics(pred, [*by, "output"]).withColumn("grp", F.try_element_at(mapping, F.col("output")))
    rolled = per.where("grp IS NOT NULL").groupBy(*by, "grp").agg(
        F.sqrt(F.avg("mse")).alias("rmse"), F.avg("mae").alias("mae"), F.avg("r2").alias("r2"),
        F.count(F.lit(1)).alias("n_outputs"))
    return rolled


def r2_grid(pred: DataFrame) -> DataFrame:
    """R2 per (model, split, output) and over all outputs (output NULL), from one pass over the rows."""
    per = output_metrics(pred, ["model", "split", "output"])
    per = per.withColumns({"__sse": F.when(F.col("sst") > 0, F.col("sse")).otherwise(0.0)})
    sets = per.groupingSets([["model", "split", "output"], ["model", "split"]], "model", "split", "output")
    got = sets.agg(F.sum("__sse").alias("a"), F.sum("sst").alias("t"), F.sum("sse").alias("s"))
    flat = F.when(F.col("s") == 0, 1.0).otherwise(0.0)
    return got.select("model", "split", "output", F.when(F.col("t") == 0, flat).otherwise(1.0 - safe_div(F.col("a"), F.col("t"))).alias("r2"))


def case_profile_mse(pred: DataFrame, key: str = "row_key") -> DataFrame:
    """Mean squared error of each case over all points of its profile, per model."""
    e = F.col("y_pred") - F.col("y_true")
    return pred.groupBy("model", key).agg(F.avg(e * e).alias("mse"))


def compare_models(pred: DataFrame, a: str, b: str, key: Sequence[str] = ("row_key", "output")) -> DataFrame:
    """Squared error of two models on the same truth. Keys are unique per model, so a pivoting aggregate
    replaces the self-join and the table is shuffled once."""
    e2 = (F.col("y_pred") - F.col("y_true")) ** 2
    both = pred.where(F.col("model").isin(a, b)).groupBy(*key).agg(
        F.max("y_true").alias("y_true"),
        F.max(F.when(F.col("model") == a, e2)).alias("err_a"),
        F.max(F.when(F.col("model") == b, e2)).alias("err_b"),
    )
    return both.where("err_a IS NOT NULL AND err_b IS NOT NULL")


def compare_wide(df: DataFrame, outputs: dict[str, tuple[Column, Column, Column]], key: Sequence[str] = ("row_key",)) -> DataFrame:
    """``compare_models`` for a table with one case in a row; ``outputs`` has the truth and both models' predictions of each output.

    The errors of a case are shuffled together, under one key, and leave side by side. As few keys repeat, rows are dealt
    by key before they are aggregated: a task that reads them would only hold every key it meets, and spill.
    """
    cells = {f"__{name}{i}": c for i, (y, a, b) in enumerate(outputs.values()) for name, c in (("y_true", y), ("err_a", (a - y) ** 2), ("err_b", (b - y) ** 2))}
    rows = df.select(*key, *[c.alias(n) for n, c in cells.items()]).repartition(*key)
    both = rows.groupBy(*key).agg(*[F.max(n).alias(n) for n in cells]).withColumn("output", F.explode(F.array(*[F.lit(o) for o in outputs])))

    def of_output(name: str) -> Column:
        return F.coalesce(*[F.when(F.col("output") == o, F.col(f"__{name}{i}")) for i, o in enumerate(outputs)]).alias(name)

    return both.select(*key, "output", *[of_output(n) for n in ("y_true", "err_a", "err_b")]).where("err_a IS NOT NULL AND err_b IS NOT NULL")


def log_error_correlation(errors: DataFrame) -> DataFrame:
    """Correlation of log10 errors over rows where both are positive and finite."""
    ok = finite_pairs(errors, "err_a", "err_b", positive=True)
    return ok.agg(F.count(F.lit(1)).alias("n"), F.corr(F.log10("err_a"), F.log10("err_b")).alias("r"))


def error_trend(errors: DataFrame, x: str = "err_a", y: str = "err_b", max_bins: int = 20) -> DataFrame:
    """Mean x and y in log-spaced half-open bins of x; the largest x lies outside the last bin.

    The number of bins is min(20, n // 5); empty bins are absent.
    """
    ok = finite_pairs(errors, x, y, positive=True).select(F.col(x).alias("x"), F.col(y).alias("y"))
    lim = ok.agg(F.min(F.log10("x")).alias("lo"), F.max(F.log10("x")).alias("hi"), F.max("x").alias("top"),
                 F.count(F.lit(1)).alias("n")).first()
    bins = min(max_bins, lim.n // 5)
    if lim.n <= 10 or bins < 2 or lim.hi <= lim.lo:
        return ok.limit(0).select(F.lit(0).cast("bigint").alias("bin"), F.lit(0).cast("bigint").alias("n"),
                                  F.col("x").alias("x_mean"), F.col("y").alias("y_mean"))
    at = F.floor((F.log10("x") - F.lit(lim.lo)) / F.lit(lim.hi - lim.lo) * bins).cast("bigint")
    return ok.where(F.col("x") < F.lit(lim.top)).groupBy(F.least(at, F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("x_mean"), F.avg("y").alias("y_mean"))


def ensemble(members: DataFrame, by: Sequence[str] = ("row_key", "output")) -> DataFrame:
    """Mean, population deviation and member count of member predictions ``(..., member, y_pred)``."""
    return members.groupBy(*by).agg(
        F.avg("y_pred").alias("mean"), F.stddev_pop("y_pred").alias("std"), F.count("y_pred").alias("n_members"))


def fold_summary(per_fold: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Cross-validation result: mean, population deviation and extremes of the fold metrics."""
    return metric_summary(per_fold, by, ["r2", "rmse", "mse", "mae"])


def tuning_gain(trials: DataFrame, baseline: DataFrame, by: Sequence[str] = ("study",)) -> DataFrame:
    """Best trial R2 minus the baseline R2 of the same study."""
    best = trials.groupBy(*by).agg(F.max("r2").alias("best_r2"))
    return best.join(baseline, list(by)).select(*by, "best_r2", "baseline_r2", (F.col("best_r2") - F.col("baseline_r2")).alias("gain"))
