"""Reports that combine several operators: dataset, analysis suite and campaign."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulake.operators import campaign, profile, roles


def campaign_report(cases: DataFrame, queued: DataFrame | None = None) -> DataFrame:
    """(section, name, value): status counts, remaining cases per run, run times, throughput, completion."""

    def rows(section: str, name, value) -> list:
        return [F.lit(section).alias("section"), name.alias("name"), value.cast("double").alias("value")]

    out = campaign.status_counts(cases).select(*rows("status", F.col("status"), F.col("n")))
    by_run = campaign.status_by_run(cases)
    out = out.unionByName(by_run.select(*rows("remaining", F.col("run"), F.col("remaining"))))
    stats = campaign.runtime_stats(cases)
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in ("avg_s", "min_s", "max_s")])
    out = out.unionByName(stats.select(F.lit("runtime").alias("section"), F.inline(cells)))
    rate = campaign.throughput(cases)
    out = out.unionByName(rate.select(*rows("throughput", F.lit("per_hour"), F.col("per_hour"))))
    if queued is not None:
        s = campaign.campaign_summary(campaign.run_completion(cases, queued)).drop("completed_pct")
        cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in s.columns])
        out = out.unionByName(s.select(F.lit("summary").alias("section"), F.inline(cells)))
    return out


def dataset_report(df: DataFrame, metadata: Mapping | None = None, hints: Mapping | None = None, key: Sequence[str] = ()) -> DataFrame:
    """(section, name, value): shape, roles, missing counts and statistics of one table."""
    spark = df.sparkSession
    spec = roles.dataset_spec(df, metadata, hints, key)
    counts = roles.cell_counts(df, "t")
    shape = counts.agg(F.max("n_rows").alias("v")).select(F.lit("shape").alias("section"), F.lit("rows").alias("name"), F.col("v").cast("double").alias("value"))
    facts = [("shape", "columns", float(len(df.columns)))]
    facts += [("input", c, float(i)) for i, c in enumerate(spec.inputs)] + [("output", c, float(i)) for i, c in enumerate(spec.outputs)]
    facts += [("group", g, float(len(m))) for g, m in spec.groups.items()]
    out = shape.unionByName(spark.createDataFrame(facts, "section string, name string, value double"))
    out = out.unionByName(counts.where("n_missing > 0").select(F.lit("missing").alias("section"), F.col("column").alias("name"), F.col("n_missing").cast("double").alias("value")))
    out = out.unionByName(roles.completeness(counts).select(F.lit("completeness").alias("section"), F.lit("percent").alias("name"), F.col("completeness_percent").alias("value")))
    stats = profile.describe(df, [c for c in spec.inputs + spec.outputs if c in profile.numeric_columns(df)])
    cells = F.array(*[F.struct(F.concat_ws(".", F.col("column"), F.lit(s)).alias("name"), F.col(s).cast("double").alias("value"))
                      for s in ("mean", "std", "min", "q25", "q50", "q75", "max", "variance")])
    return out.unionByName(stats.select(F.lit("statistic").alias("section"), F.inline(cells)))


def analysis_suite(df: DataFrame, inputs: Sequence[str], outputs: Sequence[str], profile_array: str | None = None) -> dict[str, DataFrame]:
    """The tables behind the standard analysis: distributions, signal to noise, correlations, strongest pair."""
    cols = [*inputs, *outputs]
    out = {
        "distributions": profile.distributions(df, cols),
        "signal_to_noise": profile.signal_to_noise(df, cols),
        "correlations": profile.correlations(df, inputs, outputs),
        "strongest_pair": profile.strongest_pair(df, inputs, outputs),
    }
    if profile_array:
        out["profile_mean_std"] = profile.profile_mean_std(df, profile_array)
    return out
