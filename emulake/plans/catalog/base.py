"""Registry of demonstration queries with their SQL twins, and the views both sides start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- presentation: seven significant digits, the same text rule in both engines ---------------------
# Two-decimal prices give exact decimal ties, which the engines round differently; a fixed relative
# nudge far below the shown digits moves every value off its tie first.
NUDGE = 1.00000000037


def sig(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    x = c.cast("double") * F.lit(NUDGE)
    return F.when(F.abs(x) < 1e-9, F.lit(0.0)).otherwise(F.format_string("%.6e", x).try_cast("double"))


def sig_all(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: sig(n) for n in names})


def S(x: str) -> str:
    x = f"({x})::DOUBLE * {NUDGE}::DOUBLE"
    return f"(CASE WHEN abs({x}) < 1e-9 THEN 0.0::DOUBLE ELSE printf('%.6e', {x})::DOUBLE END)"


# --- the wide case table: lineitem as simulation cases ----------------------------------------------

INPUTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
OUTPUTS = ["revenue", "charge"]
ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """One row per case: key, four inputs, two derived outputs, and a label."""
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ROW_KEY]).alias("row_key"),
        "l_linenumber", "l_returnflag", *INPUTS,
        revenue.alias("revenue"), (revenue * (1 + F.col("l_tax"))).alias("charge"),
    )


CASES = """cases AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS row_key,
         l_linenumber, l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax,
         l_extendedprice * (1 - l_discount) AS revenue,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge
  FROM lineitem)"""


def hash_sql(seed: int | str, *keys: str) -> str:
    return f"md5(concat_ws('|', {seed}, {', '.join(keys)}))"


def ranked_sql(source: str, key: str, seed: int | str = 42, partition: str = "") -> str:
    """SQL ranking ``source`` by seeded hash."""
    over = f"PARTITION BY {partition} " if partition else ""
    return f"SELECT *, row_number() OVER ({over}ORDER BY {hash_sql(seed, key)}, {key}) AS rk FROM {source}"


def split_sql(source: str, key: str, test: float = 0.2, val: float = 0.1, seed: int = 42, name: str = "s") -> str:
    """CTEs giving ``source`` a shuffled exact split column."""
    share = val / (1.0 - test)
    return f"""{name}_r AS ({ranked_sql(source, key, seed)}),
{name}_n AS (SELECT count(*) AS n, ceil({test!r}::DOUBLE * count(*))::BIGINT AS nt FROM {source}),
{name}_m AS (SELECT n, nt, ceil({share!r}::DOUBLE * (n - nt))::BIGINT AS nv FROM {name}_n),
{name} AS (SELECT r.*, CASE WHEN rk <= nt THEN 'test' WHEN rk <= nt + nv THEN 'val' ELSE 'train' END AS split
  FROM {name}_r r, {name}_m)"""


# --- two fixed linear formulas stand for two models --------------------------------------------------


def formulas() -> dict[str, dict[str, Column]]:
    """Predictions of models A and B for each output."""
    p = F.col("l_extendedprice")
    return {
        "A": {"revenue": p * 0.95, "charge": p * 0.99},
        "B": {"revenue": p * 0.9 + 100, "charge": p * (1 - F.col("l_discount"))},
    }


def two_models(df: DataFrame, keep: list[str]) -> DataFrame:
    """Long predictions of models A and B for both outputs, next to the truth."""
    cells = [
        F.struct(F.lit(m).alias("model"), F.lit(o).alias("output"), F.col(o).alias("y_true"), y.alias("y_pred"))
        for m, outputs in formulas().items() for o, y in outputs.items()]
    return df.select(*keep, F.inline(F.array(*cells)))


def two_models_sql(source: str, keep: str, name: str = "pred") -> str:
    head = f"SELECT {keep},"
    return f"""{name} AS (
  {head} 'A' AS model, 'revenue' AS output, revenue AS y_true, l_extendedprice * 0.95::DOUBLE AS y_pred FROM {source} UNION ALL
  {head} 'A', 'charge', charge, l_extendedprice * 0.99::DOUBLE FROM {source} UNION ALL
  {head} 'B', 'revenue', revenue, l_extendedprice * 0.9::DOUBLE + 100 FROM {source} UNION ALL
  {head} 'B', 'charge', charge, l_extendedprice * (1 - l_discount) FROM {source})"""


def output_metrics_sql(source: str, by: str, name: str = "om") -> str:
    """Per-output metrics CTE in SQL, matching the metric definitions."""
    return f"""{name} AS (SELECT {by}, n, sse, sst,
    CASE WHEN sst = 0 THEN CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - sse / sst END AS r2,
    sse / n AS mse, sqrt(sse / n) AS rmse, sae / n AS mae, spe / n AS mape, mean_error, std_error
  FROM (SELECT {by}, count(*) AS n, sum((y_pred - y_true) * (y_pred - y_true)) AS sse, sum(abs(y_pred - y_true)) AS sae,
    sum(abs(y_pred - y_true) / greatest(abs(y_true), 2.220446049250313e-16)) AS spe,
    var_pop(y_true) * count(y_true) AS sst, avg(y_pred - y_true) AS mean_error, stddev_pop(y_pred - y_true) AS std_error
    FROM {source} GROUP BY {by}))"""
