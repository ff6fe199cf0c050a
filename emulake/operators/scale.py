"""Standardising and min-max scaling. Fitting is one aggregate; applying is a projection of literals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emulake.functions.numeric import known

SCALER_SCHEMA = T.StructType(
    [
        T.StructField("column", T.StringType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("scale", T.DoubleType()),
    ]
)
WIDE = 200  # beyond this many columns aggregate in long form, so generated code stays small


def long_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, value): one row per cell."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.inline(cells))


def column_stats(df: DataFrame, columns: Sequence[str], stats: dict) -> dict[str, dict[str, float]]:
    """``{column: {stat: value}}`` for named aggregate functions; one pass, output bounded by the schema."""
    if len(columns) > WIDE:
        aggs = [fn(known("value")).alias(s) for s, fn in stats.items()]
        rows = long_values(df, columns).groupBy("column").agg(*aggs).collect()
        return {r["column"]: {s: r[s] for s in stats} for r in rows}
    # NaN to NULL in a projection first: the aggregate's generated code then stays small
    clean = df.select(*[known(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    aggs = [fn(f"c{i}").alias(f"{s}_{i}") for i in range(len(columns)) for s, fn in stats.items()]
    row = clean.agg(*aggs).first()
    return {c: {s: row[f"{s}_{i}"] for s in stats} for i, c in enumerate(columns)}


@dataclass
class Scaler:
    """Per-column shift and divisor."""

    params: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        new = {c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.params.items() if c in df.columns}
        return df.withColumns(new)

    def inverse(self, df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
        """Undo the scaling; ``mapping`` sends a column of ``df`` to the fitted column whose scale it has."""
        pairs = mapping or {c: c for c in self.params}
        new = {c: F.col(c) * F.lit(self.params[src][1]) + F.lit(self.params[src][0]) for c, src in pairs.items()}
        return df.withColumns({c: e for c, e in new.items() if c in df.columns})

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c, m, s) for c, (m, s) in self.params.items()], SCALER_SCHEMA)

    @classmethod
    def from_frame(cls, frame: DataFrame) -> Scaler:
        """Stored scalers (one row per column) back into a transform."""
        return cls({r["column"]: (r["mean"], r["scale"]) for r in frame.collect()})


def fit_standard(train: DataFrame, columns: Sequence[str]) -> Scaler:
    """Mean and population deviation of the training rows; a constant column is divided by 1."""
    got = column_stats(train, columns, {"m": F.avg, "s": F.stddev_pop})
    return Scaler({c: (v["m"] or 0.0, v["s"] or 1.0) for c, v in got.items()})


def fit_minmax(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """Map to [0, 1]; constant columns are left as they are."""
    got = column_stats(df, columns, {"lo": F.min, "hi": F.max})
    params = {}
    for c, v in got.items():
        varies = v["lo"] is not None and v["hi"] > v["lo"]
        params[c] = (v["lo"], v["hi"] - v["lo"]) if varies else (0.0, 1.0)
    return Scaler(params)


def original_units(pred: DataFrame, scaler: Scaler | None, columns: tuple[str, ...] = ("y_true", "y_pred")) -> DataFrame:
    """Undo the output scaling of long predictions."""
    if scaler is None:
        return pred
    table = F.create_map(*[x for o, (m, s) in scaler.params.items() for x in (F.lit(o), F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")))])
    p = table[F.col("output")]
    return pred.withColumns({c: F.col(c) * p["s"] + p["m"] for c in columns})
