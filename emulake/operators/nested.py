"""Nested case records to training tables, and the joins that assemble them.

A record has ``run_id, eq_id, miller(struct), parset(names, values), q(psin, profile), p(profile),
q95, growth_rate, m_modes, spec`` with ``spec`` a matrix of (re, im). Profiles and spectra stay arrays;
``spread`` turns them into columns only where a consumer needs that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emulake.functions import arrays

MILLER = ("R0", "a", "kappa", "delta")  # fixed values: shape parameters of an equilibrium
EQ_KEYS = ("a", "R0", "kappa", "delta", "simag", "sibry", "current")  # fixed values: carried equilibrium scalars
MODES_KEPT = 20  # fixed value: modes with an amplitude feature


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def features(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Input columns of a record: ``eq_*`` shape, ``input_<name>`` parameters, q0, qmin, q95, p0, gamma."""
    out = [F.col("miller")[k].cast("double").alias(f"eq_{k}") for k in MILLER] if _has(df, "miller") else []
    if _has(df, "parset"):
        by_name = F.map_from_arrays(F.slice(F.col("parset.names"), F.lit(1), F.size("parset.values")),
                                    F.slice(F.col("parset.values"), F.lit(1), F.size("parset.names")))
        out += [F.try_element_at(by_name, F.lit(n)).cast("double").alias(f"input_{n}") for n in names]
    if _has(df, "q"):
        q, grid = F.col("q.profile"), F.col("q.psin")
        given = F.col("q95") if _has(df, "q95") else F.lit(None)
        out += [F.get(q, 0).alias("q0"), F.array_min(q).alias("qmin"),
                F.coalesce(given.cast("double"), arrays.at_fraction(q, grid)).alias("q95")]
    if _has(df, "p"):
        out.append(F.get(F.col("p.profile"), 0).alias("p0"))
    if _has(df, "growth_rate"):
        out.append(F.col("growth_rate").cast("double").alias("gamma"))
    return out


def case_table(df: DataFrame, names: Sequence[str], shape: tuple[int, int] | None = None, mode_step: int | None = None,
               point_step: int | None = None) -> DataFrame:
    """One row per case; the spectrum magnitude is flattened into the array ``output_p``."""
    spec = arrays.magnitude(F.col("spec"))
    if shape is not None:
        spec = arrays.resample(spec, *shape)
    elif mode_step or point_step:
        spec = arrays.thin(spec, mode_step, point_step)
    return df.select("run_id", "eq_id", *features(df, names), F.flatten(spec).alias("output_p"))


def mode_table(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per (case, mode) at native resolution: features, n, m and the mode's profile."""
    base = df.select("run_id", "eq_id", *features(df, names), F.arrays_zip(F.col("m_modes").alias("m"), arrays.magnitude(F.col("spec")).alias("y")).alias("z"))
    n = F.coalesce(*[F.col(c) for c in ("input_ntor", "input_n") if c in base.columns], F.lit(0.0))
    rows = base.select(*[c for c in base.columns if c != "z"], n.alias("n"), F.posexplode("z").alias("mode_idx", "z"))
    return rows.select(*[c for c in rows.columns if c != "z"], F.col("z.m").cast("bigint").alias("m"), F.col("z.y").alias("output_p"))


def spread(df: DataFrame, array: str, n: int) -> DataFrame:
    """Array to columns ``<array>_0..n-1``, for narrow consumers only; an array of over ``n`` positions is an error."""
    return df.select(*[c for c in df.columns if c != array], *[arrays.only(array, i, n).alias(f"{array}_{i}") for i in range(n)])


def mode_amplitudes(df: DataFrame, keep: int = MODES_KEPT) -> DataFrame:
    """(run_id, mode_idx, amplitude): the largest |value| over a mode's points, first ``keep`` modes."""
    amp = F.transform(F.slice(arrays.magnitude(F.col("spec")), 1, keep), lambda row: F.array_max(row))
    return df.select("run_id", F.posexplode(amp).alias("mode_idx", "amplitude"))


def flatten_run(df: DataFrame, maps: dict[str, str], key: str = "run_id") -> DataFrame:
    """(key, name, value) from map-of-array columns: ``<prefix>_<k>`` for one value, ``<prefix>_<k>_<i>`` for more."""
    out = None
    for column, prefix in maps.items():
        e = df.select(key, F.explode(column).alias("k", "a")).select(key, "k", F.size("a").alias("n"), F.posexplode("a").alias("i", "v"))
        name = F.when(F.col("n") == 1, F.concat_ws("_", F.lit(prefix), "k")).otherwise(F.concat_ws("_", F.lit(prefix), "k", F.col("i").cast("string")))
        part = e.select(key, name.alias("name"), F.col("v").cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def attach_equilibrium(runs: DataFrame, equilibria: DataFrame, run_key: str = "eqid") -> DataFrame:
    """Left join of runs to equilibria by id. The first equilibrium (by name) wins when ids repeat.

    ``equilibria`` has ``name, id`` and any of the carried scalars, ``qpsi`` and ``pres`` arrays. Sizes decide
    the join: Spark broadcasts a small dictionary and shuffles a large one.
    """
    payload = [c for c in equilibria.columns if c != "id"]
    one = equilibria.groupBy("id").agg(F.min_by(F.struct(*payload), "name").alias("e"))
    cols = [F.col(f"e.{k}").cast("double").alias(f"eq_{k}") for k in EQ_KEYS if k in payload]
    if "qpsi" in payload:
        q = F.col("e.qpsi")
        cols += [F.get(q, 0).alias("q0"), arrays.at_fraction(q, q).alias("q95"), F.array_min(q).alias("qmin")]
    if "pres" in payload:
        cols.append(F.get(F.col("e.pres"), 0).alias("p0"))
    ready = one.select(F.col("id").alias(run_key), *cols)
    return runs.join(ready, run_key, "left")


def stack_cases(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of tables with differing columns; absent columns are NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def split_rejects(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejects with the first missing field)."""
    reason = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required])
    marked = df.withColumn("missing_field", reason)
    return marked.where("missing_field IS NULL").drop("missing_field"), marked.where("missing_field IS NOT NULL")


def grid_to_long(df: DataFrame, dims: dict[str, str], variable: str, keep: Sequence[str] = ()) -> DataFrame:
    """Gridded variable (nested arrays) to one row per coordinate combination.

    ``dims`` maps an output column to the coordinate array, outermost first.
    """
    out = df.select(*keep, *dims.values(), F.col(variable).alias("__v"))
    done: list[str] = list(keep)
    for name, coord in dims.items():
        rest = [c for c in dims.values() if c in out.columns and c != coord]
        out = out.select(*done, *rest, coord, F.posexplode("__v").alias("__i", "__w"))
        out = out.select(*done, *rest, F.get(coord, F.col("__i")).alias(name), F.col("__w").alias("__v"))
        done.append(name)
    return out.select(*done, F.col("__v").cast("double").alias("value"))


def recover_rows(pred: DataFrame, data: DataFrame, key: str = "row_key") -> DataFrame:
    """Predictions with the inputs and truth of their own rows, by key rather than position."""
    return pred.join(data, key)


def side_by_side(left: DataFrame, right: DataFrame, row_idx: str = "row_idx") -> DataFrame:
    """Two blocks of the same rows joined on the row index."""
    return left.join(right, row_idx)


def attach_predictions(data: DataFrame, pred: DataFrame, model: str, key: str = "row_key", value: str = "y_pred") -> DataFrame:
    """Add ``<model>_<value>``; rows the model did not cover get 0.0."""
    name = f"{model}_{value}"
    p = pred.select(key, F.col(value).alias(name))
    return data.join(p, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))


# Schema of a record as DDL text, for spark.read.schema().
RECORD = (
    "run_id string, eq_id string, miller struct<R0:double,a:double,kappa:double,delta:double>, "
    "parset struct<names:array<string>,values:array<double>>, q struct<psin:array<double>,profile:array<double>>, "
    "p struct<profile:array<double>>, q95 double, growth_rate double, m_modes array<int>, spec array<array<struct<re:double,im:double>>>")
