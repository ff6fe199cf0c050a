"""Feature attributions by sampled permutations, and their global summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emulake.functions.hashing import seeded_hash, uniform
from emulake.models.base import Model, list_column, matrix
from emulake.operators.rank import hash_rank, sample_exact

BACKGROUND_ROWS = 100  # fixed value: rows that stand for "feature absent"


def shapley(model: Model, df: DataFrame, key: Sequence[str], background: DataFrame | None = None, permutations: int = 10,
            max_rows: int | None = None, background_rows: int = BACKGROUND_ROWS, seed: int = 42) -> DataFrame:
    """(key..., output, feature, phi): mean marginal effect of switching a feature from background to the row.

    A model that has ``in_rows`` scores a row's permutations and switch steps where the row is, and only the row's phi are
    shuffled; rows that share a key get the mean of theirs. For other models rows are exploded into permutations and steps, scored in
    one pass, and regrouped by a shuffle of them all. The sum of a row's phi equals its prediction minus the mean prediction of the
    background rows it met.
    Every row is explained; with ``max_rows`` an exact seeded sample is.
    """
    key, d = list(key), len(model.inputs)
    rows = sample_exact(df, max_rows, key, seed) if max_rows else df
    bg = sample_exact(background if background is not None else df, background_rows, key, seed + 1)
    bg = hash_rank(bg, key, seed + 2, rank="bg_no").select("bg_no", F.array(*[F.col(c).cast("double") for c in model.inputs]).alias("__z"))
    x = rows.select(*key, F.array(*[F.col(c).cast("double") for c in model.inputs]).alias("__x"))
    predict = model.in_rows(df.sparkSession)
    if predict is not None:
        z = [r["__z"] for r in bg.orderBy("bg_no").collect()]  # at most ``background_rows`` rows
        return _phi_in_rows(model, predict, x, key, np.array(z, dtype=float).reshape(-1, d), permutations, seed)
    n_bg = bg.count()
    x = x.withColumn("__p", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    x = x.withColumn("bg_no", _drawn(key, F.col("__p"), n_bg, seed))
    x = x.join(F.broadcast(bg), "bg_no")  # at most ``background_rows`` rows
    x = x.withColumn("__o", _order(key, F.col("__p"), d, seed)).withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(d))))
    mixed = x.select(*key, "__p", "__k", "__o", *[
        F.when(F.array_position("__o", F.lit(j)) <= F.col("__k"), F.get("__x", j)).otherwise(F.get("__z", j)).alias(c)
        for j, c in enumerate(model.inputs)])
    scored = model.score(mixed, [*key, "__p", "__k", "__o"])
    steps = scored.groupBy(*key, "__p", "output").agg(  # d + 1 entries per group
        F.array_sort(F.collect_list(F.struct("__k", "y_pred"))).alias("s"), F.first("__o").alias("__o"))
    gains = F.transform(F.sequence(F.lit(1), F.lit(d)), lambda k: F.struct(
        F.get("__o", k - 1).alias("j"), (F.get("s", k)["y_pred"] - F.get("s", k - 1)["y_pred"]).alias("gain")))
    long = steps.select(*key, "output", F.inline(gains))
    names = F.array(*[F.lit(c) for c in model.inputs])
    return long.groupBy(*key, "output", "j").agg(F.avg("gain").alias("phi")).select(*key, "output", F.get(names, F.col("j")).alias("feature"), "phi")


def _drawn(key: Sequence[str], p: Column, n_bg: int, seed: int) -> Column:
    """Number, from 1, of the background row that a row meets in permutation ``p``."""
    return (F.floor(uniform(seed + 3, *key, p) * n_bg) + 1).cast("bigint")


def _order(key: Sequence[str], p: Column, d: int, seed: int) -> Column:
    """The numbers of the features in the order in which permutation ``p`` of a row switches them."""
    order = F.array_sort(F.array(*[F.struct(seeded_hash(seed + 4, *key, p, F.lit(j)).alias("h"), F.lit(j).alias("j")) for j in range(d)]))
    return F.transform(order, lambda s: s["j"])


def _phi_in_rows(model: Model, predict: Callable[[np.ndarray], np.ndarray], x: DataFrame, key: list[str], z: np.ndarray, permutations: int, seed: int) -> DataFrame:
    """``shapley`` of the rows of ``x`` (key..., __x) by a numpy scorer, over the background ``z``. A batch is scored step by step, so
    that a task holds one step of its rows at a time."""
    d, n_out = len(model.inputs), len(model.outputs)
    types = {f.name: f.dataType.simpleString() for f in x.schema.fields}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in key), "__phi array<double>"])
    each = lambda f: F.transform(F.sequence(F.lit(0), F.lit(permutations - 1)), f)
    wanted = x.select(*key, "__x", each(lambda p: _drawn(key, p, len(z), seed)).alias("__b"), F.flatten(each(lambda p: _order(key, p, d, seed))).alias("__o"))
    if not len(z):  # no background, no attributions
        wanted = wanted.where(F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        absent = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if absent is None:
                absent = predict(z)
            here = matrix(batch.column("__x"))
            met = matrix(batch.column("__b")) - 1
            order = matrix(batch.column("__o")).reshape(len(here), permutations, d)
            whole, phi, row = predict(here), np.zeros((len(here), n_out, d)), np.arange(len(here))
            for p in range(permutations):
                mixed, before = z[met[:, p]], absent[met[:, p]]
                for k in range(d):
                    j = order[:, p, k]
                    mixed[row, j] = here[row, j]
                    after = predict(mixed) if k + 1 < d else whole
                    phi[row, :, j] += after - before
                    before = after
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), list_column(phi.reshape(len(here), -1) / permutations)], names=[*key, "__phi"])

    cols = [f"__phi{j}" for j in range(d)]
    wide = wanted.mapInArrow(run, schema).select(*key, F.inline(F.array(*[
        F.struct(F.lit(o).alias("output"), *[F.get("__phi", F.lit(k * d + j)).alias(c) for j, c in enumerate(cols)]) for k, o in enumerate(model.outputs)])))
    means = wide.groupBy(*key, "output").agg(*[F.avg(c).alias(c) for c in cols])
    return means.select(*key, "output", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(c).alias("phi")) for f, c in zip(model.inputs, cols)])))


def global_importance(phi: DataFrame, by: Sequence[str] = ("output",)) -> DataFrame:
    """mean |phi| per feature."""
    return phi.groupBy(*by, "feature").agg(F.avg(F.abs("phi")).alias("importance"))


def group_importance(phi: DataFrame, groups: DataFrame, key: Sequence[str], by: Sequence[str] = ("output",)) -> DataFrame:
    """Mean over rows of the summed |phi| of each feature group; ``groups`` is (feature, grp), one row per feature."""
    j = phi.join(F.broadcast(groups), "feature")
    return j.groupBy(*key, *by, "grp").agg(F.sum(F.abs("phi")).alias("s")).groupBy(*by, "grp").agg(F.avg("s").alias("importance"))
