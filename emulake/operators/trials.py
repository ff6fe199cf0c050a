"""Tuning trials and training epochs as ordered tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emulake.operators.ordered import order_bucket, running
from emulake.operators.rank import rank_in_cells
from emulake.session import bounded, join_on, materialize


def best_so_far(trials: DataFrame, by: Sequence[str] = ("study",), order: str = "number", value: str = "value",
                direction: str = "minimize") -> DataFrame:
    """Add ``best_value`` up to each trial and ``is_best_yet`` (strictly better than all before)."""
    how = "min" if direction == "minimize" else "max"
    out = running(trials, order, by, {"best_value": (how, value, True), "__prev": (how, value, False)})
    better = F.col(value) < F.col("__prev") if how == "min" else F.col(value) > F.col("__prev")
    return out.withColumn("is_best_yet", F.col("__prev").isNull() | better).drop("__prev")


def patience(epochs: DataFrame, by: Sequence[str] = ("trial",), epoch: str = "epoch", loss: str = "val_loss") -> DataFrame:
    """Add ``bad_epochs``: epochs since the loss last fell strictly below every earlier one."""
    cell = order_bucket(epochs, F.col(epoch))
    prev = running(epochs, epoch, by, {"__pos": ("count", epoch, True), "__prev": ("min", loss, False)}, cell=cell)
    better = F.coalesce(F.col("__prev").isNull() | (F.col(loss) < F.col("__prev")), F.lit(False))
    marked = materialize(prev.withColumn("__hit", F.when(better, F.col("__pos"))).drop("__prev"), "patience")  # read twice below
    last = running(marked, epoch, by, {"__last": ("max", "__hit", True)}, cell=cell)
    return last.withColumn("bad_epochs", F.col("__pos") - F.coalesce(F.col("__last"), F.lit(0))).drop("__pos", "__hit", "__last")


def stop_epochs(watched: DataFrame, limit: int, by: Sequence[str] = ("trial",), epoch: str = "epoch") -> DataFrame:
    """First epoch whose patience ran out; NULL where training would have gone on."""
    return watched.groupBy(*by).agg(F.min(F.when(F.col("bad_epochs") >= limit, F.col(epoch))).alias("stop_epoch"))


def best_epoch(epochs: DataFrame, by: Sequence[str] = ("trial",), epoch: str = "epoch", loss: str = "val_loss") -> DataFrame:
    """First epoch with the lowest loss."""
    return epochs.where(F.col(loss).isNotNull()).groupBy(*by).agg(
        F.min_by(epoch, F.struct(loss, epoch)).alias("best_epoch"), F.min(loss).alias("best_loss"), F.count(F.lit(1)).alias("n_epochs"))


def convergence(trials: DataFrame, by: Sequence[str] = ("method",), number: str = "number", value: str = "value",
                direction: str = "minimize") -> DataFrame:
    """Best value, its first trial number and the number of trials per method."""
    signed: Column = F.col(value) if direction == "minimize" else -F.col(value)
    first = F.min_by(number, F.struct(signed, F.col(number)))
    best = F.min(value) if direction == "minimize" else F.max(value)
    return trials.where(F.col(value).isNotNull()).groupBy(*by).agg(
        best.alias("best_value"), first.alias("best_number"), F.count(F.lit(1)).alias("n_trials"))


def top_trials(trials: DataFrame, n: int = 5, direction: str = "minimize", value: str = "value", number: str = "number",
               always_ascending: bool = False) -> DataFrame:
    """The n best trials. ``always_ascending`` lists the lowest values whatever the direction."""
    low_first = direction == "minimize" or always_ascending
    key = F.col(value).asc() if low_first else F.col(value).desc()
    return trials.where(F.col(value).isNotNull()).orderBy(key, number).limit(n)


def promoted(trials: DataFrame, eta: int = 3, by: Sequence[str] = ("study", "rung"), value: str = "value", number: str = "number",
             direction: str = "minimize") -> DataFrame:
    """Add ``place`` among the trials of a rung, best first, and ``goes_on``: whether it is among the best 1 / ``eta``, at least one.

    Only trials with a value have a place and count; equal values are ordered by trial number. Places are counted in cells of the
    value, so a study with most of the trials is spread over tasks.
    """
    if eta < 2:
        raise ValueError("eta must be 2 or more")
    signed = F.col(value) if direction == "minimize" else -F.col(value)
    known = trials.withColumn("__v", signed)
    full = known.where("__v IS NOT NULL")
    ranked = rank_in_cells(full, order_bucket(full, F.col("__v")), by, ["__v", number], "place")
    sizes = ranked.groupBy(*by).agg(F.max("place").alias("__n"))
    placed = join_on(ranked, bounded(sizes), list(by), "inner")
    placed = placed.withColumn("goes_on", F.col("place") <= F.greatest(F.floor(F.col("__n") / eta), F.lit(1)))
    return placed.select(*trials.columns, "place", "goes_on").unionByName(
        known.where("__v IS NULL").select(*trials.columns, F.lit(None).cast("bigint").alias("place"), F.lit(False).alias("goes_on")))


def top_features(importance: DataFrame, n: int = 3) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), "feature").limit(n)


def last_lines(lines: DataFrame, n: int, file: str = "file", order: str = "line_no") -> DataFrame:
    """Last n lines of every file. Spark applies the limit before the shuffle, so a huge file sends few rows."""
    w = Window.partitionBy(file).orderBy(F.col(order).desc())
    return lines.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")
