"""Seeded ensembles of any registered model: mean prediction, deviation between members as uncertainty."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulake.models.base import REGISTRY, Model, numpy_scores
from emulake.operators import metrics

FIRST_SEED = 42  # fixed value: member i is seeded with 42 + i


class Ensemble(Model):
    """``base`` (registered key), ``n_members``, ``base_params``, and ``key`` for bases without a numpy scorer.

    Members with numpy scorers are averaged inside one scoring pass. Others (forests) are scored one by one and
    averaged per row, for which ``keep`` must contain the ``key`` columns.
    """

    key = "ensemble"
    has_std = True

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> Ensemble:
        base, given = REGISTRY.get(self.params["base"]), self.params.get("base_params", {})
        self.members = [
            base(self.inputs, self.outputs, **{**given, "seed": FIRST_SEED + i}).fit(train, val)
            for i in range(int(self.params.get("n_members", 5)))]
        return self

    def member_scores(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """(keep..., output, y_pred, member)."""
        out = None
        for i, m in enumerate(self.members):
            one = m.score(df, keep).withColumn("member", F.lit(i))
            out = one if out is None else out.unionByName(one)
        return out

    def score_std(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        scorers = [m.predictor() for m in self.members]
        if all(s is not None for s in scorers):
            return numpy_scores(df, self.inputs, self.outputs, keep, lambda x: np.mean([s(x) for s in scorers], axis=0),
                                lambda x: np.std([s(x) for s in scorers], axis=0))
        key = self.params.get("key", [])
        if not key or not set(key) <= set(keep):
            raise ValueError("this ensemble needs params['key'], and the key columns in keep, to tell rows apart")
        e = metrics.ensemble(self.member_scores(df, keep), [*keep, "output"])
        return e.select(*keep, "output", F.col("mean").alias("y_pred"), "std")

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        return self.score_std(df, keep).drop("std")

    def size(self) -> dict[str, int]:
        total: dict[str, int] = {"members": len(self.members)}
        for m in self.members:
            for k, v in m.size().items():
                total[k] = total.get(k, 0) + v
        return total

    def state(self) -> dict[str, Any]:
        return {"n": len(self.members)}

    def save(self, spark: SparkSession, path: str) -> None:
        super().save(spark, path)
        for i, m in enumerate(self.members):
            m.save(spark, f"{path}-member{i}")

    def restore(self, state: dict[str, Any]) -> Ensemble:
        spark = SparkSession.getActiveSession()
        self.members = [REGISTRY.load(spark, f"{state['__path']}-member{i}") for i in range(int(state["n"]))]
        return self


REGISTRY.register(Ensemble)
