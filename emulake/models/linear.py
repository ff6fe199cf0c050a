"""Least squares: one Gram pass to fit, plain column arithmetic to score."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulake.models.base import REGISTRY, Model
from emulake.models.sums import summed
from emulake.operators.scale import column_stats


class LinearModel(Model):
    """Multi-output ridge (``alpha``, default 0 is least squares) with an intercept."""

    key = "linear"
    aliases = ("ols", "ridge")

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> LinearModel:
        p = len(self.inputs)
        got = column_stats(train, [*self.inputs, *self.outputs], {"m": F.avg, "s": F.stddev_pop})
        mx = np.array([got[c]["m"] for c in self.inputs])
        sx = np.array([got[c]["s"] or 1.0 for c in self.inputs])
        my = np.array([got[c]["m"] for c in self.outputs])

        def block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = (x - mx) / sx
            return np.concatenate([(z.T @ z).ravel(), (z.T @ (y - my)).ravel()])

        flat = summed(train, {"x": self.inputs, "y": self.outputs}, block)
        if flat is None:
            raise ValueError("no training rows")
        gram = flat[: p * p].reshape(p, p) + float(self.params.get("alpha", 0.0)) * np.eye(p)
        w = np.linalg.lstsq(gram, flat[p * p:].reshape(p, -1), rcond=None)[0] / sx[:, None]
        self.weights, self.bias = w, my - mx @ w
        self.centre = mx
        return self

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        cells = []
        for k, o in enumerate(self.outputs):
            y = F.lit(float(self.bias[k]))
            for j, c in enumerate(self.inputs):
                y = y + F.col(c) * F.lit(float(self.weights[j, k]))
            cells.append(F.struct(F.lit(o).alias("output"), y.alias("y_pred")))
        return df.select(*keep, F.inline(F.array(*cells)))

    def predictor(self):
        w, b = self.weights, self.bias
        return lambda x: x @ w + b

    def in_rows(self, spark: SparkSession):
        return None  # ``score`` gives NULL for a NULL input, numpy NaN

    def shapley(self, df: DataFrame, keep: Sequence[str], means: dict[str, float] | None = None) -> DataFrame:
        """Exact attributions w_j (x_j - E x_j): (keep..., output, feature, phi)."""
        mu = means or dict(zip(self.inputs, map(float, self.centre)))
        cells = [
            F.struct(F.lit(o).alias("output"), F.lit(c).alias("feature"),
                     (F.lit(float(self.weights[j, k])) * (F.col(c) - F.lit(mu[c]))).alias("phi"))
            for k, o in enumerate(self.outputs) for j, c in enumerate(self.inputs)]
        return df.select(*keep, F.inline(F.array(*cells)))

    def size(self) -> dict[str, int]:
        return {"weights": int(self.weights.size + self.bias.size)}

    def state(self) -> dict[str, Any]:
        return {"weights": self.weights, "bias": self.bias, "centre": self.centre}

    def restore(self, state: dict[str, Any]) -> LinearModel:
        self.weights, self.bias, self.centre = (np.array(state[k]) for k in ("weights", "bias", "centre"))
        return self


REGISTRY.register(LinearModel)
