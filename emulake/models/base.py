"""Common model interface and the registry through which models are found, added and created.

A model is fitted on a DataFrame and scores a DataFrame. ``score`` returns long predictions
``(keep..., output, y_pred)``; ``score_std`` adds ``std`` where the model knows its uncertainty.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Model:
    """Base class; subclasses set ``key`` and implement ``fit``, ``score``, ``state`` and ``restore``."""

    key = "base"
    aliases: tuple[str, ...] = ()
    has_std = False

    def __init__(self, inputs: Sequence[str], outputs: Sequence[str], **params: Any):
        self.inputs, self.outputs, self.params = list(inputs), list(outputs), params
        self.history: list[dict] = []

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> Model:
        raise NotImplementedError

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        raise NotImplementedError

    def score_std(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        raise NotImplementedError(f"{self.key} has no uncertainty")

    def predictor(self) -> Callable[[np.ndarray], np.ndarray] | None:
        """The scorer as a numpy function (rows, inputs) -> (rows, outputs), where there is one."""
        return None

    def in_rows(self, spark: SparkSession) -> Callable[[np.ndarray], np.ndarray] | None:
        """A numpy function, as ``predictor`` gives it, whose predictions are those of ``score`` for any row; None where there is none."""
        return self.predictor()

    def size(self) -> dict[str, int]:
        """Counts that describe the model: weights, nodes, ..."""
        return {}

    def state(self) -> dict[str, Any]:
        """Arrays and numbers that restore the model."""
        raise NotImplementedError

    def restore(self, state: dict[str, Any]) -> Model:
        raise NotImplementedError

    def save(self, spark: SparkSession, path: str) -> None:
        """One-row JSON table: key, roles, parameters and state."""
        def plain(v):
            return v.tolist() if isinstance(v, np.ndarray) else [plain(x) for x in v] if isinstance(v, list) else v

        doc = {"key": self.key, "inputs": self.inputs, "outputs": self.outputs, "params": self.params,
               "state": {k: plain(v) for k, v in self.state().items()}}
        spark.createDataFrame([(json.dumps(doc),)], "doc string").coalesce(1).write.mode("overwrite").text(path)


def matrix(column: pa.Array) -> np.ndarray:
    """Equal-length number lists as a 2-D array, without a Python object per row."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def list_column(values: np.ndarray) -> pa.Array:
    """Rows of a 2-D array as number lists."""
    flat = np.ascontiguousarray(values, dtype=np.float64)
    offsets = np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))


def numpy_scores(
    df: DataFrame, inputs: Sequence[str], outputs: Sequence[str], keep: Sequence[str],
    predict: Callable[[np.ndarray], np.ndarray], std: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Score Arrow batches on the executors and return long rows. Only inputs and ``keep`` are sent."""
    inputs, outputs, keep = list(inputs), list(outputs), list(keep)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), "__y array<double>", *(["__s array<double>"] if std else [])])
    wanted = df.select(*keep, F.array(*[F.col(c).cast("double") for c in inputs]).alias("__x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("__x"))
            cols = [batch.column(k) for k in keep] + [list_column(predict(x))]
            if std:
                cols.append(list_column(std(x)))
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "__y", *(["__s"] if std else [])])

    names = F.array(*[F.lit(o) for o in outputs])
    scored = wanted.mapInArrow(run, schema)
    if std:
        z = scored.select(*keep, F.inline(F.arrays_zip(names.alias("output"), F.col("__y").alias("y_pred"), F.col("__s").alias("std"))))
    else:
        z = scored.select(*keep, F.inline(F.arrays_zip(names.alias("output"), F.col("__y").alias("y_pred"))))
    return z


class Registry:
    """Models by key and alias."""

    def __init__(self) -> None:
        self._models: dict[str, type[Model]] = {}
        self._aliases: dict[str, str] = {}

    def register(self, model: type[Model], key: str | None = None, aliases: Sequence[str] | None = None) -> type[Model]:
        name = key or model.key
        self._models[name] = model
        for a in model.aliases if aliases is None else aliases:
            self._aliases[a] = name
        return model

    def get(self, name: str) -> type[Model]:
        found = self._models.get(self._aliases.get(name, name))
        if found is None:
            raise KeyError(f"model {name!r} is not registered")
        return found

    def create(self, name: str, inputs: Sequence[str], outputs: Sequence[str], **params: Any) -> Model:
        return self.get(name)(inputs, outputs, **params)

    def keys(self) -> list[str]:
        return sorted({*self._models, *self._aliases})

    def __contains__(self, name: str) -> bool:
        return name in self._models or name in self._aliases

    def summary(self) -> dict[str, str]:
        return {k: m.__name__ for k, m in sorted(self._models.items())}

    def load(self, spark: SparkSession, path: str) -> Model:
        """Restore a saved model by the key it was saved under."""
        doc = json.loads(spark.read.text(path).first()[0])
        return self.create(doc["key"], doc["inputs"], doc["outputs"], **doc["params"]).restore({**doc["state"], "__path": path})


REGISTRY = Registry()


class FunctionModel(Model):
    """User-supplied numpy scorers: ``predict(X)`` and, for uncertainty, ``std(X)``."""

    key = "function"

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> Model:
        return self

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        return numpy_scores(df, self.inputs, self.outputs, keep, self.params["predict"])

    def score_std(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        return numpy_scores(df, self.inputs, self.outputs, keep, self.params["predict"], self.params["std"])


REGISTRY.register(FunctionModel)
