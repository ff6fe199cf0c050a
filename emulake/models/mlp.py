"""Multi-layer perceptron trained by local mini-batch Adam with weight averaging after every epoch.

Rows are dealt by hash to virtual shards of about ``SHARD_ROWS`` rows; how many there are follows from the number of rows, not from the
cluster. In an epoch every shard takes mini-batch steps from the current weights, in an order that its own seed shuffles, and the
row-weighted average of their weights starts the next epoch. A task may hold several shards and works on one after the other, so
the result is the same on any number of cores but for the rounding of the last sum. The same job scores the
validation rows with the incoming weights, so an epoch is one Spark job. Data stay in Spark throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulake.models.base import REGISTRY, Model, matrix, numpy_scores
from emulake.models.sums import merged
from emulake.operators.scale import column_stats
from emulake.operators.split import epoch_sample
from emulake.session import materialize

#: Rows of a virtual shard on average; a task holds one shard's rows at a time, and twice as many at most.
SHARD_ROWS = 50_000
ACTIVATIONS = ("relu", "tanh", "leaky_relu", "sigmoid")


def _act(name: str, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and derivative."""
    if name == "relu":
        return np.maximum(z, 0), (z > 0).astype(z.dtype)
    if name == "tanh":
        t = np.tanh(z)
        return t, 1 - t * t
    if name == "leaky_relu":
        return np.where(z > 0, z, 0.01 * z), np.where(z > 0, 1.0, 0.01)
    if name == "sigmoid":
        s = 1 / (1 + np.exp(-z))
        return s, s * (1 - s)
    raise ValueError(f"unknown activation {name!r}")


class Net:
    """Weights as one flat vector, so tasks exchange a single array."""

    def __init__(self, sizes: Sequence[int], activation: str, dropout: float = 0.0):
        self.sizes, self.activation, self.dropout = list(sizes), activation, dropout
        self.shapes = [(a, b) for a, b in zip(sizes[:-1], sizes[1:])]

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([np.concatenate([rng.uniform(-1, 1, a * b) * math.sqrt(6.0 / (a + b)), np.zeros(b)]) for a, b in self.shapes])

    def layers(self, w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in self.shapes:
            out.append((w[at:at + a * b].reshape(a, b), w[at + a * b:at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        layers = self.layers(w)
        for k, (m, b) in enumerate(layers):
            x = x @ m + b
            if k < len(layers) - 1:
                x = _act(self.activation, x)[0]
        return x

    def gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
        """Gradient of the mean squared error and the batch's squared error sum."""
        layers, acts, slopes = self.layers(w), [x], []
        for k, (m, b) in enumerate(layers):
            z = acts[-1] @ m + b
            if k < len(layers) - 1:
                a, d = _act(self.activation, z)
                if self.dropout > 0:
                    mask = (rng.random(a.shape) >= self.dropout) / (1 - self.dropout)
                    a, d = a * mask, d * mask
                acts.append(a)
                slopes.append(d)
            else:
                acts.append(z)
        e = acts[-1] - y
        delta, grads = 2 * e / e.size, []
        for k in range(len(layers) - 1, -1, -1):
            grads.append(np.concatenate([(acts[k].T @ delta).ravel(), delta.sum(axis=0)]))
            if k:
                delta = (delta @ layers[k][0].T) * slopes[k - 1]
        return np.concatenate(grads[::-1]), float(np.sum(e * e))


class MLP(Model):
    """hidden_layers, activation, learning_rate, n_epochs, batch_size, patience, dropout, seed, shards, shard_rows, key.

    ``shards`` fixes the number of virtual shards; by default it follows from the rows and ``shard_rows``. Rows equal in all inputs
    and outputs share a shard unless the ``key`` columns tell them apart.
    """

    key = "mlp"
    aliases = ("mlp_regressor", "neural")

    def _net(self) -> Net:
        p = self.params
        return Net([len(self.inputs), *[int(h) for h in p.get("hidden_layers", [64, 64])], len(self.outputs)],
                   p.get("activation", "relu"), float(p.get("dropout", 0.0)))

    def _pack(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        def z(cols, m, s):
            return F.array(*[(F.col(c).cast("double") - F.lit(float(a))) / F.lit(float(b)) for c, a, b in zip(cols, m, s)])

        # the hash is of the values as they came: the scalers' last digits depend on how the rows were summed
        h = F.xxhash64(F.lit(int(self.params.get("seed", 42))), *keep, *[F.col(c).cast("double") for c in (*self.inputs, *self.outputs)])
        return df.select(*keep, h.alias("h"), z(self.inputs, self.mx, self.sx).alias("x"), z(self.outputs, self.my, self.sy).alias("y"))

    def fit(self, train: DataFrame, val: DataFrame | None = None, start: MLP | None = None, lr_scale: float = 1.0) -> MLP:
        """Fit, or continue from ``start`` (its weights and scalers, learning rate times ``lr_scale``)."""
        p = self.params
        key = list(p.get("key", []))
        fraction = float(p.get("epoch_fraction", 1.0))
        if start is None:
            got = column_stats(train, [*self.inputs, *self.outputs], {"m": F.avg, "s": F.stddev_pop})
            self.mx, self.my = (np.array([got[c]["m"] for c in cs]) for cs in (self.inputs, self.outputs))
            self.sx, self.sy = (np.array([got[c]["s"] or 1.0 for c in cs]) for cs in (self.inputs, self.outputs))
        else:
            self.mx, self.my, self.sx, self.sy = start.mx, start.my, start.sx, start.sy
        net = self._net()
        seed, lr = int(p.get("seed", 42)), float(p.get("learning_rate", 1e-3)) * lr_scale
        epochs, patience = int(p.get("n_epochs", 200)), p.get("patience")
        batch, shard_rows = int(p.get("batch_size", 256)), int(p.get("shard_rows", SHARD_ROWS))
        w = start.weights.copy() if start is not None else net.start(seed)
        packed = self._pack(train, key).withColumn("is_val", F.lit(False))
        if val is not None:
            packed = packed.unionByName(self._pack(val, key).withColumn("is_val", F.lit(True)))
        shards = int(p.get("shards", 0)) or max(1, math.ceil(packed.count() / shard_rows))
        dealt = packed.withColumn("shard", F.pmod("h", F.lit(shards)))
        data = materialize(dealt.repartition(shards, "shard").sortWithinPartitions("shard", "h", *key, "x", "y"), "mlp-train")
        first, second = np.zeros_like(w), np.zeros_like(w)
        steps, best, best_w, bad = 0, math.inf, w, 0
        self.history = []
        for epoch in range(1, epochs + 2):
            rows = data
            if fraction < 1.0 and epoch <= epochs:
                if not key:
                    raise ValueError("epoch_fraction needs the key columns in params['key']")
                chosen = epoch_sample(data.where("NOT is_val"), key, fraction, epoch, seed)
                rows = chosen.unionByName(data.where("is_val"))
            got = _epoch(rows, net, w, first, second, steps, lr, batch, seed + epoch, epoch <= epochs, 2 * shard_rows)
            if epoch > 1 and self.history:  # the incoming weights are those the last epoch produced
                last = self.history[-1]
                last["val_loss"] = got["val_loss"]
                last["val_rmse_scaled"] = None if got["val_loss"] is None else math.sqrt(got["val_loss"])
                if got["val_loss"] is not None:
                    if got["val_loss"] < best:
                        best, best_w, bad = got["val_loss"], w, 0
                    else:
                        bad += 1
                    if patience and bad >= int(patience):
                        break
            if epoch > epochs:
                break
            w, first, second, steps = got["w"], got["m"], got["v"], got["steps"]
            self.history.append({"epoch": epoch, "train_loss": got["train_loss"], "train_rmse_scaled": math.sqrt(got["train_loss"]),
                                 "train_rows_this_epoch": got["rows"], "val_loss": None, "val_rmse_scaled": None})
        self.weights = best_w if val is not None and math.isfinite(best) else w
        return self

    def predictor(self):
        net, w, mx, sx, my, sy = self._net(), self.weights, self.mx, self.sx, self.my, self.sy
        return lambda x: net.forward(w, (x - mx) / sx) * sy + my

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        return numpy_scores(df, self.inputs, self.outputs, keep, self.predictor())

    def size(self) -> dict[str, int]:
        return {"weights": int(self.weights.size)}

    def state(self) -> dict[str, Any]:
        return {"weights": self.weights, "mx": self.mx, "sx": self.sx, "my": self.my, "sy": self.sy}

    def restore(self, state: dict[str, Any]) -> MLP:
        self.weights, self.mx, self.sx, self.my, self.sy = (np.array(state[k]) for k in ("weights", "mx", "sx", "my", "sy"))
        return self


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, is_val, x, y) of runs of rows of one shard, in pieces of ``most`` rows, whatever the batches' bounds."""
    shard, held, size = None, [], 0

    def out() -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        return (shard, *(np.concatenate(part) for part in zip(*held)))

    for got in batches:
        if not got.num_rows:
            continue
        own, flags = got.column("shard").to_numpy(), got.column("is_val").to_numpy(zero_copy_only=False).astype(bool)
        x, y = matrix(got.column("x")), matrix(got.column("y"))
        edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        for a, b in zip(edges, edges[1:]):
            if held and own[a] != shard:
                yield out()
                held, size = [], 0
            shard = int(own[a])
            while a < b:
                c = min(b, a + most - size)
                held.append((flags[a:c], x[a:c], y[a:c]))
                size, a = size + c - a, c
                if size == most:
                    yield out()
                    held, size = [], 0
    if held:
        yield out()


def _epoch(data: DataFrame, net: Net, w: np.ndarray, m: np.ndarray, v: np.ndarray, steps: int, lr: float, batch: int, seed: int, train: bool, most: int = 2 * SHARD_ROWS) -> dict:
    """One pass: every shard steps through its training rows and sums the validation error of the incoming weights."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sse, vrows, vsse, top, state = 0, 0.0, 0, 0.0, steps, np.zeros(3 * len(w))
        for shard, flags, all_x, all_y in _shards(batches, most):
            if flags.any():
                x, y = all_x[flags], all_y[flags]
                vsse += float(np.mean((net.forward(w, x) - y) ** 2) * len(x))
                vrows += len(x)
            if not train or flags.all():
                continue
            rng = np.random.default_rng([seed, shard])  # shards shuffle and drop out differently
            a, m1, m2, t = w.copy(), m.copy(), v.copy(), steps
            x, y = all_x[~flags], all_y[~flags]
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                pick = order[at:at + batch]
                g, e = net.gradient(a, x[pick], y[pick], rng)
                t += 1
                m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
                a = a - lr * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
                sse += e / y.shape[1]
            rows, top = rows + len(x), max(top, t)
            state += np.concatenate([a, m1, m2]) * len(x)
        if rows or vrows:
            yield pa.RecordBatch.from_pydict({"rows": [rows], "sse": [sse], "vrows": [vrows], "vsse": [vsse], "steps": [top], "state": [state.tobytes()]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, state = None, 0.0
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                state = state + np.frombuffer(r.state)
                here = np.array([r.rows, r.sse, r.vrows, r.vsse])
                total, top = (here, r.steps) if total is None else (total + here, max(top, r.steps))
        if total is not None:
            yield pd.DataFrame({"rows": [int(total[0])], "sse": [total[1]], "vrows": [int(total[2])], "vsse": [total[3]], "steps": [top], "state": [state.tobytes()]})

    schema = "rows bigint, sse double, vrows bigint, vsse double, steps bigint, state binary"
    states = merged(data.select("shard", "is_val", "x", "y").mapInArrow(task, schema), merge)
    got = sorted(states.collect(), key=lambda r: (r.rows, r.sse))
    n = sum(r.rows for r in got)
    nv = sum(r.vrows for r in got)
    out = {"rows": n, "val_loss": sum(r.vsse for r in got) / nv if nv else None}
    if train:
        if not n:
            raise ValueError("no training rows")
        mixed = sum(np.frombuffer(r.state) for r in got) / n
        out["w"], out["m"], out["v"] = np.split(mixed, 3)
        out["steps"] = max(r.steps for r in got)
        out["train_loss"] = sum(r.sse for r in got) / n
    return out


REGISTRY.register(MLP)
