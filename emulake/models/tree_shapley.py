"""Exact Shapley attributions of tree ensembles, leaf by leaf, from a table of nodes.

A leaf is a box: for each feature an interval, and the share of the rows that stay in it where the feature is unknown. A coalition
that knows some features sees the leaf's value times, for each known feature, whether the row is inside, and for each unknown one, the
share. The Shapley value of such a product is an integral over the chance t that a feature is known,

    phi_f = value * (inside_f - share_f) * integral over t in [0, 1] of the product over g != f of (share_g * (1 - t) + inside_g * t)

of a polynomial, which Gauss-Legendre nodes give exactly. The shares are those of the training rows that the tree keeps at its nodes, or,
with a background, whether a background row is inside, averaged over these rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulake.models.base import list_column, matrix
from emulake.session import materialize

#: Leaves that go to the tasks at a time; larger ensembles take several scans of the rows.
LEAVES = 50_000
#: Pairs of a row and a leaf worked on at a time.
CELLS = 1_000_000
NODES = "tree int, id int, left int, right int, feature int, threshold double, value double, cover double"
LEAF = "tree int, leaf int, value double, low array<double>, high array<double>, share array<double>"


def leaf_boxes(nodes: DataFrame, n_inputs: int) -> DataFrame:
    """One row per leaf (schema LEAF) of ``nodes`` (schema NODES; left < 0 at a leaf, the root is node 0, rows at or below the threshold go left).

    Each tree is walked in a task of its own, all nodes of a depth together; a tree is as large as the model made it, whatever the data.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.sort_values("id")
        if not np.array_equal(t["id"].to_numpy(), np.arange(len(t))):
            raise ValueError("the nodes of a tree must be numbered from 0 without gaps")
        left, right, feature = (t[c].to_numpy() for c in ("left", "right", "feature"))
        threshold, value, cover = (t[c].to_numpy(dtype=float) for c in ("threshold", "value", "cover"))
        at = np.zeros(1, dtype=int)
        low, high, share = np.full((1, n_inputs), -np.inf), np.full((1, n_inputs), np.inf), np.ones((1, n_inputs))
        done = []
        while len(at):
            leaf = left[at] < 0
            done.append((at[leaf], low[leaf], high[leaf], share[leaf]))
            at, low, high, share = at[~leaf], low[~leaf], high[~leaf], share[~leaf]
            f, cut, i = feature[at], threshold[at], np.arange(len(at))
            sides = []
            for child, bound in ((left[at], high), (right[at], low)):
                b, s = bound.copy(), share.copy()
                b[i, f] = np.minimum(b[i, f], cut) if bound is high else np.maximum(b[i, f], cut)
                s[i, f] *= cover[child] / np.maximum(cover[at], 1e-300)
                sides.append((child, low if bound is high else b, b if bound is high else high, s))
            at, low, high, share = (np.concatenate(x) for x in zip(*sides))
        at, low, high, share = (np.concatenate(x) for x in zip(*done))
        return pd.DataFrame({"tree": int(t["tree"].iloc[0]), "leaf": np.arange(len(at)), "value": value[at], "low": list(low), "high": list(high), "share": list(share)})

    return nodes.groupBy("tree").applyInPandas(walk, LEAF)


def _inside(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(features, rows, leaves): whether the row is in the leaf's interval; a missing number is larger than all."""
    z = np.where(np.isnan(x), np.inf, x).T[:, :, None]
    return (z > low.T[:, None, :]) & (z <= high.T[:, None, :])


def attributions(x: np.ndarray, value: np.ndarray, low: np.ndarray, high: np.ndarray, share: np.ndarray) -> np.ndarray:
    """(rows, features) of the summed attributions over leaves."""
    used = np.flatnonzero((np.isfinite(low) | np.isfinite(high)).any(axis=0))
    phi = np.zeros(x.shape)
    if not len(used):
        return phi
    most = int((np.isfinite(low) | np.isfinite(high)).sum(axis=1).max())
    nodes, weights = np.polynomial.legendre.leggauss(math.ceil(most / 2))
    step = max(1, CELLS // max(1, len(value)))
    for at in range(0, len(x), step):
        part = slice(at, at + step)
        inside = _inside(x[part][:, used], low[:, used], high[:, used])
        gain = [np.where(o, 1.0 - r, -r) for o, r in zip(inside, share[:, used].T)]
        for node, weight in zip((nodes + 1) / 2, weights / 2):
            factor = [r * (1 - node) + o * node for o, r in zip(inside, share[:, used].T)]
            after = [np.ones(1)]
            for f in reversed(factor[1:]):
                after.append(after[-1] * f)
            before = np.full((1, 1), weight)
            for k, j in enumerate(used):  # products of the factors before and after, so that none is divided by
                phi[part, j] += (gain[k] * before * after[-1 - k]) @ value
                before = before * factor[k]
    return phi


def tree_attributions(
    nodes: DataFrame, df: DataFrame, key: Sequence[str], inputs: Sequence[str], output: str, background: np.ndarray | None = None, leaves: int = LEAVES,
) -> DataFrame:
    """(key..., output, feature, phi) for every row of ``df``; the ensemble's prediction is the mean over the trees of ``nodes``.

    A row's values sum to its prediction less the mean prediction: over the training rows as counted at the nodes, or over the rows of
    ``background`` (rows by inputs; the cost grows with their number). At most ``leaves`` leaves are sent to the tasks at a time.
    """
    key, inputs, spark = list(key), list(inputs), df.sparkSession
    boxes = materialize(leaf_boxes(nodes, len(inputs)), "leaf-boxes")
    sizes = {r["tree"]: r["count"] for r in boxes.groupBy("tree").count().collect()}  # one row for each tree
    trees = len(sizes)
    blocks, room = [], 0
    for tree, n in sorted(sizes.items()):  # whole trees as long as they fit, each larger one in ranges of its leaves
        if n > leaves:
            blocks += [[F.expr(f"tree = {tree} AND leaf BETWEEN {at} AND {at + leaves - 1}")] for at in range(0, n, leaves)]
            room = 0
            continue
        if n > room:
            blocks.append([])
            room = leaves
        blocks[-1].append(F.col("tree") == tree)
        room -= n
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in key), "__phi array<double>"])
    wanted = df.select(*key, F.array(*[F.col(c).cast("double") for c in inputs]).alias("__x"))
    total = None
    for block in blocks:
        some = boxes.where(reduce(lambda p, q: p | q, block))
        got = some.toArrow()
        sent = spark.sparkContext.broadcast((got.column("value").to_numpy() / trees, *(matrix(got.column(c).combine_chunks()) for c in ("low", "high", "share"))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            value, low, high, share = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch.column("__x"))
                if background is None:
                    phi = attributions(x, value, low, high, share)
                else:
                    seen = _inside(background, low, high).astype(float)
                    phi = sum(attributions(x, value, low, high, seen[:, b].T) for b in range(len(background))) / len(background)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), list_column(phi)], names=[*key, "__phi"])

        scored = wanted.mapInArrow(run, schema)
        total = scored if total is None else total.unionByName(scored)
    names = F.array(*[F.lit(c) for c in inputs])
    long = total.select(*key, F.lit(output).alias("output"), F.inline(F.arrays_zip(names.alias("feature"), F.col("__phi").alias("phi"))))
    if len(blocks) > 1:
        long = long.groupBy(*key, "output", "feature").agg(F.sum("phi").alias("phi"))
    return long


def base_value(nodes: DataFrame, n_inputs: int) -> float:
    """Mean prediction over the training rows as the nodes count them: what a row's attributions are measured from."""
    boxes = leaf_boxes(nodes, n_inputs)
    share = F.aggregate("share", F.lit(1.0), lambda a, s: a * s)
    return boxes.groupBy("tree").agg(F.sum(F.col("value") * share).alias("v")).agg(F.avg("v")).first()[0]
