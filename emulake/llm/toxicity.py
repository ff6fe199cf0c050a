"""Toxicity scores: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of its lower-cased words (with word ends marked), hashed into a fixed number of
buckets. Smoothed counts in toxic and other training texts give each bucket a log ratio r; a logistic regression with
features r or 0 is trained on top; Spark sums its gradients over the partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulake.llm.common import fold, forget_values, scan_tasks, slices, store, summed, texts_of, typed

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 18
#: Labelled training rows that the classifier is fitted on at most: those with the smallest hash of their key.
TRAIN_ROWS = 40_000
STEPS = 20  # evaluations of the loss, each a pass over the training rows
SMOOTH = 1.0
MIN_TEXTS = 3  # training texts that a bucket needs
MIN_RATIO = 0.5  # of a log ratio; buckets nearer to 0 say little and take no part
PENALTY = 1.0
_MIX = np.uint32(0x9E3779B1)


def ngrams_of(text: str) -> np.ndarray:
    """Sorted distinct buckets of a whole text's n-grams; n-grams don't reach over white space."""
    words = set(text.lower().split())
    if not words:
        return np.zeros(0, dtype=np.uint32)
    marked = " " + "  ".join(words) + " "  # a space on both sides of each word
    c = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    gap = np.concatenate([[0], np.cumsum((c[1:] == 32) & (c[:-1] == 32))])  # number of the word each character is in
    out, h = [], c.copy()
    with np.errstate(over="ignore"):
        for n in range(2, max(SIZES) + 1):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * _MIX + c[n - 1 :]
            h = h ^ (h >> np.uint32(15))
            if n in SIZES:
                out.append((h[gap[: len(h)] == gap[n - 1 :]] * _MIX) >> np.uint32(14))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.uint32)


@dataclass
class ToxicModel:
    weights: np.ndarray  # weight times ratio of each bucket
    bias: float

    def score(self, buckets: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[buckets].sum() + self.bias, -40, 40))))


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], point: np.ndarray, evaluations: int, memory: int = 6) -> np.ndarray:
    """Limited-memory quasi-Newton descent with step halving; stops early at a small gradient."""
    value, grad = loss(point)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    step = 1.0
    for _ in range(evaluations - 1):
        if np.abs(grad).max() < 1e-6:
            break
        way, kept = grad.copy(), []
        for s, y in reversed(pairs):
            kept.append(s @ way / (s @ y))
            way -= kept[-1] * y
        way *= pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1.0
        for (s, y), k in zip(pairs, reversed(kept)):
            way += (k - y @ way / (s @ y)) * s
        new_value, new_grad = loss(point - step * way)
        if new_value > value - 1e-4 * step * (grad @ way):
            step /= 4
            continue
        s, y = -step * way, new_grad - grad
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        point, value, grad, step = point + s, new_value, new_grad, 1.0
    return point


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", held_out: int = 5, rows: int = TRAIN_ROWS,
) -> ToxicModel | None:
    """Fit on at most ``rows`` labelled rows whose key's crc32 is not 0 modulo ``held_out``; None if there are none.

    A key with several labels counts with the greatest; a label over 0 is toxic; NULL labels and NULL keys don't count; a key that several rows
    of ``docs`` have trains with each of them. The chosen keys are bounded by ``rows`` and therefore broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).where(fold(key, held_out) != 0).groupBy(key).agg((F.max(label) > 0).cast("double").alias("__y"))
    chosen = store(known.orderBy(F.xxhash64(key), key).limit(rows), "chosen")
    picked = docs.select(key, F.col(text).alias("text")).join(F.broadcast(chosen), key).select("text", F.col("__y").alias("y"))

    tasks = scan_tasks(picked)

    def counts(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        forget_values()
        total = None
        for batch in slices(batches):
            total = np.zeros((2, BUCKETS + 1)) if total is None else total
            for y, t in zip(batch.column("y").to_pylist(), texts_of(batch)):
                total[1 if y > 0 else 0, ngrams_of(t)] += 1  # the buckets of a text are distinct
                total[1 if y > 0 else 0, -1] += 1
        return None if total is None else total.ravel()

    found = summed(picked, counts, tasks)
    if found is None:
        return None
    found = found.reshape(2, BUCKETS + 1)
    good, bad, n_good, n_bad = found[0, :-1], found[1, :-1], found[0, -1], found[1, -1]
    n = n_good + n_bad
    ratio = np.log((bad + SMOOTH) / (n_bad + 2 * SMOOTH)) - np.log((good + SMOOTH) / (n_good + 2 * SMOOTH))
    prior = float(np.log((n_bad + SMOOTH) / (n_good + SMOOTH)))
    ratio[(good + bad < MIN_TEXTS) | (np.abs(ratio) < MIN_RATIO)] = 0.0
    useful = ratio != 0
    number = np.cumsum(useful, dtype=np.int32) - np.int32(1)  # of each useful bucket; training works on these alone
    ratio, size = ratio[useful], int(useful.sum())

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_values()
        for batch in slices(batches):
            lists = [number[g[useful[g]]].astype(np.int32) for g in map(ngrams_of, texts_of(batch))]
            offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))], names=["y", "grams"])

    train = store(picked.mapInArrow(extract, "y double, grams array<int>"), "grams")
    tasks = scan_tasks(train)

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Labels, all buckets, and the row each bucket belongs to."""
        grams = batch.column("grams")
        flat = grams.flatten().to_numpy(zero_copy_only=False)
        return batch.column("y").to_numpy(zero_copy_only=False), flat, np.repeat(np.arange(len(grams)), grams.value_lengths().to_numpy(zero_copy_only=False))

    def loss(point: np.ndarray) -> tuple[float, np.ndarray]:
        """Penalised loss and gradient at (w, bias), both divided by the number of rows."""
        scaled, bias = point[:-1] * ratio, point[-1]

        def block(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
            total = None
            for batch in slices(batches, 1000):
                y, flat, row = arrays(batch)
                margin = np.bincount(row, weights=scaled[flat], minlength=len(y)) + bias
                error = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y
                total = np.zeros(size + 2) if total is None else total
                total[:size] += np.bincount(flat, weights=error[row], minlength=size)
                total[-2:] += error.sum(), np.logaddexp(0, np.where(y > 0, -margin, margin)).sum()
            return total

        g = summed(train, block, tasks)
        w = point[:-1]
        return (g[-1] + PENALTY / 2 * w @ w) / n, np.append(g[:size] * ratio + PENALTY * w, g[-2]) / n

    point = minimise(loss, np.append(np.zeros(size), prior), STEPS)
    weights = np.zeros(BUCKETS)
    weights[useful] = point[:-1] * ratio
    return ToxicModel(weights, float(point[-1]))


def toxicity_scores(docs: DataFrame, model: ToxicModel | None, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(key, score, predicted) of every row; NULL text is empty, and without a model every score is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_values()
        for batch in slices(batches):
            score = np.array([model.score(ngrams_of(t)) for t in texts_of(batch)]) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[key, "score", "predicted"])

    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, f"{typed(docs, key)}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicModel | None, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_values()
        for batch in slices(batches):
            if model:
                batch = batch.filter(pa.array([model.score(ngrams_of(t)) < threshold for t in texts_of(batch, text)], pa.bool_()))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity_scores(docs, fit_toxicity(docs, labels)).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
