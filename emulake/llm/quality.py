"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Every text is reduced to the same short list of statistics. Features cos(w x + c) with Gaussian w stand for a Gaussian
kernel on the standardised statistics. Normal equations are summed per partition, in two halves of the training rows,
so that each half is scored by the weights of the other one; isotonic regression of the labels on those scores
(counted in fine bins) makes the final score a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulake.llm.common import fold, forget_values, scan_tasks, slices, store, summed, texts_of, typed
from emulake.models.base import list_column, matrix

FEATURES = 384
WIDTH = 3.0  # of the kernel, in standard deviations
RIDGE = 1e-4  # times the number of training rows
BINS = 2000
LOW, HIGH = -1.0, 2.0  # range of the ridge scores that the bins cover; scores beyond fall into the end bins
SEED = 6

_B = np.arange(256)
#: Classes of UTF-8 bytes whose shares are statistics.
CLASSES = np.stack([
    (_B >= 97) & (_B <= 122), (_B >= 65) & (_B <= 90), (_B >= 48) & (_B <= 57), (_B == 32) | ((_B >= 9) & (_B <= 13)), _B >= 128,
    np.isin(_B, list(b".,;:'\"()-?")), _B == ord("!"), np.isin(_B, list(b"#$%&*+/<=>@\\^_`{|}~[]")), _B == 10,
]).astype(np.float64)
STATISTICS = 2 + len(CLASSES) + 9


def statistics_of(text: str) -> np.ndarray:
    """The statistics of a whole text; all are 0 for an empty one but those that are logarithms of 1 plus a count."""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256).astype(np.float64)
    size = max(1, len(raw))
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    share = counts[counts > 0] / size
    ends = counts[46] + counts[63] + counts[33]
    kinds = len(set(words))
    return np.concatenate([
        [np.log1p(len(raw)), np.log1p(len(words))], CLASSES @ counts / size,
        [
            kinds / n, np.log1p(kinds), sum(a == b for a, b in zip(words, words[1:])) / n, len(text) / n, max(map(len, words), default=0) ** 0.5,
            len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)), np.log1p(n / (1 + ends)), -(share * np.log(share)).sum(),
        ],
    ])


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, stats) of every row; NULL text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_values()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), list_column(np.stack([statistics_of(t) for t in texts_of(batch)]))], names=[key, "stats"])

    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, f"{typed(docs, key)}, stats array<double>")


@dataclass
class QualityModel:
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    values: np.ndarray

    @staticmethod
    def projection() -> tuple[np.ndarray, np.ndarray]:
        draw = np.random.default_rng(SEED)
        return draw.normal(0, 1 / WIDTH, (STATISTICS, FEATURES)), draw.uniform(0, 2 * np.pi, FEATURES)

    @staticmethod
    def features(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
        w, c = QualityModel.projection()
        z = np.clip((x - mean) / std, -6, 6)
        return np.hstack([np.cos(z @ w + c) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; a thousandth of it follows the ridge score, so that steps keep their inner order."""
        raw = self.features(x, self.mean, self.std) @ self.weights
        return 0.999 * np.interp(raw, self.cuts, self.values) + 0.001 * np.clip((raw - LOW) / (HIGH - LOW), 0, 1)


def isotonic(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-decreasing means by pooling adjacent violators; ``counts`` are positive."""
    pools: list[list[float]] = []
    for s, n in zip(sums, counts):
        pools.append([s, n, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s2, n2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + s2, pools[-1][1] + n2, pools[-1][2] + k2]
    return np.concatenate([np.full(int(k), s / n) for s, n, k in pools])


def fit_quality(stats: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", held_out: int = 5) -> QualityModel | None:
    """Fit on all labelled rows whose key's crc32 is not 0 modulo ``held_out``; None if there are none.

    A key with several labels counts with their mean; NULL labels and NULL keys don't count. Only sums of a size fixed
    by the number of features reach the driver: moments, two normal equations and the calibration bins.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).where(fold(key, held_out) != 0).groupBy(key).agg(F.avg(F.col(label).cast("double")).alias("y"))
    train = store(stats.join(known, key).select("stats", "y", (F.crc32(F.concat(F.lit("half "), F.col(key).cast("string")).cast("binary")) % 2).alias("half")), "train")
    tasks = scan_tasks(train)

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in slices(batches, 5000):
            x = matrix(batch.column("stats"))
            part = np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
            total = part if total is None else total + part
        return total

    sums = summed(train, moments, tasks)
    if sums is None:
        return None
    n, s = sums[0], STATISTICS
    mean = sums[1 : 1 + s] / n
    var = np.maximum(sums[1 + s :] / n - mean**2, 0)
    std = np.where(var > 1e-12, np.sqrt(var), 1.0)
    d = FEATURES + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in slices(batches, 5000):
            z = QualityModel.features(matrix(batch.column("stats")), mean, std)
            y, half = batch.column("y").to_numpy(zero_copy_only=False), batch.column("half").to_numpy(zero_copy_only=False)
            total = np.zeros((2, d, d + 1)) if total is None else total
            for h in (0, 1):
                own = z[half == h]
                total[h, :, :d] += own.T @ own
                total[h, :, d] += own.T @ y[half == h]
        return None if total is None else total.ravel()

    halves = summed(train, equations, tasks).reshape(2, d, d + 1)

    def solve(system: np.ndarray) -> np.ndarray:
        rows = max(system[d - 1, d - 1], 1.0)  # the last feature is the constant 1
        penalty = RIDGE * rows * np.eye(d)
        penalty[-1, -1] = 1e-9 * rows
        return np.linalg.solve(system[:, :d] + penalty, system[:, d])

    both = solve(halves.sum(0))
    crossed = [solve(halves[1]), solve(halves[0])] if halves[0, -1, -2] and halves[1, -1, -2] else [both, both]

    def bins(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in slices(batches, 5000):
            z = QualityModel.features(matrix(batch.column("stats")), mean, std)
            y, half = batch.column("y").to_numpy(zero_copy_only=False), batch.column("half").to_numpy(zero_copy_only=False)
            raw = np.where(half == 0, z @ crossed[0], z @ crossed[1])
            at = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(np.int64), 0, BINS - 1)
            part = np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS), np.bincount(at, weights=raw, minlength=BINS)])
            total = part if total is None else total + part
        return total

    counts, hits, raws = summed(train, bins, tasks).reshape(3, BINS)
    full = counts > 0
    return QualityModel(mean, std, both, raws[full] / counts[full], isotonic(hits[full], counts[full]))


def quality_scores(stats: DataFrame, model: QualityModel | None, key: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """(key, score, predicted) of every row of ``stats``; without a model every score is 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_values()
        for batch in slices(batches, 5000):
            score = model.score(matrix(batch.column("stats"))) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[key, "score", "predicted"])

    return stats.select(key, "stats").mapInArrow(run, f"{typed(stats, key)}, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel | None, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, unchanged; statistics are made and judged in one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_values()
        for batch in slices(batches):
            if model:
                good = model.score(np.stack([statistics_of(t) for t in texts_of(batch, text)])) >= threshold
                batch = batch.filter(pa.array(good))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = store(document_statistics(docs), "stats")
    return quality_scores(stats, fit_quality(stats, labels)).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
