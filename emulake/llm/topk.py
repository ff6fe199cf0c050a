"""Exact top-k by inner product with bounds from segment means and deviations, coarse to fine.

A vector cut into segments of w components has a mean and a deviation per segment. For two vectors,
|a - b|^2 >= sum of w ((mean_a - mean_b)^2 + (dev_a - dev_b)^2), so with the two norms known their inner product is at most
sum of w (mean_a mean_b + dev_a dev_b). Levels with more and shorter segments have tighter bounds. Candidates that a bound
puts below the k-th best score so far are dropped; the rest go to the next level, and what survives all is scored
exactly in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emulake.llm.common import slices, store

LEVELS = (2, 8)  # segments, coarse to fine
#: Rows of a block. A task holds one block of queries and passes candidates of one block by it.
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192
STRIP = 1024  # candidates bounded at a time
DENSE = 1 / 32  # share of surviving pairs above which a strip is computed as one matrix product
PAIRS = 500_000  # pairs computed at a time otherwise
EXACT = 2.0**53


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(key, v) with v = floor(scale * x) of each component as double; rows that are NULL or hold a NULL or non-finite
    component, and rows without a key, are left out."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(fine).select(
        F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("double")).alias("v"))


def segments(v: np.ndarray, parts: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of the segment's length, side by side."""
    edges = np.linspace(0, v.shape[1], parts + 1).round().astype(int)
    out = []
    for a, b in zip(edges, edges[1:]):
        if b > a:
            own = v[:, a:b]
            mean = own.mean(axis=1)
            dev = np.sqrt(np.maximum((own * own).mean(axis=1) - mean * mean, 0))
            out += [mean * np.sqrt(b - a), dev * np.sqrt(b - a)]
    return np.stack(out, axis=1) if out else np.zeros((len(v), 1))


def padded(lists: list[list[float]], width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def rows_of(column: pa.Array) -> np.ndarray:
    """Vectors as the rows of a matrix; shorter ones are filled up with zeros."""
    widths = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(widths) and (widths == widths[0]).all():
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(widths), int(widths[0]))
    return padded(column.to_pylist(), int(widths.max(initial=0)))


def stacked(parts: list[np.ndarray]) -> np.ndarray:
    width = max(x.shape[1] for x in parts)
    return np.vstack([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in parts])


def exact_products(q: np.ndarray, c: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs. In floating point where every partial sum is exact, else in Python's integers,
    kept to the range of a long."""
    if q.shape[1] == 0:
        return np.zeros(len(qi), dtype=np.int64)
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] < EXACT:
        return np.einsum("ij,ij->i", q[qi], c[ci]).astype(np.int64)
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(q[i], c[j])), low), high) for i, j in zip(qi, ci)], dtype=np.int64)


class Best:
    """The k best (score, -id) per query so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.score = np.full((queries, k), np.iinfo(np.int64).min)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.full = np.zeros(queries, dtype=np.int64)

    def bar(self) -> np.ndarray:
        return np.where(self.full >= self.k, self.score[:, -1].astype(np.float64), -np.inf)

    def add(self, qi: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Merge pairs; ties go to the smaller id."""
        if not len(qi):
            return
        order = np.lexsort((ids, ~score, qi))
        qi, ids, score = qi[order], ids[order], score[order]
        start = np.concatenate([[True], qi[1:] != qi[:-1]])
        rank = np.arange(len(qi)) - np.flatnonzero(start)[np.cumsum(start) - 1]
        keep = rank < self.k
        qi, ids, score, rank = qi[keep], ids[keep], score[keep], rank[keep]
        own = np.unique(qi)
        at = np.searchsorted(own, qi)
        new_s, new_i = np.full((len(own), self.k), np.iinfo(np.int64).min), np.full((len(own), self.k), np.iinfo(np.int64).max)
        new_s[at, rank], new_i[at, rank] = score, ids
        s, i = np.hstack([self.score[own], new_s]), np.hstack([self.id[own], new_i])
        by = np.lexsort((i, ~s))[:, : self.k]
        self.score[own], self.id[own] = np.take_along_axis(s, by, 1), np.take_along_axis(i, by, 1)
        self.full[own] = np.minimum(self.full[own] + np.bincount(at, minlength=len(own)), self.k)


def pair_products(a: np.ndarray, b: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    parts = [np.einsum("ij,ij->i", a[qi[at : at + PAIRS]], b[ci[at : at + PAIRS]]) for at in range(0, len(qi), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


def search_block(best: Best, q: np.ndarray, q_id: np.ndarray, c: np.ndarray, c_id: np.ndarray) -> None:
    """Pass one strip of candidates by all queries of a block.

    Where many pairs survive a level the next one is one matrix product over the strip, else it is computed pair by
    pair; both give the same survivors. Of the exact scores only those that reach the k-th best are merged.
    """
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (q, c))
    bar = best.bar()
    slack = 1e-9 * (1 + np.linalg.norm(q, axis=1).max(initial=0) * np.linalg.norm(c, axis=1).max(initial=0))
    alive = q_id[:, None] != c_id[None, :]
    for parts in LEVELS:
        sq, sc = segments(q, parts), segments(c, parts)
        if alive.mean() > DENSE:
            alive &= sq @ sc.T >= bar[:, None] - slack
        else:
            qi, ci = np.nonzero(alive)
            alive[qi, ci] = pair_products(sq, sc, qi, ci) >= bar[qi] - slack
    if alive.mean() > DENSE and np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * width < EXACT:
        score = q @ c.T  # integers, exact in any order of summation
        score[~alive] = -np.inf
        if best.k <= len(c) and np.isinf(bar).any():
            bar = np.maximum(bar, np.partition(score, -best.k, axis=1)[:, -best.k])  # k pairs of this strip reach it
        qi, ci = np.nonzero(alive & (score >= bar[:, None]))
        best.add(qi, c_id[ci], score[qi, ci].astype(np.int64))
        return
    qi, ci = np.nonzero(alive)
    for at in range(0, len(qi), PAIRS):
        x, y = qi[at : at + PAIRS], ci[at : at + PAIRS]
        best.add(x, c_id[y], exact_products(q, c, x, y))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best candidates of each query by inner product, ties to the smaller id.

    ``vectors`` is the table of :func:`quantised`. Queries are the rows whose vec_id is divisible by ``every``, candidates
    all rows of another vec_id. Queries and candidates meet in blocks of fixed size, so a task holds one block of queries
    and its best scores; the best of each block pair are merged by query. A shorter vector counts as filled up with
    zeros. Rows with the same vec_id are all candidates; the least of
    their vectors is the query.
    """
    rows = store(vectors, "vectors")
    n = rows.count()
    q_blocks, c_blocks = max(1, -(-(n // every + 1) // QUERY_BLOCK)), max(1, -(-n // CANDIDATE_BLOCK))
    deal = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    numbers = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = asked.withColumn("qb", deal(q_blocks)).withColumn("cb", numbers(c_blocks)).withColumn("candidate", F.lit(False))
    candidates = rows.withColumn("cb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(c_blocks)).cast("int")).withColumn("qb", numbers(q_blocks)).withColumn("candidate", F.lit(True))
    met = queries.select("qb", "cb", "candidate", "vec_id", "v").unionByName(candidates.select("qb", "cb", "candidate", "vec_id", "v"))
    dealt = met.repartition(q_blocks * c_blocks, "qb", "cb").sortWithinPartitions("qb", "cb", "candidate", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, q_parts, q_ids, best, q, q_id = None, [], [], None, None, None

        def out() -> pa.RecordBatch:
            row, col = np.nonzero(np.arange(k)[None, :] < best.full[:, None]) if best else (np.zeros(0, dtype=int),) * 2
            parts = [q_id[row], best.id[row, col], best.score[row, col]] if best else [np.zeros(0, dtype=np.int64)] * 3
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()) for p in parts], names=["query_id", "vec_id", "score"])

        for batch in slices(batches, STRIP):
            pairs = list(zip(batch.column("qb").to_pylist(), batch.column("cb").to_pylist(), batch.column("candidate").to_pylist()))
            at = 0
            while at < len(pairs):
                end = at
                while end < len(pairs) and pairs[end] == pairs[at]:
                    end += 1
                part = batch.slice(at, end - at)
                ids, rows = part.column("vec_id").to_numpy(), rows_of(part.column("v"))
                if pairs[at][:2] != block:
                    if best:
                        yield out()
                    block, q_parts, q_ids, best = pairs[at][:2], [], [], None
                if not pairs[at][2]:
                    q_parts.append(rows)
                    q_ids += ids.tolist()
                elif q_parts:
                    if best is None:
                        q, q_id, best = stacked(q_parts), np.array(q_ids, dtype=np.int64), Best(len(q_ids), k)
                    search_block(best, q, q_id, rows, ids)
                at = end
        if best:
            yield out()

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
